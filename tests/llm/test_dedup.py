import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from revwatch.llm import exact_dedup, simhash
from revwatch.llm.queries import op9_simhash_near_dedup


def expected_groups(rows):
    by_text = {}
    for doc, text in rows:
        by_text.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        own = by_text[text or ""]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_exact_groups(make_docs, odd_rows):
    rows = [*odd_rows, (11, None), (12, "a row without an id"), (None, "x"), (None, "x")]
    docs = make_docs(rows)
    assert as_sorted(exact_dedup.exact_groups(docs).collect()) == as_sorted(expected_groups(rows))
    assert exact_dedup.exact_groups(make_docs([])).collect() == []


def test_equal_digests_of_different_texts(make_docs, odd_rows):
    """With a digest that says almost nothing, only the comparison of full texts tells them apart."""
    weak = lambda text: F.length(text).cast("string")
    rows = [*odd_rows, (20, "abc"), (21, "abd"), (22, "abc"), (23, "abe")]
    found = exact_dedup.exact_groups(make_docs(rows), digest=weak).collect()
    assert as_sorted(found) == as_sorted(expected_groups(rows))
    kept = exact_dedup.distinct_documents(make_docs(rows), digest=weak).collect()
    assert len(kept) == len({t or "" for _, t in rows})


def test_distinct_documents(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.schema.names == docs.schema.names
    assert as_sorted((r.doc_id, r.text) for r in kept.collect()) == as_sorted(
        (max((d for d, u in odd_rows if (u or "") == t and d is not None), default=None), t)
        for t in {t or "" for _, t in odd_rows}
    )
    assert exact_dedup.distinct_documents(make_docs([])).collect() == []


def check_near(rows, found, max_bits=4):
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    expected = [
        (d, f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints, max_bits), strict=True)
    ]
    assert as_sorted(found) == as_sorted(expected)


def test_near_groups(make_docs, odd_rows):
    base = " ".join(f"w{i}" for i in range(400))
    near = [(100 + k, base.replace(f"w{k} ", f"other{k} ")) for k in range(40)]
    rows = [*odd_rows, *near, (50, "a b c"), (51, "A  b\nc")]
    check_near(rows, simhash.near_groups(make_docs(rows)).collect())
    assert simhash.near_groups(make_docs([])).collect() == []
    kept = simhash.without_near_copies(make_docs(rows))
    groups = brute.components([(d, brute.fingerprint(t)) for d, t in rows])
    wanted = [d for (d, _), c in zip(rows, groups, strict=True) if d == c]
    assert as_sorted((r.doc_id,) for r in kept.collect()) == as_sorted((d,) for d in wanted)


def test_one_document_of_each_group_stays(make_docs):
    """Also where two texts of a group share the id that stays, or no row has one."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base), (1, base.replace("w7 ", "x ")), (2, base.replace("w9 ", "y ")), (None, "q r s t u"), (None, "Q r s t u")]
    kept = simhash.without_near_copies(make_docs(rows)).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {1, None}


def test_near_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_near(docs, op9_simhash_near_dedup(spark, sf_dir).collect())


def test_block_tables_miss_no_pair():
    rng = np.random.default_rng(5)
    for count in (10, 10**6, 10**9):
        cuts, tables = simhash.block_tables(count, 4)
        assert sum(n for _, n in cuts) == 64
        for _ in range(200):
            flipped = rng.choice(64, rng.integers(0, 5), replace=False)
            broken = {k for k, (a, n) in enumerate(cuts) for b in flipped if a <= b < a + n}
            assert any(not broken & set(t) for t in tables)


def test_links_inside_large_buckets():
    """Chains and clusters in one bucket keep their components, with fewer links than rows."""
    rng = np.random.default_rng(6)
    prints = np.unique(rng.integers(0, 1 << 10, 400).astype(np.uint64))
    found = simhash.bucket_links(np.zeros(len(prints)), prints, 2)
    a, b = (np.concatenate([x[i] for x in found]).tolist() for i in (0, 1))
    assert len(a) < len(prints)
    place = {p: i for i, p in enumerate(prints.tolist())}
    direct = brute.components([(i, int(p)) for i, p in enumerate(prints)], 2)
    group = list(range(len(prints)))
    for x, y in zip(a, b, strict=True):
        gx, gy = group[place[x]], group[place[y]]
        group = [min(gx, gy) if g in (gx, gy) else g for g in group]
    assert group == direct


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(-5, -3)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {-3: -5}


@pytest.mark.parametrize("piece", [5, 40])
def test_large_buckets_are_cut_into_pieces(spark, monkeypatch, piece):
    """Fingerprints that share every block but the last: all links survive the cut, and a piece pair gives a forest."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(piece)
    prints = np.unique(rng.integers(0, 1 << 14, 300).astype(np.int64))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fingerprint bigint")
    found = simhash.links(frame, len(prints), 2).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 for r in found)
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, len(prints), 2)).collect()}
    expected = brute.components([(int(p), int(p)) for p in prints], 2)
    assert [roots.get(int(p), int(p)) for p in prints] == expected


def test_one_template_of_many_texts(spark):
    """Twenty thousand distinct fingerprints about one centre are one bucket, cut into pieces, and one component."""
    rng = np.random.default_rng(1)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(40_000)], np.uint64)
    prints = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips ^ np.array([1 << int(b) for b in rng.integers(0, 64, 40_000)], np.uint64))[:20_000]
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint bigint")
    roots = simhash.components(simhash.links(frame, len(prints)))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(prints) - 1
