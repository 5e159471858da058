import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from revwatch.llm import jaccard_join, spelling, whitening
from revwatch.llm.queries import op12_embedding_whitening, op13_ngram_jaccard_join


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- spelling variants


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in brute.LATIN.findall((text or "").translate(brute.LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def expected_variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, many = {}, {}
    for w in counts:
        own = [v for v in counts if near(w, v)]
        many[w] = len(own)
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], many[w], counts.get(form[w])))
    return out


def test_variants_of_texts(make_docs, odd_rows):
    base = "recieve receive receive recive receives colour color coloür colours naïve naive naïvè ÀBCDE àbcde "
    rows = [*odd_rows, *[(100 + k, base * (1 + k % 3) + "receive color " * k) for k in range(40)], (7, "abcdé" * 3000 + " ") ]
    rows += [(300 + k, "abcdé" * 3000) for k in range(3)]
    counts = words_of(rows)
    words = spelling.vocabulary(make_docs(rows))
    assert {r.word: r.n for r in words.collect()} == counts
    assert as_sorted(spelling.variant_groups(words).collect()) == as_sorted(expected_variants(counts))


@pytest.mark.parametrize("tile", [1024, 3])
def test_variants_of_random_words(spark, tile, monkeypatch):
    """Crowded words of few letters, with blocks of any size: every pair is found once."""
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 8))) for _ in range(400)}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.choice([3, 4, 8, 20, 50, 200], len(words)), strict=True)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_sorted(spelling.variant_groups(frame).collect()) == as_sorted(expected_variants(counts))


def test_chains_of_forms(spark):
    chain = [("a" * k + "b" * (40 - k), 3 * 2**k) for k in range(41)]
    rows = spelling.variant_groups(spark.createDataFrame(chain, "word string, n bigint")).collect()
    assert {r.root for r in rows} == {"a" * 40}


def test_no_words(make_docs):
    assert spelling.variant_groups(spelling.vocabulary(make_docs([]))).collect() == []
    assert spelling.variant_groups(spelling.vocabulary(make_docs([(1, None), (2, "")]))).collect() == []


# --- whitening


def check_whitening(rows, found, components=16):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in usable], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array((n * fit - s) / n, float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-9 * values[0]).sum()))
    want = np.array((n * x - s) / n, float) @ (vectors[:, :kept] / np.sqrt(values[:kept]))
    got = sorted(found, key=lambda r: (r.component, repr(r.vec_id), r.deviation))
    assert len(got) == len(usable) * kept
    order = sorted(range(len(usable)), key=lambda k: (repr(usable[k][0]), sum((n * x[k] - s) ** 2)))
    table = np.array([r.whitened for r in got]).reshape(kept, len(usable)).T
    first = got[: len(usable)]
    assert [r.vec_id for r in first] == [usable[k][0] for k in order]
    assert [r.deviation for r in first] == [int(sum((n * x[k] - s) ** 2)) for k in order]
    for c in range(kept):
        sign = np.sign(table[:, c] @ want[order, c])
        assert np.allclose(table[:, c], sign * want[order, c], atol=1e-6)
    assert all(r.n == n and r.identity_error < 1e-4 for r in got)
    assert np.allclose([r.explained for r in got[:: len(usable)]], values[:kept] / np.trace(cov), rtol=1e-4)


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name in ("index", "f", "y", "n", "component", "_at"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=5) * [1, 2, 3, 4, 0.5]]) for k in range(300)]
    rows += [rows[0], rows[1], (None, rows[2][1])] + [(1000 + k, rows[3][1]) for k in range(150)]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, float("nan"), 0.0, 0.0, 0.0])]
    odd += [(904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    check_whitening(rows, whitening.whitened(vectors(spark, rows + odd)).collect())


def test_components_without_variance(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(a), float(a), 3.0, float(b)]) for k, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2}
    check_whitening(rows, found)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whitened(vectors(spark, rows))
        assert found.collect() == [] and found.columns[:3] == ["vec_id", "component", "n"]


def test_several_blocks(spark, monkeypatch):
    """Rows and columns over many blocks, the inner dimension over many splits."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 3)
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(rng.normal(size=(200, 7)))]
    check_whitening(rows, whitening.whitened(vectors(spark, rows), 4).collect(), 4)


def test_whitening_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, op12_embedding_whitening(spark, sf_dir).collect())


# --- Jaccard join


def check_groups(rows, found, words=5):
    assert as_sorted(found) == as_sorted(brute.jaccard_groups(rows, words))


def clusters(rng, size, words=120, edits=4):
    """Near copies of one text with some words replaced, about at the threshold."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for k in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            own[k] = f"x{rng.integers(0, 40)}"
        out.append(" ".join(own))
    return out


def test_groups_of_odd_rows(make_docs, odd_rows):
    long = dict((r for r in odd_rows if r[0] is not None))[8]
    rows = [*odd_rows, (10, long + " end"), (11, "a b c"), (12, "A  b\nc"), (13, "a b c d e"), (14, "a b c d e f"), (None, "a b c d")]
    check_groups(rows, jaccard_join.jaccard_groups(make_docs(rows)).collect())
    assert jaccard_join.jaccard_groups(make_docs([])).collect() == []


@pytest.mark.parametrize(("light", "heavy", "tile"), [(64, 1024, 2048), (4, 8, 10), (2, 2, 1000)])
def test_groups_at_the_threshold(make_docs, monkeypatch, light, heavy, tile):
    """Large groups of near copies on both sides of the threshold, by short lists, long lists and split lists."""
    for name, value in (("LIGHT", light), ("HEAVY", heavy), ("TILE", tile)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(light)
    shared = " ".join(f"licence{k}" for k in range(60))
    texts = clusters(rng, 80) + clusters(rng, 40, 60, 3)
    texts += [" ".join(f"u{rng.integers(0, 300)}" for _ in range(80)) + " " + shared for _ in range(30)] + texts[:10]
    rows = list(enumerate(texts))
    check_groups(rows, jaccard_join.jaccard_groups(make_docs(rows)).collect())


def test_broken_forests_are_mended(make_docs, monkeypatch):
    """With sketches of no use, possible links of long lists are often none; the rest of their lists is then checked."""
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 8)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 8)
    rows = list(enumerate(clusters(np.random.default_rng(9), 60, 100, 6)))
    check_groups(rows, jaccard_join.jaccard_groups(make_docs(rows)).collect())


def test_prefixes_miss_no_pair():
    """Whatever lengthenings two sets choose, linked sets share as many posted items as they demand."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        a = rng.choice(1000, size, replace=False)
        b = np.union1d(rng.permutation(a)[: int(size * rng.uniform(0.85, 1))], rng.choice(1000, int(rng.integers(0, size // 6 + 1))))
        if not jaccard(a, b):
            continue
        lists = []
        for s in (np.sort(a), np.sort(b)):
            least = int(jaccard_join.needed(np.array(len(s)), 80, 100))
            extra = int(rng.integers(1, least + 1))
            lists.append((s[: len(s) - least + extra], len(s)))
        (p, m), (q, n) = lists
        demand = min(len(p) - m, len(q) - n) + int(jaccard_join.overlap(np.array(m), np.array(n), 80, 100))
        assert len(np.intersect1d(p, q)) >= demand >= 1


def jaccard(a, b):
    same = len(np.intersect1d(a, b))
    return 100 * same >= 80 * (len(a) + len(b) - same)


def test_jaccard_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(rows, op13_ngram_jaccard_join(spark, sf_dir).collect())
