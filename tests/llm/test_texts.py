from pathlib import Path

import brute
import numpy as np
import pytest

from revwatch.llm import decontaminate, language, ngram_lm, quality, url_filters
from revwatch.llm.queries import URL_RULES, op3_language_id, op5_quality_classifier, op7_lm_scoring


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [
        (1, "the quick brown fox jumps over the lazy dog and then it runs away again into the woods"),
        (2, "Short item"),
        (3, None),
        (4, "!!!"),
        (10, "short ITEM"),
        (None, "no number here"),
    ]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def contaminated_rows():
    passage = "The quick, brown fox -- jumps over the lazy dog and then it runs AWAY"
    filler = " ".join(f"f{i}" for i in range(300))
    return [
        (30, passage),
        (31, f"{filler} {passage} {filler}"),
        (32, f"{filler} {passage}"),
        (33, "a short item"),
        (34, passage.replace("lazy", "idle")),
        (35, f"short item {passage} again into short item"),
        (36, "short"),
    ]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 60])
def test_contamination(make_docs, odd_rows, benchmark, limit):
    rows = [*odd_rows, *contaminated_rows()]
    found = decontaminate.contamination(make_docs(rows), benchmark[1], limit=limit).collect()
    expected = brute.contamination(rows, [i for i in benchmark[0] if i[0] is not None])
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=key) == sorted(
        expected, key=key
    )
    left = decontaminate.without_contaminated(make_docs(rows), benchmark[1], limit=limit)
    assert left.columns == make_docs([]).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in expected if not r[4])


def test_spans_are_cut(make_docs, benchmark):
    rows = {r.doc_id: r.text for r in decontaminate.without_spans(make_docs(contaminated_rows()), benchmark[1]).collect()}
    assert rows[30] == "" and rows[33] == "a " and rows[36] == "short" and rows[34] == contaminated_rows()[4][1]
    assert rows[32] == " ".join(f"f{i}" for i in range(300)) + " "


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 20])
def test_items_without_an_id_count_as_in_the_sql(spark, make_docs, limit):
    import duckdb

    from revwatch.llm.oracle import OP4

    docs = [(1, "there is no number here at all"), (2, "no number here short item"), (3, "nothing"), (4, "short item")]
    items = [(None, "no number here"), (None, "no number"), (7, "short item")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(make_docs(docs), frame, limit=limit).collect()
    con = duckdb.connect()
    for name, columns, rows in (("documents", "doc_id BIGINT, text VARCHAR", docs), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    expected = {r[0]: (r[1], r[2], r[3], r[5]) for r in con.execute(OP4).fetchall()}
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in found} == expected
    assert {r.doc_id: r["items"] for r in found} == {1: [None], 2: ["7", None], 3: [], 4: ["7"]}


def test_equal_hashes_of_words_and_windows_are_told_apart(make_docs, benchmark, monkeypatch):
    """With hashes that say almost nothing, only the comparison of words and windows tells them apart."""
    monkeypatch.setattr(decontaminate, "rolling", lambda n, size: np.zeros(max(len(n) - size + 1, 0), np.uint64))
    monkeypatch.setattr(decontaminate.xxhash, "xxh64_intdigest", lambda w: len(w) % 2)
    table = decontaminate.WindowSet(benchmark[0], 13)
    rows = [r for r in contaminated_rows() if r[0] is not None]
    for doc, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        column, _, _, per_row = decontaminate.split_words(data, np.array([0, len(data)]))
        found = table.hits(table.numbers(column.to_pylist()), per_row).get(0, [])
        held = {str(i) for _, _, own in found for i in own if i is not None}
        hit = {p for at, n, _ in found for p in range(at, at + n)}
        _, _, n_hit, items, _ = brute.contamination([(doc, text)], [i for i in benchmark[0] if i[0] is not None])[0]
        assert (len(hit), sorted(held)) == (n_hit, items)


def test_window_table_is_small():
    """A few bytes per byte of benchmark text, whatever the items repeat."""
    rng = np.random.default_rng(2)
    words = np.array([f"word{k}" for k in range(20_000)])
    items = [(str(k), " ".join(rng.choice(words, 120))) for k in range(2_000)] + [("x", "same words again " * 50_000)]
    table = decontaminate.WindowSet(items, 13)
    assert table.nbytes < 8 * sum(len(t) for _, t in items)


def test_contamination_empty(spark, make_docs, benchmark):
    assert decontaminate.contamination(make_docs([]), benchmark[1]).collect() == []
    none = decontaminate.contamination(make_docs([(1, "a b")]), benchmark[1].limit(0)).head()
    assert (none.n_words, none.n_hit, none["items"]) == (2, 0, [])


def test_language_query(spark, sf_dir):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    assert all(r.held_out == brute.in_fold(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    unseen = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert np.mean(unseen) > 0.97


def longest_match(text, source, at):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in source:
        n += 1
    return n


def test_phrases_are_longest_matches():
    sample = {"a": "the cat sat on the mat and that was that", "b": "el gato se sienta en la alfombra"}
    parser = language.CrossParser(sample)
    for text in ("that cat", "zzz el", "gato on the mat", "x", ""):
        data = np.frombuffer(text.encode(), np.uint8)
        counts, _ = parser.phrases(data, np.array([0, len(data)]))
        body = language.folded(text)
        for k, name in enumerate(parser.languages):
            source, at, phrases = language.folded(sample[name]), 0, 0
            while at < len(body):
                at += max(longest_match(body, source, at), 1)
                phrases += 1
            assert counts[0, k] == phrases, (text, name)


def whole_phrases(body, source):
    at, phrases = 0, 0
    while at < len(body):
        at += max(longest_match(body, source, at), 1)
        phrases += 1
    return phrases


@pytest.mark.parametrize("run_bytes", [language.RUN_BYTES, 7, 1])
def test_phrases_of_long_texts_are_those_of_the_whole(monkeypatch, run_bytes):
    """Runs end anywhere, also inside a letter of two bytes and inside stretches that never come to one phrase border."""
    monkeypatch.setattr(language, "RUN_BYTES", run_bytes)
    rng = np.random.default_rng(run_bytes)
    stems = ["été", "maïs", "the", "cat", "über", "straße", "a", "ab", "aba", "zq"]
    words = lambda n: " ".join(rng.choice(stems, n))
    sample = {"a": words(400) + " " + "ab" * 300, "b": words(300) + " " + "é" * 500, "c": "x"}
    parser = language.CrossParser(sample)
    lengths = (1, 2, 255, 256, 257, 511, 513, 3_000, 100_000 if run_bytes > 100 else 5_000)
    texts = ["", *(words(n)[:n] for n in lengths), "ab" * 2_000, "é" * 1_500, "ba" * 700 + words(50) + "é" * 300, "qqq " * 400]
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    counts, _ = parser.phrases(np.frombuffer(b"".join(data), np.uint8), offsets)
    for r, t in enumerate(texts):
        body = language.folded(t)
        body = body[1:] if body[:1] == b"\x00" else body  # a border that begins a text is none
        assert counts[r].tolist() == [whole_phrases(body, language.folded(sample[n])) for n in parser.languages], r


def test_language_of_odd_rows(make_docs, odd_rows):
    sample = {"en": "One and the same text with words and more words that follow", "de": "ein Text mit Tabulator und Ende"}
    rows = {str(r.doc_id): r for r in language.identify(make_docs(odd_rows), sample).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in ("1", "2", "3", "9"))
    assert rows["4"].lang_pred == "en" and rows["6"].lang_pred == "de" and rows["None"].held_out is None
    left = language.with_known_language(make_docs(odd_rows), sample)
    assert left.count() == len(odd_rows) - 4 and left.columns == make_docs([]).columns
    assert language.identify(make_docs([]), sample).collect() == []
    assert language.identify(make_docs([(1, "x")]), language.learnt(make_docs([]))).head().lang_pred == "und"


def test_training_sample_is_bounded_and_blind(make_docs):
    docs = make_docs([(i, f"text number {i} " * 50) for i in range(200)])
    sample = language.learnt(docs)
    assert list(sample) == ["en"] and len(sample["en"]) < language.TRAIN_BYTES + 2 * language.TEXT_BYTES
    for i in range(200):
        if brute.in_fold(i, 4):
            assert f"text number {i} " not in sample["en"]


def test_training_sample_draws_passages_of_distinct_texts(make_docs):
    learnt = [i for i in range(2000) if not brute.in_fold(i, 4)]
    head = "shared licence head " * 50
    # Half of the rows are copies of one text, and all other texts begin with the same thousand characters.
    rows = [(i, f"copied text {'x' * 700}") for i in learnt[:600]]
    rows += [(i, head + f"own passage {i} ".ljust(1000, "y")) for i in learnt[600:800]]
    sample = language.learnt(make_docs(rows))["en"]
    assert sample.count("copied text") <= 1 and sample.count(head) <= 1
    assert sample.count("own passage") >= 10
    # Ids have no say.
    again = language.learnt(make_docs([(learnt[-1 - k], t) for k, (_, t) in enumerate(rows)]))
    assert again["en"] == sample


def test_training_sample_fills_up_from_few_texts(make_docs):
    long = "".join(f"passage {k} ".ljust(1000, "z") for k in range(100))
    key = next(i for i in range(99) if not brute.in_fold(i, 4))
    sample = language.learnt(make_docs([(key, long)]))["en"]
    assert language.TRAIN_BYTES <= len(sample) < language.TRAIN_BYTES + 2 * language.TEXT_BYTES
    assert max(int(x.split()[0]) for x in sample.split("passage ")[1:]) > 16


def test_quality_query(spark, sf_dir):
    # 200 documents hold a dozen bad ones; the next larger tables have enough to estimate accuracies from.
    sf_dir = str(Path(sf_dir).parent / "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = op5_quality_classifier(spark, sf_dir)
    assert rows.count() == docs.count()
    told = rows.join(labels, "doc_id").join(docs, "doc_id").filter("n_chars >= 100").collect()
    good = [r.keep for r in told if r.quality == 1]
    bad = [r.keep for r in told if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def quality_rows(odd_rows):
    """Odd rows and texts with every fault that a labeller looks at."""
    plain = "The quick brown fox jumps over the lazy dog while nobody in the village looks at it for long. "
    rows = [(100 + k, plain * (1 + k % 4) + f"Ending number {k}.") for k in range(12)]
    rows += [
        (200, "BUY NOW!!! $$$ CLICK HERE $$$ " * 8), (201, "a | b | c | d | " * 30), (202, "spam spam spam spam " * 20),
        (203, "1234 5678 90 12 34 " * 10), (204, "#### @@@@ %%%% &&&& " * 12), (205, "x" * 300 + " " + "y" * 90),
        (206, "word# other@ third% " * 15), (207, "caf\u00e9 na\u00efve \ud55c\uad6d " * 20), (208, "one two"),
    ]
    short = [(d, t if t is None or len(t) < 5_000 else t[:5_000]) for d, t in odd_rows]
    return [*short, *rows]


def test_quality_against_plain_python(make_docs, odd_rows):
    """Votes, label model, scorer and result of every row, null ids and repeated rows included."""
    rows = quality_rows(odd_rows)
    docs = make_docs(rows)
    found = quality.scored(docs, quality.fit(docs)).collect()
    expected = brute.quality(rows, quality.LABELLERS, quality.FEATURES)
    key = lambda r: (str(r[0]), r[3], round(r[1], 6))
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [(r[0], r[3], r[4]) for r in found] == [(r[0], r[3], r[4]) for r in expected]
    assert [r[1] for r in found] == pytest.approx([r[1] for r in expected], abs=1e-4)
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1e-6)


def test_quality_of_all_lengths(spark, sf_dir):
    """Held against the labels of documents of any length, not only of those with a hundred characters."""
    sf_dir = str(Path(sf_dir).parent / "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op5_quality_classifier(spark, sf_dir).collect() if labels.get(r.doc_id) is not None]
    assert np.mean([r.keep == (labels[r.doc_id] == 1) for r in rows]) > 0.9


def test_copies_and_ids_have_no_say_in_the_training_sample(make_docs):
    texts = [f"text {k} " + "with some words " * (k % 7) for k in range(60)]
    once = make_docs(list(enumerate(texts)))
    copied = make_docs([(None, t) for t in texts] + [(5, texts[0])] * 200)
    keys = [sorted(r.key for r in quality.training_rows(d, "text", 20).collect()) for d in (once, copied)]
    assert keys[0] == keys[1] and len(keys[0]) == 20


def test_votes_of_documents(spark, sf_dir):
    """The ballots of whole documents of all lengths, and their posteriors under the model of their own counts."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in op5_quality_classifier(spark, sf_dir).collect()}
    ballots = {d: brute.text_votes(t, quality.LABELLERS) for d, t in rows}
    assert {d: r.votes for d, r in found.items()} == ballots
    prior, chances = brute.label_model(list(ballots.values()))
    expected = {d: brute.label_posterior(b, prior, chances) for d, b in ballots.items()}
    assert {d: r.label_posterior for d, r in found.items()} == pytest.approx(expected, abs=1e-6)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = np.linspace(0.65, 0.95, len(quality.LABELLERS))
    right = rng.random((len(truth), len(accuracy))) < accuracy
    ballots = np.where(right == truth[:, None], 2, 0)
    ballots[rng.random(ballots.shape) < 0.2] = 1
    patterns, counts = np.unique(quality.pattern_of(ballots), return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - accuracy).max() < 0.03 and abs(model.prior - 0.7) < 0.03
    assert np.mean((model.posterior(ballots) > 0.5) == truth) > 0.95


def test_quality_of_odd_rows(make_docs, odd_rows):
    model = quality.fit(make_docs(odd_rows))
    rows = {str(r.doc_id): r for r in quality.scored(make_docs(odd_rows), model).collect()}
    assert len(rows) == len({str(d) for d, _ in odd_rows})
    assert all(rows[k].score == 0 and not rows[k].keep for k in ("1", "2", "3"))
    nothing = quality.fit(make_docs([]))
    assert quality.scored(make_docs([]), nothing).collect() == []


def check_model(rows, expected):
    for r, (n, known, total, base, score) in zip(rows, expected, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6, rel=1e-9)
        # A step of the quantised logarithm is 9/254, so a token is off by half of that at most.
        assert abs(r.score - score) <= n * (ngram_lm.LOWEST / 254 / 2 + 1e-6)


def test_lm_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in op7_lm_scoring(spark, sf_dir).collect()}
    assert len(rows) == len(docs) and all(r.held_out == brute.in_fold(r.doc_id, 7) for r in rows.values())
    expected = brute.language_model(docs, lambda d: not brute.in_fold(d, 7), ngram_lm.WEIGHT)
    check_model([rows[d] for d, _ in docs], expected)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("shard_bytes, block_bytes", [(1 << 20, 1 << 20), (50_000, 70)])
def test_lm_odd_rows(make_docs, odd_rows, shard_bytes, block_bytes):
    """Results do not depend on how blocks and shards are cut."""
    learns = "doc_id % 2 = 0"
    found = ngram_lm.scores(make_docs(odd_rows), learns, shard_bytes=shard_bytes, block_bytes=block_bytes).collect()
    expected = brute.language_model(odd_rows, lambda d: d is not None and d % 2 == 0, ngram_lm.WEIGHT)
    order = sorted(range(len(odd_rows)), key=lambda i: str(odd_rows[i][0]))
    check_model(sorted(found, key=lambda r: str(r.doc_id)), [expected[i] for i in order])


def test_lm_empty(make_docs):
    assert ngram_lm.scores(make_docs([]), "true").collect() == []
    row = ngram_lm.scores(make_docs([(1, "a b")]), "false").head()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (5000, 6000), (5000, 1 << 40), (3000, 1 << 63)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        coded = ngram_lm.EliasFano.of(values, universe)
        for a, b in ((0, n), (n // 3, n // 2), (n, n), (max(n - 1, 0), n)):
            assert (coded.decode(a, b) == values[a:b]).all()
        if n == 5000:
            assert coded.low.nbytes + coded.high.nbytes < n * (np.log2(universe / n) + 3) / 8 + 16


def test_trie_finds_what_it_holds(tmp_path):
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)).astype(np.uint64) * np.uint64(1 << 37), axis=0)
    held, asked = pairs[::2], pairs
    p = rng.random(len(held)) * 0.9 + 1e-6
    ngram_lm.Trie.build(held[:, 0], held[:, 1], p).save(str(tmp_path / "t"))
    codes = ngram_lm.Trie.open(str(tmp_path / "t")).find(asked[:, 0], asked[:, 1], step=16)
    assert (codes[1::2] == 0).all()
    assert np.abs(np.log10(ngram_lm.restored(codes[::2])) - np.log10(p)).max() <= ngram_lm.LOWEST / 254


def page_rows():
    rows = [(i, f"https://a.example.com/{'de' if i % 2 else 'en'}/{i}.html?x=1") for i in range(60)]
    rows += [(100 + i, f"http://Blog.X.NET/en/{i}") for i in range(3)] + [(110, "http://net"), (111, "http://net/a")]
    rows += [(120, None), (121, ""), (122, "no scheme/at/all"), (123, "https://EXAMPLE.net/en/1#x"), (124, "x://h?p/q")]
    rows += [(130, "http://s.org/fr/1"), (131, "http://s.org/en/1"), (131, "http://s.org/en/1"), (None, "http://s.org/de/")]
    return [*rows, (140, "http://long.org/" + "seg/" * 5000), (141, "http://hex.org/0a1b2c3d4e/x")]


def test_url_filters(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS template")
    rows = url_filters.judged(pages, URL_RULES).collect()
    assert len(rows) == len(page_rows())
    by = {r.page_id: r for r in rows}
    assert (by[100].host, by[100].path, by[100].rule, by[100].verdict) == ("blog.x.net", "/en/0", "net/", "block")
    assert by[110].rule is None and by[111].rule == "net/" and by[123].rule == "example.net/en/"
    assert all((by[k].host, by[k].path, by[k].verdict) == ("", "", "allow") for k in (120, 121, 122))
    assert (by[124].host, by[124].path) == ("h", "") and by[130].verdict == "allow" and by[130].rule == "org/fr/"
    # The blocked branch is told apart from its clean sibling.
    assert by[1].template == "/de/#.html" and by[0].template == "/en/#.html"
    assert by[1].verdict == "block" and by[0].verdict == "allow"
    assert by[141].path == "/0a1b2c3d4e/x" and "{hex}" in by[141].template
    assert url_filters.judged(pages.limit(0), URL_RULES).collect() == []


def test_own_labels_reject_a_template(spark):
    rows = [(i, f"http://h.org/spam/{i}", "block" if i < 30 else None) for i in range(60)]
    rows += [(100 + i, f"http://h.org/news/{i}", "allow" if i < 30 else None) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label string")
    found = {r.page_id: r.verdict for r in url_filters.judged(pages, [], label="label").collect()}
    assert {found[i] for i in range(60)} == {"block"} and {found[100 + i] for i in range(60)} == {"allow"}


def test_alike_branches_merge(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/user{'abcdefghij'[i % 10]}/post") for i in range(50)], "page_id bigint, url string")
    assert {r.template for r in url_filters.judged(pages, []).collect()} == {"/*/post"}


def labelled_verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label string")
    return {r.page_id: (r.verdict, r.template) for r in url_filters.judged(pages, [], label="label").collect()}


def test_sparse_labels_tell_branches_apart(spark):
    rows = [(i, f"http://h.org/spam/{i}", "block" if i % 10 == 0 else None) for i in range(500)]
    rows += [(1000 + i, f"http://h.org/clean/{i}", "allow" if i % 10 == 0 else None) for i in range(500)]
    found = labelled_verdicts(spark, rows)
    assert {found[i][0] for i in range(500)} == {"block"} and {found[1000 + i][0] for i in range(500)} == {"allow"}


def test_thin_branches_do_not_inherit_labels(spark):
    rows = [(i, f"http://h.org/de/{i}", "block") for i in range(6)] + [(10 + i, f"http://h.org/en/{i}", None) for i in range(3)]
    rows += [(20 + i, f"http://g.org/a/{i}", "block") for i in range(2)] + [(30 + i, f"http://g.org/b/{i}", "allow") for i in range(2)]
    found = labelled_verdicts(spark, rows)
    assert {found[10 + i][0] for i in range(3)} == {"allow"} and found[0] == ("block", "/de/#")
    assert found[20][1] == "/a/#" and found[30][1] == "/b/#"


def test_deep_paths_keep_their_levels(spark):
    deep = "a/" * 9
    rows = [(i, f"http://h.org/{deep}spam/{i}/x", "block") for i in range(30)]
    rows += [(100 + i, f"http://h.org/{deep}news/{i}/x", "allow" if i < 15 else None) for i in range(30)]
    found = labelled_verdicts(spark, rows)
    assert found[0] == ("block", f"/{deep}spam/#/x") and found[129] == ("allow", f"/{deep}news/#/x")


@pytest.mark.parametrize("clean", [1, 3])
def test_thin_hosts_keep_their_clean_pages(spark, clean):
    """Six pages that a rule blocks say nothing about the next directory of the host, in the registered rules and in SQL."""
    import duckdb

    from revwatch.llm.oracle import ORACLE

    rows = [(i, f"http://a.example.com/de/{i}") for i in range(6)] + [(50 + i, f"http://a.example.com/en/{i}") for i in range(clean)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: r.verdict for r in url_filters.judged(pages, URL_RULES).collect()}
    assert found == {i: "block" for i in range(6)} | {50 + i: "allow" for i in range(clean)}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    rows = con.execute(f"SELECT page_id, verdict FROM ({ORACLE['op1_url_filters']})").fetchall()
    assert dict(rows) == found


def test_a_template_of_blocked_pages_blocks_the_unruled_ones(spark):
    """Labels of a rule inside a template that it does not decide as a whole: the tree blocks pages that no rule fits."""
    rules = [url_filters.Rule("block", "spam.org", f"/offers/{c}") for c in "abcdefgh"]
    names = [f"{c}{d}x" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = [(i, f"http://spam.org/offers/{n}") for i, n in enumerate(names)]
    rows += [(500 + i, f"http://spam.org/blog/{n}") for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filters.judged(pages, rules).collect()}
    unruled = [i for i in range(100) if found[i][0] is None]
    assert len(unruled) == 20 and all(found[i][1] == "block" for i in unruled)
    assert all(found[500 + i] == (None, "allow") for i in range(100))


def test_deep_paths_that_part_at_every_level_end_soon(spark):
    """Without enough blocked urls to reject anything, a pair of paths is not followed through hundreds of levels."""
    deep = ["/".join(f"{x}{'abcdefgh'[k % 8]}" for k in range(400)) for x in "xy"]
    rows = [(1, f"http://deep.org/{deep[0]}"), (2, f"http://deep.org/{deep[1]}"), (3, "http://deep.org/x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r.page_id: (r.verdict, r.template) for r in url_filters.judged(pages, []).collect()}
    assert {v for v, _ in found.values()} == {"allow"}
    assert url_filters.LEAST_BLOCKED == 6 and len(found[1][1].split("/")) == 401
