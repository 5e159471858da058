import brute
import corpus_pipeline
import numpy as np
from test_dedup import expected_groups
from test_tokens import NAMES, check_packing, library_ids

from revwatch.llm import language


def test_stages_against_plain_python(spark, sf_dir):
    """Each stage on the input it got, and the next one on what it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(left["language_id"]) == sorted(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    kept = [(d, t) for (d, t), g in zip(left["language_id"], expected_groups(left["language_id"]), strict=True) if g[3]]
    assert sorted(left["exact_dedup"]) == sorted(kept)
    groups = brute.components([(d, brute.fingerprint(t)) for d, t in left["exact_dedup"]])
    kept = [(d, t) for (d, t), c in zip(left["exact_dedup"], groups, strict=True) if d == c]
    assert sorted(left["simhash_near_dedup"]) == sorted(kept)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    near = left["simhash_near_dedup"]
    kept = [r for r, c in zip(near, brute.contamination(near, items), strict=True) if not c[4]]
    assert sorted(left["benchmark_decontamination"]) == sorted(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    expected = {d: [[*library_ids(NAMES[0], t), 0]] for d, t in left["benchmark_decontamination"]}
    check_packing(packed, expected, 2048)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_no_documents(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_languages_are_learnt_outside_the_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert np.isin(list(language.learnt(docs)), ["en", "de", "fr", "es"]).all()
