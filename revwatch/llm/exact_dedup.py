"""Exact deduplication: equal texts are combined locally, by salted digest, and globally, each time on full content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import written

SALTS = 8


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def winners(
    docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column], salts: int = SALTS
) -> DataFrame:
    """One row per distinct text: (_digest, _text, keep_id, group_size).

    Rows are grouped by digest *and* text, so two texts that share a digest are never mixed. The map side combines the
    copies of a split, the salt deals the rest of a hot text over several tasks, and the last step joins at most
    ``salts`` rows per text. A row without an id counts, but stays only where no copy has one.
    """
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.col(doc_id).alias("_id"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    salted = rows.groupBy("_digest", "_text", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")).agg(
        F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    texts = salted.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return texts


def exact_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256_of,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical as they stand; null counts as empty. Of equal texts the row with the largest id
    stays; rows that share text *and* id are all marked kept, and ``distinct_documents`` leaves one of them. A digest
    that two texts share (none is known for SHA-256) is resolved by joining those rows on their text as well. An empty
    table gives no rows; other columns, whatever their names, are not looked at.
    """
    groups = winners(docs, text, doc_id, digest, salts)
    # Copies of a digest with a single text need no further look at the text: the grouping above has compared it.
    narrow = written(
        groups.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "digests",
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))
    keyed = rows.select("doc_id", "_digest", sha256_of(F.col("_text")).alias("text_sha256"))
    out = keyed.join(narrow.filter("_texts = 1").drop("_texts"), "_digest")
    if narrow.filter("_texts > 1").head() is not None:
        shared = narrow.filter("_texts > 1").select("_digest")
        by_text = groups.join(shared, "_digest", "left_semi")
        again = rows.join(by_text, ["_digest", "_text"])
        out = out.unionByName(
            again.select("_digest", "doc_id", sha256_of(F.col("_text")).alias("text_sha256"), "keep_id", "group_size")
        )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def distinct_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256_of,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that share text and id, one stays.

    The whole row travels through the same three combining steps as a struct beside its text.
    """
    names = docs.columns
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in names if c != text)).alias("_row")
    # A null text and an empty one are copies of each other; the flag brings back which the winner was.
    rows = docs.select(
        body.alias("_text"), F.col(doc_id).alias("_id"), F.col(text).isNull().alias("_null"), rest
    ).withColumn("_digest", digest(F.col("_text")))
    order = F.struct("_id", "_null")
    salted = rows.groupBy("_digest", "_text", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")).agg(
        F.max_by(F.struct("_id", "_null", "_row"), order).alias("_best")
    )
    best = salted.groupBy("_digest", "_text").agg(F.max_by("_best", F.struct("_best._id", "_best._null")).alias("_best"))
    value = F.when(~F.col("_best._null"), F.col("_text"))
    return best.select(
        *(value.cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"_best._row.`{c}`").alias(c) for c in names)
    )
