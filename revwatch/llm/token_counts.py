"""Exact length histogram: documents by encoded length, and for every context limit what it holds and what it cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revwatch.llm.store import written
from revwatch.llm.tokens import encode_rows

BAND = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str, text: str = "text", end_ids: int = 0) -> DataFrame:
    """One row per distinct length and input split: (n_tokens, n_docs), with null texts as empty ones and every repeated row counted.

    Counting inside the split keeps a length that many documents share to one row per split before the shuffle.
    """

    def count(batches):
        totals = {}
        for batch in batches:
            for _, _, _, counts in encode_rows(batch.column(0), vocabulary):
                for n, docs_of in zip(*(x.tolist() for x in np.unique(counts + end_ids, return_counts=True)), strict=True):
                    totals[n] = totals.get(n, 0) + docs_of
        yield pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.int64()), pa.array(totals.values(), pa.int64())], ["n_tokens", "n_docs"]
        )

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "n_tokens bigint, n_docs bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From rows (n_tokens, n_docs) to one row per distinct length with sums over the shorter and the longer documents.

    The suffix sums run inside bands of ``BAND`` lengths and carry the totals of the longer bands, so no task sees more
    than one band, however long the longest document. An empty table gives no rows.

    * ``docs_within`` and ``tokens_within``: documents of at most this length and their tokens;
    * ``docs_over`` and ``tokens_over``: documents that are longer, and their tokens;
    * ``tokens_kept``: all tokens left when every document is cut to this length, ``tokens_cut`` the rest;
    * ``quantile_from`` and ``quantile_to``: the length is the exact quantile of every share in (from, to].
    """
    histogram = lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    histogram = written(histogram.withColumn("band", F.expr(f"n_tokens div {BAND}")), "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    bands = histogram.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum(tokens).alias("band_tokens"))
    # One row per thousand lengths: the whole window holds max(length) / BAND rows.
    beyond = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        "band",
        F.coalesce(F.sum("band_docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("band_tokens").over(beyond), F.lit(0)).alias("tokens_beyond"),
        F.sum("band_docs").over(Window.partitionBy()).alias("all_docs"),
        F.sum("band_tokens").over(Window.partitionBy()).alias("all_tokens"),
    )
    longer = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = histogram.join(bands, "band").select(
        "n_tokens",
        "n_docs",
        tokens.alias("n_tokens_total"),
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_beyond")).alias("docs_over"),
        (F.coalesce(F.sum(tokens).over(longer), F.lit(0)) + F.col("tokens_beyond")).alias("tokens_over"),
        "all_docs",
        "all_tokens",
    )
    kept = F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return out.select(
        "n_tokens",
        "n_docs",
        "n_tokens_total",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        "docs_over",
        "tokens_over",
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_cut"),
        ((F.col("all_docs") - F.col("docs_over") - F.col("n_docs")) / F.col("all_docs")).alias("quantile_from"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile_to"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """For any limit, also one that no document has: (docs_over, tokens_kept, tokens_cut) from the histogram alone."""
    over = F.col("n_tokens") > limit
    kept = F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(kept, F.lit(0)).alias("tokens_kept"),
        F.coalesce(F.sum(F.col("n_tokens_total")) - kept, F.lit(0)).alias("tokens_cut"),
    )
