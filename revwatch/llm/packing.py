"""Sum-of-squares packing of documents into fixed-length training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import written
from revwatch.llm.tokens import encode_rows

GROUP_PIECES = 10_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per piece of every document's ids, the end id included: (doc_id, piece, start, length, ids_crc32).

    A document of more than ``size`` ids is cut into pieces of ``size``, of which the first may be shorter; a null text
    is an empty one, so its only piece holds the end id. The ids themselves never leave the task.
    """

    def cut(batches):
        import zlib

        for batch in batches:
            keys = batch.column(0)
            for first, end, ids, counts in encode_rows(batch.column(1), vocabulary):
                rows = end - first
                total = counts + 1
                full = np.zeros(int(total.sum()), "<u4")
                ends = np.cumsum(total)
                is_text = np.ones(len(full), bool)
                is_text[ends - 1] = False
                full[is_text] = ids
                full[ends - 1] = end_id
                pieces = -(-total // size)
                row = np.repeat(np.arange(rows), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first_length = total - (pieces - 1) * size
                length = np.where(number == 0, first_length[row], size)
                start = np.where(number == 0, 0, first_length[row] + (number - 1) * size)
                at = (ends - total)[row] + start
                view = memoryview(full.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row + first)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, placed one by one where the squared counts of open bins per gap sum to least.

    The order is part of the method: pieces of at least a sixth of a bin from long to short, then the small ones as they
    come, which fill the gaps that are left. Ties go to the smallest gap, and to an open bin before a new one.
    """
    large = np.flatnonzero(lengths >= size / 6)
    order = np.concatenate([large[np.argsort(-lengths[large], kind="stable")], np.flatnonzero(lengths < size / 6)])
    count = np.zeros(size + 1, np.int64)
    open_bins = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i in order.tolist():
        s = int(lengths[i])
        at, cost = -1, never
        if s < size:
            there = count[s:size]
            change = np.where(there > 0, 2 * (count[: size - s] - there) + 2, never)
            if there[0] > 0:
                change[0] = 1 - 2 * there[0]  # the bin is full and no longer open
            at = int(change.argmin())
            cost = change[at]
        if s < size and cost <= 2 * count[size - s] + 1:
            gap = s + at
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds (sequence_id, offset) to the rows of ``cut_documents``.

    Full pieces are sequences of their own. The others are dealt at random into groups of about ``group_pieces``, whose
    number grows with the input; each group is packed by itself and wastes a few bins at most. Sequence numbers are
    unique, gaps in them are not meaningful, and offsets in a sequence have no gap. An empty table gives no rows.
    """
    keyed = written(pieces.withColumn("_slot", F.monotonically_increasing_id()), "pieces")
    short = keyed.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group_pieces))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slot")
        bins, offsets = sum_of_squares(table["length"].to_numpy(), size)
        group = table["_group"][0].as_py()
        return pa.table(
            {name: table[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            | {"sequence_id": pa.array(bins + (group << 32)), "offset": pa.array(offsets)}
        )

    schema = PIECES + ", sequence_id bigint, offset bigint"
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_slot"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(place, schema)
    # Sequences of one full piece are numbered below zero.
    whole = keyed.filter(F.col("length") >= size).select(
        *(c.split()[0] for c in PIECES.split(", ")),
        (-1 - F.col("_slot")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(whole)
