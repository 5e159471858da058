"""Embedding whitening on MLlib block matrices: scatter by transpose and multiply, a local eigenproblem, projection by multiply.

Entries are put on an integer grid first, so means and deviations are exact whatever the order of summation.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import written

GRID = 64
SHIFT = 1_000_000
#: Rows and columns of a block; the rows of a block of b columns hold 8 * b bytes each.
BLOCK_ROWS, BLOCK_COLS = 4096, 1024
#: Blocks of the centred matrix whose products are added up in one task.
SPLIT_BLOCKS = 4
#: Eigenvalues below this share of the largest one are rounding noise: their components do not exist.
NOISE = 1e-12
#: Entries beyond this size have no exact integer on the grid.
LARGEST = 2.0**40

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def on_grid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, f): floor(64 * entry) of every usable vector; x of the contract is f + 1,000,000 in every entry.

    Vectors that are null, or hold a null, non-finite or larger entry than ``LARGEST``, are left out, and so are those
    that do not have the most frequent number of entries (ties: the larger number).
    """
    entries = F.col(embedding).cast("array<double>")
    usable = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is larger than any number
    f = F.transform(entries, lambda c: F.floor(c * GRID).cast("bigint"))
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(usable, f).alias("f")).filter("f IS NOT NULL")


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once, with a gapless ``index`` from 0: offsets of the written splits are one row per split."""
    numbered = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    split = F.shiftright("_at", 33)
    counts = numbered.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("k")).orderBy("_split").collect()
    before, offsets = 0, []
    for row in counts:
        offsets.append((row["_split"], before))
        before += row["k"]
    starts = rows.sparkSession.createDataFrame(offsets, "_split bigint, _before bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return numbered.withColumn("_split", split).join(F.broadcast(starts), "_split").withColumn("index", place).drop("_at", "_split", "_before")


def block_matrix(rows: DataFrame, values: str, count: int, columns: int) -> BlockMatrix:
    """The array column ``values`` of (index, values) as a distributed matrix of ``count`` rows."""
    vectors = rows.select("index", array_to_vector(F.col(values)).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(vectors, count, columns).toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLS, max(columns, 1)))


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, the sums over the inner dimension split so often; partial products are added block by block."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def covariance(rows: DataFrame, values: str, count: int, columns: int) -> np.ndarray:
    """Covariance (divisor ``count``) of rows that are centred already; columns squared is what reaches the driver."""
    matrix = block_matrix(rows, values, count, columns)
    splits = -(-count // (BLOCK_ROWS * SPLIT_BLOCKS))
    scatter = product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    return (scatter + scatter.T) / (2 * count)


def column_sums(rows: DataFrame, values: str) -> list:
    """The sum of every entry over all rows, in order."""
    entries = rows.select(F.posexplode(values).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"))
    return [row["s"] for row in entries.orderBy("k").collect()]


def fitted(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitening matrix (entries x components) and explained shares, by falling eigenvalue; those without variance are left out."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > NOISE * max(values[0], 0.0) * len(values)).sum()) if len(values) and values[0] > 0 else 0
    k = min(components, real)
    return vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def projected(rows: DataFrame, values: str, count: int, whitening: np.ndarray) -> DataFrame:
    """(index, y): the rows times the whitening matrix."""
    spark = rows.sparkSession
    columns, components = whitening.shape
    local = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(whitening)], "index bigint, w array<double>")
    left = block_matrix(rows, values, count, columns)
    right = IndexedRowMatrix(
        MLUtils.convertVectorColumnsFromML(local.select("index", array_to_vector("w").alias("vector")), "vector"), columns, components
    ).toBlockMatrix(left.colsPerBlock, components)
    result = product(left, right, 1).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", result._java_matrix_wrapper._java_model)
    return frame.select("index", vector_to_array("vector").alias("y"))


def whitened(
    vectors: DataFrame, components: int = 16, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: the columns of ``SCHEMA``.

    The fit sees every distinct grid vector once, the projection every usable row, repeated rows and null ids included.
    ``deviation`` is the sum over entries of (n * x - S) squared; it is null where it does not fit a long.
    ``identity_error`` is the largest absolute entry of the whitened fit rows' covariance less the identity. Fewer
    components than asked for are returned where the distinct vectors span no more; none, so no rows, if the table has
    no usable vector or only equal ones.
    """
    spark = vectors.sparkSession
    grid = written(on_grid(vectors, vec_id, embedding), "grid")
    sizes = grid.groupBy(F.size("f").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if sizes is None or sizes["d"] == 0:
        return spark.createDataFrame([], SCHEMA)
    columns = sizes["d"]
    grid = grid.filter(F.size("f") == columns)
    fit = indexed(grid.select("f").distinct(), "fit")
    n = fit.count()
    sums = column_sums(fit, "f")
    totals = F.array(*[F.lit(int(s)) for s in sums])
    centred = F.zip_with("f", totals, lambda f, s: f.cast("double") - s / F.lit(n))
    fit = fit.select("index", centred.alias("c"))
    whitening, explained = fitted(covariance(fit, "c", n, columns), components)
    kept = whitening.shape[1]
    if not kept:
        return spark.createDataFrame([], SCHEMA)

    seen = written(projected(fit, "c", n, whitening), "whitened-fit")
    means = F.array(*[F.lit(s / n) for s in column_sums(seen, "y")])
    again = seen.select("index", F.zip_with("y", means, lambda y, m: y - m).alias("y"))
    error = float(np.abs(covariance(again, "y", n, kept) - np.eye(kept)).max())

    squares = F.zip_with("f", totals, lambda f, s: F.try_subtract(F.try_multiply(F.lit(n), f), s))
    deviation = F.aggregate(squares, F.lit(0).cast("bigint"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    rows = indexed(grid, "rows")
    count = rows.count()
    values = projected(rows.select("index", centred.alias("c")), "c", count, whitening)
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return (
        rows.select("index", "vec_id", deviation.alias("deviation"))
        .join(values, "index")
        .select("vec_id", "deviation", F.posexplode(F.arrays_zip("y", shares.alias("e"))).alias("k", "p"))
        .select(
            "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
            F.col("p.y").alias("whitened"), F.col("p.e").alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
