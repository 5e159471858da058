"""Spelling variants: words at one edit from each other, found by dense prefix-suffix tiling, and the form each goes back to.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. With lengths that differ by one
at most, that is so exactly if their common prefix and common suffix together reach the longer length less one. One of the
two must then reach half of that, so words of a length class meet where they share the first or the last half of it; inside
such a group, blocks of words are compared pair by pair as padded code-point matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import partitions, written

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block at most; blocks of long words are smaller.
TILE_WORDS = 1024
#: Code points of a block, and compared code points of one step, at most.
TILE_POINTS, STEP_POINTS = 1 << 20, 1 << 22


def slips(run: Column, doc_id: Column, modulus: int) -> Column:
    """``run``, without one code point where ``modulus`` divides the CRC-32 of ``<doc_id>:<run>``; a null id is empty."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (crc % F.length(run)).cast("int")
    return F.when(crc % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(
        run
    )


def vocabulary(
    docs: DataFrame,
    min_points: int = 5,
    min_count: int = 3,
    modulus: int = 97,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(word, n): distinct runs of Latin letters of whole texts, A-Z lower-cased, with planted slips, and their counts.

    Null texts have no runs. Words of fewer code points or occurrences are left out.
    """
    runs = docs.select(
        F.col(doc_id).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWERED), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    counts = runs.select(slips(F.col("run"), F.col("id"), modulus).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.length("word") >= min_points) & (F.col("n") >= min_count))


def tiles(words: DataFrame) -> DataFrame:
    """(longer, side, key, i, j, block, word, n): every word in every block pair of the groups in which it can be near another.

    ``longer`` is the longer length of the pairs compared there: a word takes part as the longer one and as the shorter
    one. Groups larger than a block are cut by hash, and block ``i`` meets block ``j`` in a row group of its own.
    """
    length = F.length("word")
    places = []
    for longer in (length, length + 1):
        half = (longer / 2).cast("int")
        places.append(F.struct(longer.alias("longer"), F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("key")))
        places.append(
            F.struct(longer.alias("longer"), F.lit(1).alias("side"), F.substring(F.col("word"), length - half + 1, half).alias("key"))
        )
    placed = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("p.*", "word", "n")
    group = ["longer", "side", "key"]
    room = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), (F.lit(TILE_POINTS) / F.col("longer")).cast("int")))
    # A table of its own, so that the join below can split large groups.
    sizes = written(
        placed.groupBy(*group).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        .select(*group, F.ceil(F.col("m") / room).cast("int").alias("blocks")),
        "groups",
    )
    cut = placed.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(
        *group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n"
    )


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def pair_steps(borders: np.ndarray, limit: int):
    """Index arrays (a, b), a < b, of all pairs inside consecutive groups, at most about ``limit`` pairs at once."""
    sizes = np.diff(borders)
    for m in np.unique(sizes[sizes > 1]).tolist():
        starts = borders[:-1][sizes == m]
        if m * (m - 1) // 2 <= limit:
            a, b = np.triu_indices(m, 1)
            step = max(limit // len(a), 1)
            for lo in range(0, len(starts), step):
                own = starts[lo : lo + step, None]
                yield (own + a).ravel(), (own + b).ravel()
            continue
        rows = max(limit // m, 1)
        for start in starts.tolist():
            for lo in range(0, m - 1, rows):
                a = np.repeat(np.arange(lo, min(lo + rows, m)), m)
                b = np.tile(np.arange(m), len(a) // m)
                yield start + a[a < b], start + b[a < b]


def near_in_tiles(words: list[str], n: np.ndarray, longer: np.ndarray, side: np.ndarray, cross: np.ndarray, block: np.ndarray, borders):
    """Per word with near ones in these tiles: its row, how many, and the row of the best (largest n, then smallest word).

    A pair is counted where its longer length is the tile's, and on the suffix side only if the prefixes do not meet already.
    """
    latin = [w.encode("latin-1") for w in words]
    width = max(map(len, latin))
    ahead, back = _padded(latin, width), _padded([w[::-1] for w in latin], width)
    lengths = np.array([len(w) for w in latin])
    near_a, near_b = [], []
    for a, b in pair_steps(borders, max(STEP_POINTS // width, 1)):
        fits = (np.maximum(lengths[a], lengths[b]) == longer[a]) & (~cross[a] | (block[a] != block[b]))
        a, b = a[fits], b[fits]
        prefix = np.argmin(ahead[a] == ahead[b], axis=1)
        suffix = np.argmin(back[a] == back[b], axis=1)
        hit = (prefix + suffix >= longer[a] - 1) & ((side[a] == 0) | (prefix < longer[a] // 2))
        near_a += [a[hit], b[hit]]
        near_b += [b[hit], a[hit]]
    if not near_a:
        return (np.empty(0, np.int64),) * 3
    a, b = np.concatenate(near_a), np.concatenate(near_b)
    rank = np.empty(len(latin), np.int64)
    rank[sorted(range(len(latin)), key=latin.__getitem__)] = np.arange(len(latin))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    return a[first], np.diff(np.append(first, len(a))), b[first]


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): per tile, how many near words a word has there, and the best of them; never pairs."""

    def compare(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            keys, done = borders_of(rest)
            if len(keys) > 2:  # the last tile may go on in the next batch
                yield from emit(rest.slice(0, done), keys[:-1])
                rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield from emit(rest, borders_of(rest)[0])

    def borders_of(table):
        new = np.zeros(table.num_rows + 1, bool)
        new[[0, -1]] = True
        for name in ("longer", "side", "key", "i", "j"):
            codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:-1] |= codes[1:] != codes[:-1]
        keys = np.flatnonzero(new)
        return keys, int(keys[-2])

    def emit(table, keys):
        longer = table.column("longer").to_numpy()
        # Runs of tiles whose padded matrices stay small.
        lo = 0
        while lo < len(keys) - 1:
            hi = lo + 1
            while hi < len(keys) - 1 and (keys[hi + 1] - keys[lo]) * int(longer[keys[lo] : keys[hi + 1]].max()) <= TILE_POINTS:
                hi += 1
            own = table.slice(int(keys[lo]), int(keys[hi] - keys[lo]))
            words, n = own.column("word").to_pylist(), own.column("n").to_numpy()
            i, j, block, side = (own.column(c).to_numpy() for c in ("i", "j", "block", "side"))
            at, near, best = near_in_tiles(words, n, longer[keys[lo] : keys[hi]], side, i != j, block, keys[lo : hi + 1] - keys[lo])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[k] for k in at]), pa.array(near), pa.array(n[best]), pa.array([words[k] for k in best])],
                    ["word", "near", "best_n", "best"],
                )
            lo = hi

    tile = ["longer", "side", "key", "i", "j"]
    # A stated number of partitions: tiles are small and take long, so they are not to be put together by size.
    dealt = tiles(words).repartition(partitions(words.sparkSession), *[F.col(c) for c in tile]).sortWithinPartitions(*tile)
    return dealt.mapInArrow(compare, "word string, near bigint, best_n bigint, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer doubling: a chain of k forms takes about log2(k) joins.

    Counts at least double from a word to its form, so there is no cycle and a chain is no longer than a count has bits.
    """
    current = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = current.join(onward, F.col("root") == F.col("at"), "left")
        after = written(stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        current = after.select("word", "root")


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    A word's form is its near word of the largest count (ties: smallest by code points) if that is ``factor`` times its own
    at least, else null. ``root`` follows the forms to the last one and is the word itself where there is none. An empty
    table gives no rows. Words hold code points up to U+00FF, as ``LETTERS`` finds them.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    )
    grown = F.col("b.less") * -1 >= factor * F.col("n")
    forms = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(grown, F.col("b.best")).alias("form"), F.when(grown, F.col("b.less") * -1).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(forms.filter("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
