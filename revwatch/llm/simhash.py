"""SimHash near-deduplication: word-shingle fingerprints, pigeonhole block joins, and components of the verified links."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import dropped, written
from revwatch.llm.texts import LOWER, SPACE, chunks, spans

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints that one value of a block key should hold on average at most, beyond those of near copies.
PER_BUCKET = 0.25
#: Fingerprints that are compared in one task; a bucket that holds more is cut into pieces, and pairs of pieces are dealt out.
PIECE = 4096


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fingerprint bigint): of the XXH64 values of all word shingles, the bits set in over half.

    A-Z is lower-cased, words are runs without ASCII white space, a shorter text is one shingle, and a text without
    words (null, empty or blank) has fingerprint zero.
    """

    def sketch(batches):
        import xxhash

        one = xxhash.xxh64_intdigest
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2), 1_000_000):
                out = np.zeros(end - first, np.uint64)
                inside = ~SPACE[data]
                starts, ends, per_row = spans(inside, offsets)
                # Words joined by single spaces, so that every shingle is one slice of the buffer.
                sizes = ends - starts + 1
                borders = np.append(0, np.cumsum(sizes))
                joined = np.full(int(borders[-1]), 32, np.uint8)
                fill = np.ones(len(joined), bool)
                fill[borders[1:] - 1] = False
                joined[fill] = LOWER[data[inside]]
                buffer = joined.tobytes()
                shingles = np.where(per_row > 0, np.maximum(per_row - words + 1, 1), 0)
                word = np.append(0, np.cumsum(per_row))
                row = np.repeat(np.arange(len(per_row)), shingles)
                at = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + word[row]
                last = np.minimum(at + words, word[row + 1]) - 1
                a, b = borders[at].tolist(), (borders[last + 1] - 1).tolist()
                hashes = np.array([one(buffer[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64)
                ends_of = np.cumsum(shingles)
                for lo in range(0, len(per_row), 256):
                    hi = min(lo + 256, len(per_row))
                    x, y = int(ends_of[lo] - shingles[lo]), int(ends_of[hi - 1])
                    own = np.flatnonzero(shingles[lo:hi]) + lo
                    if not len(own):
                        continue
                    bits = np.unpackbits(hashes[x:y].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    begins = ends_of[own] - shingles[own] - x
                    sums = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
                    majority = 2 * sums > shingles[own][:, None]
                    out[own] = np.packbits(majority, axis=1).view(">u8").reshape(-1)
                own_rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [own_rows.column(0), own_rows.column(1), pa.array(out.view(np.int64))],
                    ["doc_id", "text_hash", "fingerprint"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint"), text_hash(text), F.col(text).cast("string"))
    return rows.mapInArrow(sketch, "doc_id bigint, text_hash bigint, fingerprint bigint")


def block_tables(count: int, max_bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """How the 64 bits are cut, and which blocks each table joins on.

    Two fingerprints that differ in at most d of k blocks agree on k - d of them, so a table for every choice of k - d
    blocks misses no pair. More blocks make longer keys: k is the least for which a chance partner in a bucket is rare
    among ``count`` fingerprints.
    """
    for blocks in range(max_bits + 1, 17):
        borders = [64 * i // blocks for i in range(blocks + 1)]
        cuts = [(a, b - a) for a, b in zip(borders, borders[1:], strict=False)]
        keep = blocks - max_bits
        bits = sum(sorted(n for _, n in cuts)[:keep])
        if count / 2**bits <= PER_BUCKET or blocks == max_bits + 5:
            break
    return cuts, list(combinations(range(blocks), keep))


def bucket_links(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside buckets: rows sorted by key. Buckets of two are compared at once, larger ones row against block.

    A bucket gives a spanning forest of its links, so its output is linear in its size: a row is linked to the first
    row of every component that it touches.
    """
    borders = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(borders, len(keys)))
    two = borders[sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits
    out = [(prints[two][near], prints[two + 1][near])]
    for start, size in zip(borders[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = np.unique(prints[start : start + size])
        root = np.arange(len(own))
        for i in range(1, len(own)):
            hit = np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= max_bits)
            if len(hit):
                roots = np.unique(root[hit])
                out.append((own[roots], np.full(len(roots), own[i])))
                root[: i + 1][np.isin(root[: i + 1], roots)] = roots[0]
                root[i] = roots[0]
    return out


def links(distinct_prints: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within ``max_bits``."""
    cuts, tables = block_tables(count, max_bits)
    print_col = F.col("fingerprint")
    keys = []
    for number, table in enumerate(tables):
        key = F.lit(0).cast("bigint")
        for block in table:
            start, width = cuts[block]
            part = F.shiftrightunsigned(print_col, start).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(F.struct(F.lit(number).cast("byte").alias("no"), key.alias("key")))
    rows = distinct_prints.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("k.no", "k.key", "fingerprint")

    def compare(batches):
        kind = [("no", "i1"), ("key", "i8")]
        rest_keys, rest, large = np.empty(0, kind), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.empty(batch.num_rows, kind)
            keys["no"] = batch.column(0).to_numpy(zero_copy_only=False)
            keys["key"] = batch.column(1).to_numpy(zero_copy_only=False)
            prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, prints = np.concatenate([rest_keys, keys]), np.concatenate([rest, prints])
            if not len(keys):
                continue
            if large is not None:  # what follows of a bucket that was too large
                own = keys == large
                yield from later(keys[own], prints[own])
                keys, prints = keys[~own], prints[~own]
            # The last bucket may go on in the next batch.
            done = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
            yield from buckets(keys[:done], prints[:done])
            rest_keys, rest = keys[done:], prints[done:]
            if len(rest) > PIECE:
                large = rest_keys[0]
                yield from later(rest_keys, rest)
                rest_keys, rest = rest_keys[:0], rest[:0]
        yield from buckets(rest_keys, rest)

    def buckets(keys, prints):
        borders = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
        small = np.repeat(np.diff(borders) <= PIECE, np.diff(borders))
        yield from later(keys[~small], prints[~small])
        found = bucket_links(keys[small], prints[small], max_bits)
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        if len(a):
            none = [pa.nulls(len(a), pa.int8()), pa.nulls(len(a), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["no", "key", "a", "b"])

    def later(keys, prints):
        if len(keys):
            columns = [pa.array(keys["no"].copy()), pa.array(keys["key"].copy()), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(keys), pa.int64())], ["no", "key", "a", "b"])

    sorted_rows = rows.repartition(F.col("no"), F.col("key")).sortWithinPartitions("no", "key")
    found = written(sorted_rows.mapInArrow(compare, "no tinyint, key bigint, a bigint, b bigint"), "bucket-links")
    large = found.filter("b IS NULL").select("no", "key", F.col("a").alias("fingerprint"))
    return found.filter("b IS NOT NULL").select("a", "b").unionByName(piece_links(large, max_bits)).distinct()


def piece_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links inside large buckets (no, key, fingerprint), which are cut by hash; every pair of pieces is a task's work
    and gives a spanning forest of the links between its two pieces."""
    sizes = written(buckets.groupBy("no", "key").agg(F.count(F.lit(1)).alias("m")), "bucket-sizes")
    cut = buckets.join(sizes.withColumn("pieces", F.ceil(F.col("m") / PIECE)), ["no", "key"])
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("fingerprint"), "pieces"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    pairs = met.select("no", "key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "fingerprint")

    def compare(key, table):
        prints, first = np.unique(table.column("fingerprint").to_numpy().view(np.uint64), return_index=True)
        piece = table.column("piece").to_numpy()[first]
        cross = key[2].as_py() != key[3].as_py()
        free, edges = np.ones(len(prints), bool), []
        while free.any():  # breadth first: one link per fingerprint at most
            queue = [int(np.argmax(free))]
            free[queue[0]] = False
            for x in queue:
                among = np.flatnonzero(free & (piece != piece[x])) if cross else np.flatnonzero(free)
                hit = among[np.bitwise_count(prints[among] ^ prints[x]) <= max_bits]
                free[hit] = False
                edges += [(prints[x], prints[y]) for y in hit]
                queue += hit.tolist()
        ends = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.Table.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    return pairs.groupBy("no", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components, root being the smallest node, by large and small stars on written tables.

    Every round hangs each node below the smallest one among its neighbours; rounds grow with the logarithm of the
    longest chain. A star's centre spreads over the rows of its leaves, so no list of neighbours is ever collected. The
    smallest neighbours are a written table, so a join meets them by a plain exchange of both sides, and adaptive execution
    splits the rows of a centre that has many.
    """
    current = written(edges.select("a", "b"), "edges")
    before = None
    while True:
        # Large star: neighbours above a node move to the node's smallest neighbour.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct(), "edges")
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for used in (least, large, lower):
            dropped(used)
        sums = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        state = after.agg(sums).head()[0]
        if state == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        dropped(current)
        current, before = after, state


def _linked(docs: DataFrame, words: int, max_bits: int, text: str, doc_id: str) -> DataFrame:
    """Per row (doc_id, text_hash, fingerprint, root, component_id), root being a fingerprint of the component."""
    prints = written(fingerprints(docs, words, text, doc_id), "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(classes.select("fingerprint"), classes.count(), max_bits))
    named = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(named.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_groups(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Fingerprints that differ in at most ``max_bits`` bits are linked; a component is what links reach, named by the
    smallest doc_id in it. Equal fingerprints (copies, and all texts without words) are one node of the links, so their
    pairs are never made. A null id takes part and has its component; an empty table gives no rows.
    """
    return _linked(docs, words, max_bits, text, doc_id).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Of every component the document with the smallest id (null last), with its own columns.

    Of texts that share this id, the one with the smaller hash stays; rows alike in id and text are one document, and all
    of them stay.
    """
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash"))
    best = _linked(docs, words, max_bits, text, doc_id).groupBy("root").agg(F.min(order).alias("best"))
    # One row per component, so the semi-join adds no rows.
    keep = best.select(F.col("best.id").alias("_kept"), F.col("best.text_hash").alias("_kept_hash"))
    same = F.col(doc_id).eqNullSafe(F.col("_kept")) & (text_hash(text) == F.col("_kept_hash"))
    return docs.join(keep, same, "left_semi")
