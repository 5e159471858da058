"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by adaptive multi-match prefixes.

Shingles have one order for all documents: rare ones first. If two sets share t shingles, then the first (size - t + l) of
either share l of them at least. Every document posts the prefix for l = 1, by which pairs meet, and carries a prefix that is
lengthened by l - 1 shingles where its shingles are common and candidates therefore costly. A pair becomes a candidate only
if it shares as many shingles of these as its two prefixes demand for its own t, and then the whole sets are compared.

A shingle is a 64-bit hash of its words' 64-bit hashes; two documents of a thousand shingles meet a wrong one with
probability 1e-13. Sets are told apart by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.llm.simhash import components
from revwatch.llm.store import dropped, partitions, written
from revwatch.llm.texts import LOWER, SPACE, chunks, distinct, flat, gather
from revwatch.llm.texts import words as split_words

SHINGLE_WORDS = 5
#: Two sets are linked if DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Shingles with a known count that every worker holds at most: 12 bytes each.
KNOWN = 1 << 19
#: Shingles counted together; one that occurs less than twice in every such window counts as rare.
WINDOW = 1 << 20
#: Posting lists up to LIGHT give all their pairs; lists known to be longer than HEAVY are split into tiles at once.
LIGHT, HEAVY = 64, 1024
#: Documents of a block of a tile, on average.
TILE = 2048
#: Bytes of text that are cut into shingles at once.
CHUNK_BYTES = 1_000_000
#: Lengthenings that are weighed for a document.
LENGTHS = (1, 2, 4, 8)
#: Bits of a document's parity sketch: four times its shingles, within these bounds.
LEAST_BITS, MOST_BITS = 512, 4096
#: Documents whose keys may be broadcast to find them again: some 40 bytes each.
BROADCAST_ROWS = 500_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, ascending in each, and borders (one more than rows); fewer words are one shingle."""
    import xxhash

    column, per_row = split_words(LOWER[data], offsets, ~SPACE[data])
    codes, kinds = distinct(column)
    own = np.array([xxhash.xxh64_intdigest(k) for k in kinds], np.uint64)
    many = np.where(per_row > 0, np.maximum(per_row - words + 1, 1), 0)
    at = gather(np.cumsum(per_row) - per_row, many)
    span = np.repeat(np.minimum(per_row, words), many)
    total = span.astype(np.uint64) * _STEP
    if len(at):
        hashes = own[codes]
        for k in range(words):
            factor = mixed(np.array([k + 1], np.uint64) * _STEP) | np.uint64(1)
            total += hashes[np.minimum(at + k, len(hashes) - 1)] * np.where(k < span, factor, np.uint64(0))
        total = mixed(total)
    ends = np.append(0, np.cumsum(many))
    sets = [np.unique(total[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else total), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def digests(sets: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, as two columns; zero for an empty one."""
    out = np.zeros((2, len(borders) - 1), np.uint64)
    full = np.flatnonzero(np.diff(borders))
    if len(full):
        out[0, full] = np.add.reduceat(mixed(sets), borders[full])
        out[1, full] = np.add.reduceat(mixed(sets ^ _STEP), borders[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def batch_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, sets, borders) of the (id, text) rows of a batch, a chunk of text at a time."""
    for first, end, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
        yield batch.column(0).slice(first, end - first), *shingle_sets(data, offsets, words)


def needed(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of a set of this size with any partner."""
    return -(-num * sizes // den)


def overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of linked sets of these two sizes."""
    return -(-num * (a + b) // (num + den))


def summaries(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, hi, lo, n) of all documents, and rows (shingle, seen) of shingles that repeat within a window."""

    def run(batches):
        window, held = [], 0
        for batch in batches:
            for ids, sets, borders in batch_sets(batch, words):
                hi, lo = digests(sets, borders)
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(hi), pa.array(lo), pa.array(np.diff(borders)), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    ["doc_id", "hi", "lo", "n", "shingle", "seen"],
                )
                window.append(sets)
                held += len(sets)
                if held >= WINDOW:
                    yield repeats(window)
                    window, held = [], 0
        if window:
            yield repeats(window)

    def repeats(window):
        values, counts = np.unique(np.concatenate(window), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(values.view(np.int64)), pa.array(counts)],
            ["doc_id", "hi", "lo", "n", "shingle", "seen"],
        )

    return docs.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint, n bigint, shingle bigint, seen bigint")


def common_shingles(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (at most ``KNOWN``, ascending) and their counts; all others count as rare.

    They only set the order and the costs, so results do not depend on them.
    """
    counts = written(summary.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("c")), "counts")
    level = F.floor(F.log2("c")).cast("int").alias("level")
    least, total = 64, 0
    for row in counts.groupBy(level).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > KNOWN:
            break
        least = row["level"]
    table = counts.filter(F.col("c") >= F.lit(2**least if least < 63 else 2**62)).toArrow()
    keys = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    dropped(counts)
    return keys[order], np.minimum(table.column("c").to_numpy()[order], 2**31 - 1).astype(np.int32)


def lengthening(costs: np.ndarray, size: int, base: int, most: int) -> int:
    """How many matches to ask of a document: the l that makes scanning and verifying its candidates cheapest.

    ``costs`` are the counts of its shingles in order; the documents met at the first ``base`` of them are the candidates.
    A longer prefix is carried and compared, but only about one candidate in l has l matches.
    """
    met = int((costs[:base] - 1).sum())
    options = [k for k in LENGTHS if k <= most]
    work = [(base + k - 1) * (1 + met / 16) + met * size / k + float(costs[base : base + k - 1].sum()) for k in options]
    return options[int(np.argmin(work))]


def prefixes(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], words: int, num: int, den: int) -> DataFrame:
    """(doc_id, hi, lo, n, posted, counts, marks, sketch): the prefix that is posted, with known counts, and compact forms.

    ``marks`` are 16 bits of every shingle of the lengthened prefix. ``sketch`` has the parity of the whole set per bucket of
    hashes: sets that differ in d shingles differ in d bits at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        keys, seen = shared.value
        for batch in batches:
            for ids, sets, borders in batch_sets(batch, words):
                costs = np.ones(len(sets), np.int64)
                if len(keys) and len(sets):
                    at = np.minimum(np.searchsorted(keys, sets), len(keys) - 1)
                    costs = np.where(keys[at] == sets, seen[at], 1).astype(np.int64)
                hi, lo = digests(sets, borders)
                sizes = np.diff(borders)
                posted, known_counts, marks, sketches = [], [], [], []
                for size, a, b in zip(sizes.tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    own, cost = sets[a:b], costs[a:b]
                    order = np.argsort(cost, kind="stable")
                    most = -(-num * size // den)
                    base = size - most + 1
                    q = base - 1 + lengthening(cost[order], size, base, most) if size else 0
                    posted.append(own[order[: min(base, size)]].view(np.int64))
                    known_counts.append(cost[order[: min(base, size)]].astype(np.int32))
                    marks.append((own[order[:q]] >> np.uint64(48)).astype(np.uint16).tobytes())
                    bits = min(max(4 << max(size - 1, 1).bit_length(), LEAST_BITS), MOST_BITS)
                    buckets = (own % np.uint64(bits)).astype(np.int64)
                    sketches.append(np.packbits(np.bincount(buckets, minlength=bits) & 1).tobytes())
                ends = np.append(0, np.cumsum([len(p) for p in posted])).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))
                    for parts, kind in ((posted, np.int64), (known_counts, np.int32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(hi), pa.array(lo), pa.array(sizes), *lists, pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "hi", "lo", "n", "posted", "counts", "marks", "sketch"],
                )

    return docs.mapInArrow(
        run,
        "doc_id bigint, hi bigint, lo bigint, n bigint, posted array<bigint>, counts array<int>, marks binary, sketch binary",
    )


def light_matches(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Of postings (shingle, node, n, at): rows (a, b) of short lists, for every pair that meets inside its own prefixes,
    and rows (shingle, a) of longer lists."""
    names = ["shingle", "a", "b"]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [table.column(c).to_numpy() for c in ("shingle", "node", "n", "at")]
            rest = columns if rest is None else [np.concatenate(p) for p in zip(rest, columns, strict=True)]
            change = np.flatnonzero(rest[0][1:] != rest[0][:-1]) + 1
            if len(change):
                yield from emit([c[: change[-1]] for c in rest])
                rest = [c[change[-1] :] for c in rest]
        if rest is not None:
            yield from emit(rest)

    def emit(columns):
        shingle, node, n, at = columns
        borders = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
        sizes = np.diff(borders)
        for m in np.unique(sizes[(sizes > 1) & (sizes <= LIGHT)]).tolist():
            x, y = np.triu_indices(m, 1)
            starts = borders[:-1][sizes == m]
            step = max((1 << 18) // len(x), 1)
            for lo in range(0, len(starts), step):
                a = (starts[lo : lo + step, None] + x).ravel()
                b = (starts[lo : lo + step, None] + y).ravel()
                t = overlap(n[a], n[b], num, den)
                fits = (t <= np.minimum(n[a], n[b])) & (node[a] != node[b])
                fits &= (at[a] <= n[a] - t + 1) & (at[b] <= n[b] - t + 1)
                pairs = np.unique(np.stack([np.minimum(node[a], node[b])[fits], np.maximum(node[a], node[b])[fits]]), axis=1)
                if pairs.shape[1]:
                    none = pa.nulls(pairs.shape[1], pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array(pairs[0]), pa.array(pairs[1])], names)
        long = np.repeat(sizes > LIGHT, sizes)
        if long.any():
            none = pa.nulls(int(long.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shingle[long]), pa.array(node[long]), none], names)

    width = partitions(postings.sparkSession)
    dealt = postings.repartition(width, F.col("shingle")).sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, "shingle bigint, a bigint, b bigint")


def enough_matches(pairs: DataFrame, body: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that share as many shingles of their lengthened prefixes as these demand; marks that agree by
    chance only add to the count."""

    def run(batches):
        for batch in batches:
            a, b, m, n, x, y = (batch.column(i) for i in range(6))
            t = overlap(m.to_numpy(), n.to_numpy(), num, den)
            kept = []
            for size_a, size_b, least, p, q in zip(m.to_pylist(), n.to_pylist(), t.tolist(), x.to_pylist(), y.to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16)
                demand = min(len(p) - size_a, len(q) - size_b) + least
                kept.append(int(np.isin(q, p).sum()) >= demand)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = body.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("marks").alias("x"))
    right = body.select(F.col("node").alias("b"), "n", F.col("marks").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y")
    return rows.mapInArrow(run, "a bigint, b bigint")


class _Tile:
    """The documents of a tile, and which of them one of them may be linked to."""

    def __init__(self, table: pa.Table, num: int, den: int):
        node = table.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        table = table.take(pa.array(first))
        self.node, self.n, self.block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
        self.cross = bool(table.column("i")[0].as_py() != table.column("j")[0].as_py()) if len(first) else False
        data, self.ends = flat(table.column("marks"))
        self.marks, self.ends = np.frombuffer(data.tobytes(), np.uint16), self.ends // 2
        self.q = np.diff(self.ends)
        self.sketches = [np.frombuffer(s, np.uint8) for s in table.column("sketch").to_pylist()]
        self.bits = np.array([8 * len(s) for s in self.sketches])
        self.by_bits = {}
        for bits in np.unique(self.bits).tolist():
            own = np.stack([self.folded(k, bits) if self.bits[k] >= bits else np.zeros(bits // 8, np.uint8) for k in range(len(first))])
            self.by_bits[bits] = own
        self.group = table.column("root").to_numpy() if "root" in table.column_names else None
        self.num, self.den = num, den

    def folded(self, k: int, bits: int) -> np.ndarray:
        """A sketch at fewer bits: buckets that fall together add their parities."""
        s = self.sketches[k]
        while 8 * len(s) > bits:
            s = s[: len(s) // 2] ^ s[len(s) // 2 :]
        return s

    def partners(self, x: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that share as many posted shingles with x as their prefixes demand, and differ little enough."""
        t = overlap(self.n[x], self.n[among], self.num, self.den)
        among = among[(t <= np.minimum(self.n[x], self.n[among])) & (among != x)]
        if self.cross:
            among = among[self.block[among] != self.block[x]]
        t = overlap(self.n[x], self.n[among], self.num, self.den)
        keep = np.zeros(len(among), bool)
        least = np.minimum(self.bits[among], self.bits[x])
        for bits in np.unique(least).tolist():
            own = np.flatnonzero(least == bits)
            sketches = self.by_bits[bits]
            apart = np.bitwise_count(sketches[among[own]] ^ sketches[x]).sum(axis=1, dtype=np.int64)
            keep[own] = apart <= self.n[x] + self.n[among[own]] - 2 * t[own]
        among, t = among[keep], t[keep]
        if not len(among):
            return among
        has = np.zeros(1 << 16, bool)
        has[self.marks[self.ends[x] : self.ends[x + 1]]] = True
        lengths = self.q[among]
        hits = has[self.marks[gather(self.ends[among], lengths)]]
        shared = np.add.reduceat(hits, np.cumsum(lengths) - lengths, dtype=np.int64)
        demand = np.minimum(self.q[x] - self.n[x], self.q[among] - self.n[among]) + t
        return among[shared >= demand]

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the possible links, breadth first: one row per document at most."""
        free = np.ones(len(self.node), bool)
        edges = []
        while free.any():
            queue = [int(np.argmax(free))]
            free[queue[0]] = False
            for x in queue:
                found = self.partners(x, np.flatnonzero(free))
                free[found] = False
                edges += [(x, int(y)) for y in found]
                queue += found.tolist()
        return edges

    def between_groups(self) -> list[tuple[int, int]]:
        """All possible links between documents of different groups."""
        edges = []
        for x in range(len(self.node)):
            later = np.arange(x + 1, len(self.node))
            edges += [(x, int(y)) for y in self.partners(x, later[self.group[later] != self.group[x]])]
        return edges


def tile_links(tiles: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """(shingle, i, j, a, b) of every tile: a spanning forest, or all links between groups if ``whole``."""

    def run(key, table):
        tile = _Tile(table, num, den)
        edges = np.array(tile.between_groups() if whole else tile.forest(), np.int64).reshape(-1, 2)
        a, b = tile.node[edges[:, 0]], tile.node[edges[:, 1]]
        place = [pa.array(np.full(len(a), k.as_py(), np.int64)) for k in key]
        return pa.Table.from_arrays([*place, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["shingle", "i", "j", "a", "b"])

    return tiles.groupBy("shingle", "i", "j").applyInArrow(run, "shingle bigint, i bigint, j bigint, a bigint, b bigint")


def tiles_of(long_lists: DataFrame) -> DataFrame:
    """(shingle, i, j, block, node): long posting lists cut into blocks by hash, a row group per pair of blocks."""
    sizes = written(long_lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "list-sizes")
    cut = long_lists.join(sizes.withColumn("blocks", F.ceil(F.col("m") / TILE)), "shingle")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return met.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b, linked): the whole sets of every pair held against each other.

    The sets are made again from the texts of the documents in question. Their keys are broadcast up to
    ``BROADCAST_ROWS``, else joined.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = written(asked.join(nodes, "node").select("node", "hi", "lo", F.col("least_id").alias("_id")), "asked")
    ids = asked.select("_id").distinct()
    if asked.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    own = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    def sets_of(batches):
        for batch in batches:
            for _, sets, borders in batch_sets(batch, words):
                hi, lo = digests(sets, borders)
                parts = [sets[a:b].tobytes() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(parts, pa.binary())], ["hi", "lo", "items"])

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                linked.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    sets = own.mapInArrow(sets_of, "hi bigint, lo bigint, items binary")
    sets = written(sets.join(asked.select("node", "hi", "lo"), ["hi", "lo"]).dropDuplicates(["node"]).select("node", "items"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written(rows.mapInArrow(compare, "a bigint, b bigint, linked boolean"), "compared")


def links(docs: DataFrame, nodes: DataFrame, known, words: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links between nodes, whose components are those of all links."""
    carried = prefixes(docs, known, words, num, den).filter("n > 0")
    mine = nodes.select("node", "hi", "lo", "n", "least_id")
    carried = carried.join(mine, ["hi", "lo", "n"]).filter(F.col("doc_id").eqNullSafe(F.col("least_id")))
    carried = written(carried.select("node", "n", "posted", "counts", "marks", "sketch"), "prefixes")
    # Marks and sketches meet the pairs and the tiles' rows; each document is one row here.
    body = carried.select("node", "n", "marks", "sketch")
    postings = carried.select("node", "n", F.posexplode(F.arrays_zip("posted", "counts")).alias("at", "p")).select(
        F.col("p.posted").alias("shingle"), "node", "n", (F.col("at") + 1).alias("at"), F.col("p.counts").alias("c")
    )
    found = written(light_matches(postings.filter(F.col("c") <= HEAVY).drop("c"), num, den), "matches")
    met = written(found.filter("b IS NOT NULL").select("a", "b").distinct(), "met")
    candidates = enough_matches(met, body, num, den)

    long_lists = found.filter("b IS NULL").select("shingle", F.col("a").alias("node"))
    long_lists = long_lists.unionByName(postings.filter(F.col("c") > HEAVY).select("shingle", "node"))
    places = written(tiles_of(long_lists), "tiles")
    forest = written(tile_links(places.join(body, "node"), num, den, False), "forest")
    pairs = written(candidates.unionByName(forest.select("a", "b")).distinct(), "pairs")
    checked = compared(pairs, docs, nodes, words, num, den)
    good = checked.filter("linked").select("a", "b")

    # Where a possible link of a tile was none, its forest may miss links: there all that lie between groups are checked.
    broken = checked.filter("NOT linked").join(forest, ["a", "b"]).select("shingle", "i", "j").distinct()
    broken = written(broken, "broken")
    if broken.isEmpty():
        return good
    groups = components(good)
    again = places.join(broken, ["shingle", "i", "j"], "left_semi").join(body, "node").join(groups, "node", "left")
    again = tile_links(again.withColumn("root", F.coalesce("root", "node")), num, den, True).select("a", "b").distinct()
    rest = written(again.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    return good.unionByName(compared(rest, docs, nodes, words, num, den).filter("linked").select("a", "b"))


def jaccard_groups(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    num: int = NUMERATOR,
    den: int = DENOMINATOR,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    A-Z is lower-cased, words are runs without ASCII white space, a set holds the distinct shingles of ``words`` words, and
    fewer words are one shingle. Sets are linked if den * intersection >= num * union; equal sets are one node, so
    pairs of copies are never made. ``component_id`` is the smallest doc_id that links reach; null ids take part and are
    smallest only where there is no other. A null or blank text has no set, no links and its own doc_id. Repeated rows
    are rows of one node. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    summary = written(summaries(rows, words), "summaries")
    own = summary.filter("n IS NOT NULL").select("doc_id", "hi", "lo", "n")
    nodes = own.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("least_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(links(rows, nodes, common_shingles(summary), words, num, den))
    named = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = written(named.join(least, "root").select("hi", "lo", "n", "component_id"), "components")
    found = own.filter("n > 0").join(named, ["hi", "lo", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(blank)
