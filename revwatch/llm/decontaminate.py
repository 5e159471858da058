"""Benchmark decontamination: benchmark word windows as a broadcast hash set, scanned over the windows of every text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revwatch.llm.store import worker_state, written
from revwatch.llm.texts import LOWER, WORD, binary, chunks, distinct, gather, spans

WINDOW = 13
#: Bytes of benchmark text in one broadcast; a larger benchmark is scanned in several passes of about this size. A worker
#: holds one ``WindowSet`` of it at a time.
BROADCAST_BYTES = 16_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OFFSET = np.uint64(0xD1B54A32D192ED03)


def rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` numbers; runs that are equal hash alike."""
    mixed = (numbers.astype(np.uint64) + _OFFSET) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    n = max(len(numbers) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _FACTOR + mixed[k : k + n]
    return out


def split_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased words of all rows: a binary column, byte starts and ends, words per row."""
    lower = LOWER[data]
    inside = WORD[lower]
    starts, ends, per_row = spans(inside, offsets)
    return binary(lower[inside], np.append(0, np.cumsum(ends - starts))), starts, ends, per_row


class WindowSet:
    """Every window of some benchmark items, in flat arrays: about five bytes per byte of benchmark text.

    The items' words are numbers in one long sequence. Per window size there are the sorted hashes of the distinct windows,
    where each first stands in the sequence, and the items that hold it. Words are found by a hash and compared byte by
    byte, windows by a hash and compared word by word.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = [(text or "").encode() for _, text in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        column, _, _, per_item = split_words(data, offsets)
        coded, kinds = distinct(column)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in kinds], np.uint64)
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(kinds), np.int32)
        number[order] = np.arange(len(kinds))
        self.items = [item for item, _ in items]
        self.word_hash, self.word_at = hashes[order], np.append(0, np.cumsum([len(kinds[k]) for k in order]))
        self.words = b"".join(kinds[k] for k in order)
        self.sequence = number[coded] if len(coded) else np.empty(0, np.int32)
        first = np.append(0, np.cumsum(per_item))
        sizes = np.minimum(per_item, window)
        self.by_size = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            starts = gather(first[own], per_item[own] - size + 1).astype(np.int32)
            self.by_size[size] = self._windows(size, starts, first)

    def _windows(self, size: int, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and first place of every distinct window of ``size`` words, and borders and numbers of its items."""
        hashes = rolling(self.sequence, size)[starts]
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        same = hashes[1:] == hashes[:-1]
        for k in range(size):
            same &= self.sequence[starts[1:] + k] == self.sequence[starts[:-1] + k]
        new = np.append(True, ~same)
        item = (np.searchsorted(first, starts, "right") - 1).astype(np.int32)
        kept = new | np.append(True, item[1:] != item[:-1])  # places ascend, so an item's repeats are neighbours
        heads = np.flatnonzero(new)
        return hashes[heads], starts[heads], np.append(np.cumsum(kept)[heads] - 1, kept.sum()).astype(np.int32), item[kept]

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays."""
        tables = sum(a.nbytes for own in self.by_size.values() for a in own)
        return self.word_hash.nbytes + self.word_at.nbytes + len(self.words) + self.sequence.nbytes + tables

    def numbers(self, values: list[bytes]) -> np.ndarray:
        """The number of every word, -1 for words that no item has."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.word_hash) or not values:
            return out
        hashes = np.array([xxhash.xxh64_intdigest(v) for v in values], np.uint64)
        at = np.searchsorted(self.word_hash, hashes)
        for k in np.flatnonzero(self.word_hash[np.minimum(at, len(self.word_hash) - 1)] == hashes).tolist():
            j = int(at[k])
            while j < len(self.word_hash) and self.word_hash[j] == hashes[k]:
                if self.words[self.word_at[j] : self.word_at[j + 1]] == values[k]:
                    out[k] = j
                j += 1
        return out

    def hits(self, numbers: np.ndarray, per_row: np.ndarray) -> dict[int, list[tuple[int, int, list]]]:
        """Per row the verified occurrences (first word, words, items) of a window."""
        first = np.append(0, np.cumsum(per_row))
        unknown = np.append(0, np.cumsum(numbers < 0))
        found: dict[int, list] = {}
        for size, (hashes, places, borders, held) in self.by_size.items():
            if len(numbers) < size:
                continue
            # Only runs of benchmark words can match, and a run has to end in the row in which it begins.
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            row = np.searchsorted(first, starts, "right") - 1
            inside = starts + size <= first[row + 1]
            starts, row = starts[inside], row[inside]
            values = rolling(numbers, size)[starts]
            at = np.searchsorted(hashes, values)
            while len(at):  # mostly once: again for different windows of one hash
                hit = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == values))
                starts, row, values, at = starts[hit], row[hit], values[hit], at[hit]
                same = np.ones(len(at), bool)
                for k in range(size):
                    same &= self.sequence[places[at] + k] == numbers[starts + k]
                for s, r, j in zip(starts[same].tolist(), row[same].tolist(), at[same].tolist(), strict=True):
                    own = [self.items[i] for i in held[borders[j] : borders[j + 1]]]
                    found.setdefault(r, []).append((s - int(first[r]), size, own))
                at = at + 1
        return found


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, length) that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(intervals):
        if out and start <= out[-1][0] + out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], start + length - last[0]))
        else:
            out.append((start, length))
    return out


def _parts(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The benchmark in parts of about ``limit`` bytes, each small enough to broadcast; usually there is one."""
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), F.col(text).cast("string").alias("_text"))
    items = items.filter(F.col("_text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("_text") + 32), F.lit(0))).head()[0]
    count = max(1, -(-total // limit))
    for part in range(count):
        own = items if count == 1 else items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(count)) == part)
        yield [(r["_item"], r["_text"]) for r in own.toLocalIterator()]


def annotated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, str, str, str]:
    """All rows and columns of ``docs`` with three more, and the names of these (they avoid the names that are there).

    * words of the text (null has none);
    * the words inside any occurrence of a window, as disjoint spans (start, length) in words;
    * the items with an occurring window, sorted as strings.

    An item of fewer than ``window`` words is one window; one without words or with a null text is none. Items with
    a null id are scanned for like others; all of them together are one null at the end of the list, which is counted, as the
    query's SQL does, and left out where ids are joined. Whole texts are scanned. An empty benchmark finds nothing; an empty
    table gives no rows.
    """
    name = "_"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    n_words, span, items = f"{name}words", f"{name}spans", f"{name}items"
    extra = f"{n_words} bigint, {span} array<struct<start:int,length:int>>, {items} array<string>"
    at = docs.columns.index(text)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    out, spark = docs, docs.sparkSession
    for k, part in enumerate(_parts(benchmark, item_id, item_text, limit)):
        if k:
            out = written(out, "decontaminated")
            sent.destroy()  # the pass that needed it is written
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, part, window))

        def scan(batches, sent=sent, again=k > 0):
            key, items_of_part, size = sent.value
            state = worker_state("decontaminate")
            if state.get("key") != key:
                state.clear()
                state.update(key=key, table=WindowSet(items_of_part, size))
            table = state["table"]
            for batch in batches:
                for first, end, data, offsets in chunks(batch.column(at)):
                    column, _, _, per_row = split_words(data, offsets)
                    coded, values = distinct(column)
                    known = table.numbers(values)
                    found = table.hits(known[coded], per_row) if len(coded) else {}
                    rows = batch.slice(first, end - first)
                    covered: list = [[] for _ in range(end - first)]
                    held: list = [[] for _ in range(end - first)]
                    if again:
                        covered = [[(s["start"], s["length"]) for s in x] for x in rows.column(len(rows.schema) - 2).to_pylist()]
                        held = rows.column(len(rows.schema) - 1).to_pylist()
                    for r, hits in found.items():
                        covered[r] = merged(covered[r] + [(s, n) for s, n, _ in hits])
                        items_of = {*held[r], *(i for _, _, own in hits for i in own)}
                        held[r] = sorted(items_of, key=lambda i: (i is None, i or ""))
                    columns = rows.columns[: len(rows.schema) - 3] if again else rows.columns
                    as_structs = [[{"start": s, "length": n} for s, n in x] for x in covered]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *columns,
                            pa.array(per_row, pa.int64()),
                            pa.array(as_structs, span_type),
                            pa.array(held, pa.list_(pa.string())),
                        ],
                        [*docs_names, n_words, span, items],
                    )

        docs_names = docs.columns
        schema = T.StructType([*docs.schema, *T.StructType.fromDDL(extra)])
        out = out.mapInArrow(scan, schema)
    return out, n_words, span, items


def hit_words(span: str) -> Column:
    return F.aggregate(span, F.lit(0).cast("bigint"), lambda n, s: n + s["length"])


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words, and at least one, lies inside benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, items, spans, contaminated)."""
    text = options.get("text", "text")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias(text))
    rows, n_words, span, items = annotated(keyed, benchmark, **options)
    n_hit = hit_words(span)
    return rows.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.col(items).alias("items"),
        F.col(span).alias("spans"),
        is_contaminated(F.col(n_words), n_hit).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    rows, n_words, span, _ = annotated(docs, benchmark, **options)
    return rows.filter(~is_contaminated(F.col(n_words), hit_words(span))).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All rows of ``docs``; every span of hit words, from its first to its last byte, is taken out of the text."""
    rows, _, span, _ = annotated(docs, benchmark, **options)
    at, mark = docs.columns.index(options.get("text", "text")), len(docs.columns) + 1

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for r, own in enumerate(batch.column(mark).to_pylist()):
                if own:
                    data = texts[r].encode()
                    flat_text = np.frombuffer(data, np.uint8)
                    _, starts, ends, _ = split_words(flat_text, np.array([0, len(data)]))
                    left, after = [], 0
                    for s in own:
                        left.append(data[after : starts[s["start"]]])
                        after = ends[s["start"] + s["length"] - 1]
                    texts[r] = b"".join([*left, data[after:]]).decode()
            columns = batch.columns[: len(docs_schema)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, docs_schema.names)

    docs_schema = docs.schema
    return rows.mapInArrow(cut, docs.schema)
