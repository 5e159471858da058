"""Language-model scores from an n-gram trie in Elias-Fano levels, built and queried shard by shard.

Texts are cut into blocks. A block asks every shard of the trie about the n-grams it holds, once each, and tells how often
they occur in its training texts. A shard adds up what all blocks told, builds its part of the trie, looks up what the
blocks asked, and answers with one quantised probability per n-gram. Neither the counts nor the trie ever meet in one
place, and an n-gram crosses the network once per block, however often it occurs.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import written
from revwatch.llm.texts import LOWER, SPACE, binary, chunks, distinct, spans

BLOCK_BYTES = 8_000_000
SHARD_BYTES = 4_000_000
#: Weight of the lower order: a context seen m times trusts its own counts by m / (m + WEIGHT).
WEIGHT = 32.0
#: Probabilities are kept as their logarithm in 255 steps down to 10 to the power of -LOWEST.
LOWEST = 9.0
#: Contexts whose successors are dealt over all shards, chosen by their share of a sample; they only balance the load.
HOT_SHARE, HOT_WORDS, HOT_SAMPLE = 0.001, 64, 64

#: No word is empty or a space, so these stand for the end and for the context before the first word.
END, BEGIN = b"", b" "
SUCCESSOR_BITS = 48


# -- Elias-Fano sequences ------------------------------------------------------------------------------------------


class EliasFano:
    """A sequence of non-decreasing numbers: low bits packed, high bits as a unary bit vector, every 1024th one noted."""

    STEP = 1024

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray, noted: np.ndarray):
        self.count, self.width, self.low, self.high, self.noted = count, width, low, high, noted

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, width), np.uint8)
        for bit in range(width):
            low[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, width, np.packbits(low.reshape(-1)), np.packbits(bits), places[:: cls.STEP].astype(np.int64))

    def decode(self, first: int, end: int) -> np.ndarray:
        """Members ``first`` to ``end - 1``."""
        if end <= first:
            return np.empty(0, np.uint64)
        note = first // self.STEP
        start = int(self.noted[note]) // 8
        after = (end - 1) // self.STEP + 1
        stop = int(self.noted[after]) // 8 + 1 if after < len(self.noted) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[start:stop])) + start * 8
        skip = int(np.searchsorted(places, self.noted[note])) + first - note * self.STEP
        high = (places[skip : skip + end - first] - np.arange(first, end)).astype(np.uint64)
        if not self.width:
            return high
        begin = first * self.width
        bits = np.unpackbits(self.low[begin // 8 : -(-end * self.width // 8)])[begin % 8 :][: (end - first) * self.width]
        bits = bits.reshape(-1, self.width)
        value = high << np.uint64(self.width)
        for bit in range(self.width):
            value |= bits[:, bit].astype(np.uint64) << np.uint64(bit)
        return value

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.count, self.width], np.int64), self.low, self.high, self.noted]

    @classmethod
    def mapped(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, noted = arrays
        return cls(int(head[0]), int(head[1]), low, high, noted)


# -- the trie ------------------------------------------------------------------------------------------------------


def quantised(probability: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities above 0; code 0 is left for n-grams that were never seen."""
    steps = np.rint(-np.log10(probability) * (254 / LOWEST))
    return (255 - np.clip(steps, 0, 254)).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 255) * (LOWEST / 254)), 0.0)


class Trie:
    """Two levels: contexts with pointers, and below each context its successors with their probabilities.

    Successors are numbered within the shard and stored relative to their context: the context's rank times the size of
    the numbering is added, which makes the whole level one monotone sequence.
    """

    def __init__(self, names: EliasFano, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.names, self.contexts, self.pointers, self.successors, self.codes = names, contexts, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, probability: np.ndarray) -> Trie:
        """From distinct pairs in ascending order."""
        names = np.unique(successor)
        contexts, first = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(context))))
        relative = rank.astype(np.uint64) * np.uint64(len(names)) + np.searchsorted(names, successor).astype(np.uint64)
        return cls(
            EliasFano.of(names, 1 << SUCCESSOR_BITS),
            EliasFano.of(contexts, 1 << 64),
            EliasFano.of(np.append(first, len(context)), len(context) + 1),
            EliasFano.of(relative, len(contexts) * len(names) + 1),
            quantised(probability),
        )

    def save(self, path: str) -> None:
        """All levels in one file: a table of (place, bytes, kind) and the arrays."""
        parts = [a for x in (self.names, self.contexts, self.pointers, self.successors) for a in x.arrays()]
        parts = [np.ascontiguousarray(a) for a in (*parts, self.codes)]
        with open(path, "wb") as f:
            at = 8 + 24 * len(parts)
            f.write(struct.pack("<q", len(parts)))
            for a in parts:
                f.write(struct.pack("<qqq", at, a.nbytes, a.dtype.itemsize))
                at += a.nbytes + -a.nbytes % 8
            for a in parts:
                f.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        """The levels as views of the mapped file; only pages that a search touches are read."""
        data = np.memmap(path, np.uint8, "r")
        count = int(data[:8].view(np.int64)[0])
        table = data[8 : 8 + 24 * count].view(np.int64).reshape(-1, 3)
        parts = [data[a : a + n].view({1: np.uint8, 8: np.int64}[size]) for a, n, size in table.tolist()]
        return cls(*(EliasFano.mapped(parts[4 * i : 4 * i + 4]) for i in range(4)), parts[16])

    def find(self, context: np.ndarray, successor: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Codes of pairs that are sorted by context; 0 where the trie has no such pair.

        Contexts are read in runs. Inside a run, a pair becomes its context's rank and its successor's number, and is
        searched among the successors that the pointers give for that run.
        """
        codes = np.zeros(len(context), np.uint8)
        if not self.contexts.count:
            return codes
        names = self.names.decode(0, self.names.count)
        number = np.searchsorted(names, successor)
        known = number < len(names)
        known[known] = names[number[known]] == successor[known]
        for first in range(0, self.contexts.count, step):
            end = min(first + step, self.contexts.count)
            own = self.contexts.decode(first, end)
            a, b = np.searchsorted(context, own[0]), np.searchsorted(context, own[-1], "right")
            if a == b:
                continue
            rank = np.searchsorted(own, context[a:b])
            there = (own[rank] == context[a:b]) & known[a:b]
            low, high = self.pointers.decode(first, first + 1)[0], self.pointers.decode(end, end + 1)[0]
            stored = self.successors.decode(int(low), int(high))
            wanted = (rank + first).astype(np.uint64) * np.uint64(len(names)) + number[a:b].astype(np.uint64)
            place = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
            there &= stored[place] == wanted
            codes[a:b][there] = self.codes[int(low) + place[there]]
        return codes


# -- messages ------------------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of their numbers, so that high bytes compress well."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(struct.pack("<qqc", len(planes), len(body), a.dtype.char.encode()) + body)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, held, kind = struct.unpack_from("<qqc", data, at)
        at += 17
        planes = pa.decompress(data[at : at + held], size, codec="zstd", asbytes=True) if size else b""
        at += held
        width = np.dtype(kind.decode()).itemsize
        planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind.decode()).reshape(-1))
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so words in the order of their hashes are in the order of their shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def split48(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values >> np.uint64(32)).astype(np.uint16), values.astype(np.uint32)


def whole48(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def word_hashes(values: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(v, 7) for v in values), np.uint64, len(values))


@dataclass
class Pairs:
    """The distinct pairs of a block in the order in which the shards are asked, and which pair every token is."""

    context: np.ndarray
    word: np.ndarray
    shard: np.ndarray
    of_token: np.ndarray


def pairs_of(tokens: np.ndarray, before: np.ndarray, shard: np.ndarray, hot: np.ndarray) -> Pairs:
    """``shard`` and ``hot`` are per word of the block; a pair goes to its context's shard, below hot ones to its word's."""
    width = np.int64(len(shard))
    keys, of_token = np.unique(before * width + tokens, return_inverse=True)
    context, word = keys // width, keys % width
    target = np.where(hot[context], shard[word], shard[context])
    order = np.argsort(target, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Pairs(context[order], word[order], target[order], place[of_token])


def before_each(tokens: np.ndarray, n_tokens: np.ndarray, begin: int) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(n_tokens) - n_tokens)] = begin
    return before


def ask(keys: pa.Array, data: np.ndarray, offsets: np.ndarray, learns: np.ndarray, shards: int, hot: list[bytes]):
    """Messages of one block: (target, block, shard, payload), the last one to the block itself."""
    lower = LOWER[data]
    inside = ~SPACE[data]
    starts, ends, per_row = spans(inside, offsets)
    borders = np.append(0, np.cumsum(ends - starts))
    coded, values = distinct(binary(lower[inside], borders)) if len(starts) else (np.empty(0, np.int32), [])
    values = [*values, END, BEGIN]
    hashes = word_hashes(values)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    hashes = hashes[order]
    end, begin = int(rank[-2]), int(rank[-1])
    n_tokens = per_row + 1
    tokens = np.full(int(n_tokens.sum()), end, np.int64)
    last = np.cumsum(n_tokens) - 1
    is_word = np.ones(len(tokens), bool)
    is_word[last] = False
    tokens[is_word] = rank[coded]
    shard = shard_of(hashes, shards)
    is_hot = np.isin(hashes, word_hashes(hot))
    before = before_each(tokens, n_tokens, begin)
    pairs = pairs_of(tokens, before, shard, is_hot)
    learnt = np.repeat(learns, n_tokens)
    count = np.bincount(tokens[learnt], minlength=len(hashes)).astype(np.uint32)
    count[begin] = int(learns.sum())
    pair_count = np.bincount(pairs.of_token[learnt], minlength=len(pairs.word)).astype(np.uint32)
    name = f"{zlib.crc32(tokens.tobytes()):08x}{zlib.crc32(repr(keys.to_pylist()).encode()):08x}"
    hot_words = np.flatnonzero(is_hot)
    word_borders = np.searchsorted(shard, np.arange(shards + 1))
    pair_borders = np.searchsorted(pairs.shard, np.arange(shards + 1))
    for s in range(shards):
        a, b = word_borders[s], word_borders[s + 1]
        c, d = pair_borders[s], pair_borders[s + 1]
        if a == b and c == d:
            continue
        # Contexts are named by their place among this message's words, hot ones from other shards after them.
        context = pairs.context[c:d]
        elsewhere = np.searchsorted(hot_words, context)
        place = np.where((context >= a) & (context < b), context - a, (b - a) + elsewhere).astype(np.uint32)
        runs = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
        payload = packed(
            hashes[a:b],
            count[a:b],
            hashes[hot_words],
            count[hot_words],
            place[runs],
            np.diff(np.append(runs, len(place))).astype(np.uint32),
            *split48(hashes[pairs.word[c:d]] >> np.uint64(64 - SUCCESSOR_BITS)),
            pair_count[c:d],
        )
        yield f"shard {s}", name, s, payload
    body = packed(
        n_tokens.astype(np.uint32), tokens.astype(np.uint32), is_hot.astype(np.uint8), shard.astype(np.uint32),
        np.array([end, begin], np.int64),
    )
    yield f"block {name}", name, -1, body


def answer(messages: list[tuple[str, int, bytes]], weight: float):
    """Answers of one shard: (block, shard, payload), and the training tokens and distinct words it has counted."""
    parts = [unpacked(m) for _, _, m in messages]
    hashes = np.concatenate([p[0] for p in parts])
    names, of_word = np.unique(hashes, return_inverse=True)
    counts = np.bincount(of_word, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)
    hot_names, of_hot = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    hot_counts = np.bincount(of_hot, np.concatenate([p[3] for p in parts]), len(hot_names))
    context = np.concatenate([np.repeat(np.append(p[0], p[2])[p[4]], p[5]) for p in parts])
    total = np.concatenate([counts, hot_counts])
    all_names = np.concatenate([names, hot_names])
    by_name = np.argsort(all_names, kind="stable")
    successor = np.concatenate([whole48(p[6], p[7]) for p in parts])
    told = np.concatenate([p[8] for p in parts]).astype(np.float64)
    order = np.lexsort((successor, context))
    c, s = context[order], successor[order]
    new = np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])) if len(c) else np.empty(0, bool)
    first = np.flatnonzero(new)
    seen = np.add.reduceat(told[order], first) if len(first) else np.empty(0)
    trained = seen > 0
    c, s, seen = c[first][trained], s[first][trained], seen[trained]
    of_context = total[by_name][np.searchsorted(all_names[by_name], c)]
    codes = np.zeros(len(context), np.uint8)
    if len(c):
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            Trie.build(c, s, seen / (of_context + weight)).save(path)
            codes[order] = Trie.open(path).find(context[order], successor[order])
        finally:
            os.remove(path)
    special = np.isin(names, word_hashes([BEGIN]))
    tokens, vocabulary = int(counts[~special].sum()), int((counts[~special] > 0).sum())
    word_at = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    pair_at = np.append(0, np.cumsum([len(p[8]) for p in parts]))
    for i, (block, shard, _) in enumerate(messages):
        own = packed(counts[of_word[word_at[i] : word_at[i + 1]]], codes[pair_at[i] : pair_at[i + 1]])
        yield block, shard, own, tokens if i == 0 else 0, vocabulary if i == 0 else 0


def score_block(body: bytes, answers: list[tuple[int, bytes]], train_tokens: int, vocabulary: int, weight: float):
    """Per document of a block: tokens, known tokens, base score and model score."""
    n_tokens, tokens, hot, shard, special = unpacked(body)
    n_tokens, tokens = n_tokens.astype(np.int64), tokens.astype(np.int64)
    before = before_each(tokens, n_tokens, int(special[1]))
    pairs = pairs_of(tokens, before, shard.astype(np.int64), hot.astype(bool))
    replies = [unpacked(x) for _, x in sorted(answers)]
    count = np.concatenate([r[0] for r in replies])
    codes = np.concatenate([r[1] for r in replies])
    if len(count) != len(hot) or len(codes) != len(pairs.word):
        raise RuntimeError("the answers do not fit the block: its input was read in another order")
    base = (count + 1) / (train_tokens + vocabulary + 1)
    own = count[before]
    p = restored(codes)[pairs.of_token] + weight / (own + weight) * base[tokens]
    first = np.cumsum(n_tokens) - n_tokens
    return (
        n_tokens,
        np.add.reduceat((count[tokens] > 0).astype(np.int64), first),
        np.add.reduceat(np.log10(base)[tokens], first),
        np.add.reduceat(np.log10(p), first),
    )


# -- Spark jobs ----------------------------------------------------------------------------------------------------


def hot_words(docs: DataFrame, text: str, doc_id: str) -> list[str]:
    """Words with a large share of the tokens in one of ``HOT_SAMPLE`` texts, at most ``HOT_WORDS`` of them."""
    some = docs.filter(F.pmod(F.xxhash64(doc_id, text), F.lit(HOT_SAMPLE)) == 0)
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = some.select(F.explode(F.split(lowered, r"[\x20\x09-\x0D]+")).alias("word"))
    counts = words.groupBy("word").count().filter("word <> ''").orderBy(F.desc("count"), "word").limit(HOT_WORDS)
    rows = counts.collect()
    total = some.agg(F.coalesce(F.sum(F.size(F.split(text, r"[\x20\x09-\x0D]+"))), F.lit(0))).head()[0]
    return [r["word"] for r in rows if r["count"] >= HOT_SHARE * total]


def scores(
    docs: DataFrame, learns: str, text: str = "text", doc_id: str = "doc_id", weight: float = WEIGHT,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    ``learns`` is a boolean SQL expression: the rows whose texts the model learns from. A-Z is lower-cased, tokens are
    runs without ASCII white space and one end; a null text is an empty one and has the end only. The base score sums
    log10((c + 1) / (N + V + 1)) exactly. The score sums log10 of p = c(hw) / (c(h) + m) + m / (c(h) + m) p1(w), where
    h is the word before (or the beginning), p1 the base probability, m ``weight``, and the first term is quantised.
    Words are told apart by a 64-bit hash, the successors of a word by 48 bits of it. Repeated rows are scored each; without training texts every count is 0. An
    empty table gives no rows.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.expr(learns), F.lit(False)).alias("learns"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    shards = max(1, -(-size // shard_bytes))
    hot = [w.encode() for w in hot_words(rows, "text", "doc_id")]

    def asked(batches):
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1), block_bytes):
                keys = batch.column(0).slice(first, end - first)
                learn = batch.column(2).slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool)
                sent = list(ask(keys, data, offsets, learn, shards, hot))
                ids = [None] * (len(sent) - 1) + [keys.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m[0] for m in sent], pa.string()),
                        pa.array([m[1] for m in sent], pa.string()),
                        pa.array([m[2] for m in sent], pa.int32()),
                        pa.array([m[3] for m in sent], pa.binary()),
                        pa.array(ids, pa.list_(pa.int64())),
                    ],
                    ["target", "block", "shard", "payload", "ids"],
                )

    def answered(group: pa.Table) -> pa.Table:
        columns = ["block", "shard", "payload", "ids"]
        if group["shard"][0].as_py() < 0 or group["target"][0].as_py().startswith("block"):
            none = pa.array([0] * len(group), pa.int64())
            return group.select(columns).append_column("tokens", none).append_column("vocabulary", none)
        messages = list(zip(*(group[c].to_pylist() for c in columns[:3]), strict=True))
        replies = list(answer(messages, weight))
        return pa.table(
            {
                "block": pa.array([r[0] for r in replies], pa.string()),
                "shard": pa.array([r[1] for r in replies], pa.int32()),
                "payload": pa.array([r[2] for r in replies], pa.binary()),
                "ids": pa.array([None] * len(replies), pa.list_(pa.int64())),
                "tokens": pa.array([r[3] for r in replies], pa.int64()),
                "vocabulary": pa.array([r[4] for r in replies], pa.int64()),
            }
        )

    message = "block string, shard int, payload binary, ids array<bigint>"
    asks = rows.mapInArrow(asked, "target string, " + message)
    replies = written(
        asks.groupBy("target").applyInArrow(answered, message + ", tokens bigint, vocabulary bigint"), "answers"
    )
    totals = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).head()
    train_tokens, vocabulary = totals

    def finished(group: pa.Table) -> pa.Table:
        shard, payload = group["shard"].to_pylist(), group["payload"].to_pylist()
        # Blocks that are alike in ids and texts share a name; each of them gets its rows.
        own = [i for i, s in enumerate(shard) if s < 0]
        replies_of: dict[int, bytes] = {s: payload[i] for i, s in enumerate(shard) if s >= 0}
        parts = []
        for i in own:
            n, known, base, score = score_block(payload[i], list(replies_of.items()), train_tokens, vocabulary, weight)
            ids = group["ids"][i].as_py()
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                        "n_known": pa.array(known, pa.int64()),
                        "train_tokens": pa.array([train_tokens] * len(ids), pa.int64()),
                        "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
                    }
                )
            )
        return pa.concat_tables(parts)

    return replies.groupBy("block").applyInArrow(
        finished, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
