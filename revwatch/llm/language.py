"""Language identification by cross-parsing entropy against one suffix automaton per language."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revwatch.llm.store import worker_state, written
from revwatch.llm.texts import chunks

#: Characters of labelled text per language that its automaton is built from, and of one passage of a training text.
#: They bound the models; what is predicted is always the whole text.
TRAIN_BYTES = 24_000
TEXT_BYTES = 1_000
#: Bytes that are parsed as one run. A longer text is parsed in runs of this size side by side, so one very long text is as
#: parallel as many short ones; the parses are then joined, so phrases are those of the whole text.
RUN_BYTES = 256
LANES = 4_096
UNKNOWN = "und"

#: Letters beyond ASCII are kept as their UTF-8 bytes; every other ASCII character is a word border.
_BORDER = 0


def held_out(doc_id: Column, modulus: int = 4, fold: int = 2) -> Column:
    """Whether CRC-32 of the id as text falls into the fold that is never learnt from; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == fold


def passages(text: str) -> list[tuple[int, str]]:
    """All passages of ``TEXT_BYTES`` characters of a text, each once, in the order in which they are drawn.

    The order is that of the passages' own hashes, below the number of passages of this text that come before. So every
    text gives one passage from anywhere in it before any text gives a second one, and copies give the same ones.
    """
    own = {text[i : i + TEXT_BYTES] for i in range(0, len(text), TEXT_BYTES)}
    hashed = sorted((int.from_bytes(blake2b(x.encode(), digest_size=5).digest()), x) for x in own)
    return [(turn << 40 | order, x) for turn, (order, x) in enumerate(hashed)]


class _Drawn:
    """The distinct passages of one language that come first, ``limit`` characters of them or one passage more."""

    def __init__(self, limit: int):
        self.limit, self.order, self.size, self.last = limit, {}, 0, None

    def add(self, order: int, body: str) -> bool:
        """False where neither this passage nor any later one can be among the first."""
        if self.last is not None and order > self.last:
            return False
        if body not in self.order:
            self.size += len(body)
        self.order[body] = min(order, self.order.get(body, order))
        if self.size > 4 * self.limit + TEXT_BYTES:
            self.first()
        return True

    def first(self) -> list[tuple[int, str]]:
        kept, self.size = [], 0
        for order, body in sorted((o, b) for b, o in self.order.items()):
            if self.size >= self.limit:
                break
            kept.append((order, body))
            self.size += len(body)
        self.order = {body: order for order, body in kept}
        if self.size >= self.limit and kept:
            self.last = kept[-1][0]
        return kept


def training_sample(labelled: DataFrame, lang: str, text: str, train_bytes: int = TRAIN_BYTES) -> dict[str, str]:
    """Per language at most ``train_bytes`` of text and one passage, drawn by hash from the distinct passages of all texts.

    Neither the ids nor how often a text or a passage is repeated have a say. Every split keeps its own first passages per
    language and sends no more than the bound, so neither the shuffle nor the driver sees more than languages x bound.
    """
    names = ["lang", "order", "body"]
    types = [pa.string(), pa.int64(), pa.string()]

    def as_batch(kept: dict[str, _Drawn]) -> pa.RecordBatch:
        rows = [(own, order, body) for own, drawn in kept.items() for order, body in drawn.first()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(3)], names)

    def first_of_texts(batches):
        kept: dict[str, _Drawn] = {}
        for batch in batches:
            for own, body in zip(batch.column(0), batch.column(1), strict=True):
                drawn = kept.setdefault(own.as_py(), _Drawn(train_bytes))
                for order, passage in passages(body.as_py()):
                    if not drawn.add(order, passage):
                        break
        yield as_batch(kept)

    def first_of_splits(table):
        kept: dict[str, _Drawn] = {}
        for own, order, body in zip(*(table.column(n).to_pylist() for n in names), strict=True):
            kept.setdefault(own, _Drawn(train_bytes)).add(order, body)
        return pa.Table.from_batches([as_batch(kept)])

    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("body")
    )
    schema = "lang string, order bigint, body string"
    whole = rows.mapInArrow(first_of_texts, schema).groupBy("lang").applyInArrow(first_of_splits, schema)
    sample: dict[str, str] = {}
    for r in sorted(whole.collect()):
        sample[r["lang"]] = sample.get(r["lang"], "") + " " + r["body"]
    return sample


def symbols(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with everything but letters as borders; ``data`` is already lower-cased text."""
    table = np.full(256, _BORDER, np.uint8)
    table[np.r_[0x61:0x7B, 0x80:0x100]] = np.r_[0x61:0x7B, 0x80:0x100]
    return table[data]


def folded(text: str) -> bytes:
    """Symbols of a text with runs of borders as one."""
    s = symbols(np.frombuffer(text.lower().encode(), np.uint8))
    keep = s != _BORDER
    keep[1:] |= s[:-1] != _BORDER
    return s[keep].tobytes()


def suffix_automaton(symbols_of: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all suffixes: state 0 reads exactly the substrings of the text."""
    following, link, longest = [{}], [-1], [0]
    last = 0
    for c in symbols_of:
        new = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following


class CrossParser:
    """All languages' automata as one table of moves.

    A phrase is the longest match from where the last one ended. Where the automaton cannot go on, the move leads to
    where a new phrase that begins with this symbol leads, and its lowest bit says that a phrase was begun.
    """

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        texts = [folded(sample[x]) for x in self.languages]
        self.sizes = np.array([max(len(t), 2) for t in texts], np.float64)
        used = sorted(set(b"".join(texts)))
        self.width = len(used) + 1  # the last class is any symbol that no training text has
        self.classes = np.full(256, len(used), np.int32)
        self.classes[used] = np.arange(len(used))
        tables, self.roots, base = [], [], 0
        for t in texts:
            moves = suffix_automaton(t)
            table = np.full((len(moves), self.width), -1, np.int64)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, self.classes[c]] = to
            # A phrase begins at state 0, also after a symbol that the text does not have, which is a phrase by itself.
            fail = table < 0
            fail[0] = True
            start = np.where(table[0] < 0, 0, table[0])
            table = np.where(fail, start[None, :], table)
            tables.append((((table + base) * self.width) << 1 | fail).astype(np.int32))
            self.roots.append(base * self.width)
            base += len(moves)
        self.moves = np.concatenate(tables).reshape(-1) if tables else np.empty(0, np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per row and language, and symbols per row; borders in a row count as one symbol."""
        rows, languages = len(offsets) - 1, len(self.languages)
        s = symbols(data)
        keep = s != _BORDER
        keep[1:] |= s[:-1] != _BORDER
        begins = offsets[:-1][np.diff(offsets) > 0]
        keep[begins] = s[begins] != _BORDER
        classes = self.classes[s[keep]]
        at = np.append(0, np.cumsum(keep))[offsets]
        sizes = np.diff(at)
        runs = -(-sizes // RUN_BYTES)
        row = np.repeat(np.arange(rows), runs)
        start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN_BYTES
        length = np.minimum(RUN_BYTES, at[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        counts = np.zeros((languages, len(row)), np.int32)
        ended = np.zeros((languages, len(row)), np.int32)
        roots = np.array(self.roots, np.int32)[:, None]
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            begin, size = start[lanes], length[lanes]
            state = np.repeat(roots, len(lanes), axis=1)
            count = np.zeros((languages, len(lanes)), np.int32)
            active = len(lanes)
            for step in range(int(size[0])):
                while size[active - 1] <= step:
                    active -= 1
                move = self.moves[state[:, :active] + classes[begin[:active] + step]]
                count[:, :active] += move & 1
                state[:, :active] = move >> 1
            counts[:, lanes] = count
            ended[:, lanes] = state
        self._join(classes, row, start, length, counts, ended)
        out = np.zeros((rows, languages))
        for k in range(languages):
            out[:, k] = np.bincount(row, counts[k], rows)
        return out, sizes

    def _join(self, classes, row, start, length, counts, ended) -> None:
        """Corrects the counts of runs that do not begin a text, and the states they end in, to those of whole texts.

        A run was parsed as if a phrase began with it. It is parsed again from the state in which the run before it ends,
        beside the parse from the root, until both are in one state, which mostly takes a few phrases. Where they are not
        by the end of the run, its end state was wrong, and the next run is done again.
        """
        inner = np.flatnonzero(row[1:] == row[:-1]) + 1
        language, run = np.repeat(np.arange(len(counts)), len(inner)), np.tile(inner, len(counts))
        plain, rooted, last = counts.copy(), ended.copy(), np.append(row[1:] != row[:-1], True)
        roots = np.array(self.roots, np.int32)
        while len(run):
            a, b = roots[language], ended[language, run - 1]
            at, size = start[run], length[run]
            more, settled = np.zeros(len(run), np.int64), a == b
            end_a, end_b = a.copy(), b.copy()
            act, step = np.flatnonzero(~settled), 0
            a, b = a[act], b[act]
            while len(act):
                symbol = classes[at[act] + step]
                move_a, move_b = self.moves[a + symbol], self.moves[b + symbol]
                more[act] += (move_b & 1) - (move_a & 1)
                a, b = move_a >> 1, move_b >> 1
                step += 1
                stop = (a == b) | (size[act] == step)
                if stop.any():
                    end_a[act[stop]], end_b[act[stop]] = a[stop], b[stop]
                    going = ~stop
                    act, a, b = act[going], a[going], b[going]
            counts[language, run] = plain[language, run] + more
            own = np.where(end_a == end_b, rooted[language, run], end_b)  # where they met, the rest is the same
            moved = own != ended[language, run]
            ended[language, run] = own
            on = moved & ~last[run]
            language, run = language[on], run[on] + 1

    def predict(self, data: np.ndarray, offsets: np.ndarray, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every row: the fewest bits, phrases times the bits that name a place in the text."""
        if not self.languages:
            return [UNKNOWN] * len(has_letter), np.zeros(len(has_letter))
        counts, _ = self.phrases(data, offsets)
        bits = counts * np.log2(self.sizes)[None, :]
        best = bits.argmin(axis=1)
        more = np.minimum(bits - bits.min(axis=1, keepdims=True), 60.0)
        score = 1.0 / np.exp2(-more).sum(axis=1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return names, np.where(has_letter, score, 0.0)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row holds a letter: at once for ASCII, and character by character for rows without an ASCII letter."""
    ascii_letter = np.append(0, np.cumsum((data >= 0x61) & (data <= 0x7A)))
    out = np.diff(ascii_letter[offsets]) > 0
    wide = np.append(0, np.cumsum(data >= 0x80))
    for r in np.flatnonzero(~out & (np.diff(wide[offsets]) > 0)).tolist():
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode())
    return out


def with_language(docs: DataFrame, sample: dict[str, str], text: str = "text") -> tuple[DataFrame, str, str]:
    """All rows and columns of ``docs`` with two more, and their names: predicted language, score from 0 to 1.

    Only the text is looked at, all of it. A text that is null or has no letter is ``und`` with score 0. The score is
    the winner's share when the bits of all languages are read as log-likelihoods; ties go to the first name.
    """
    name = "_"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    predicted, score = f"{name}lang", f"{name}score"
    at, names = docs.columns.index(text), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(sample)

    def predict(batches):
        import pyarrow.compute as pc

        state = worker_state("language")
        if state.get("sample") != sent.value:
            state["sample"], state["parser"] = sent.value, CrossParser(sent.value)
        parser = state["parser"]
        for batch in batches:
            for first, end, data, offsets in chunks(pc.utf8_lower(batch.column(at)), 1_000_000):
                found, scores = parser.predict(data, offsets, lettered(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    [*names, predicted, score],
                )

    schema = T.StructType([*docs.schema, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(predict, schema), predicted, score


def learnt(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, str]:
    """The training sample of ``docs``: labelled rows outside the held-out fold."""
    rows = docs.filter(~F.coalesce(held_out(F.col(doc_id)), F.lit(True)))
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return training_sample(rows, "lang", "text")


def identify(docs: DataFrame, sample: dict[str, str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, predicted, score = with_language(keyed, sample)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(predicted).alias("lang_pred"), F.col(score).alias("score")
    )


def with_known_language(docs: DataFrame, sample: dict[str, str], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for which some language is predicted, with their own columns."""
    rows, predicted, _ = with_language(docs, sample, text)
    return rows.filter(F.col(predicted) != UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))
