"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwatch.llm.texts import LOWER, SPACE, binary, chunks, distinct, spans

#: Distinct texts that the scorer is trained on at most, chosen by hash. Accuracies are estimated over all texts.
TRAIN_DOCS = 4_000
FEATURES = 1 << 16
KEEP_FROM = 0.5

#: Labellers: the statistic, where it speaks against the text, and where it speaks for it. Every fault is looked at by two
#: of them, by characters and by words: a fault that only one of them sees would pass for a habit of good texts. The votes
#: of such a pair depend on each other, which the model leaves out, so its posteriors are too sure; with chances for pairs
#: of votes instead, nothing tells a fault from a habit, and more than half of the bad texts of the test tables are kept.
LABELLERS = (
    ("words", "below", 5.0, 40.0),
    ("word_length", "above", 14.0, 10.0),
    ("symbols", "above", 0.08, 0.03),
    ("capitals", "above", 0.30, 0.10),
    ("digits", "above", 0.25, 0.08),
    ("repeated", "above", 0.20, 0.02),
    ("variety", "below", 0.15, 0.30),
    ("pipes", "above", 0.02, 0.002),
    ("marked", "above", 0.30, 0.10),
    ("shouting", "above", 0.30, 0.10),
    ("cells", "above", 0.10, 0.02),
)

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?!|"]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[_UPPER], _CLASS[_LOWER], _CLASS[_DIGIT], _CLASS[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")


@dataclass
class Parsed:
    """Words of a run of texts: numbers of distinct words per word, words per text, and byte statistics per text."""

    coded: np.ndarray
    values: list[bytes]
    shapes: np.ndarray
    shape_values: list[bytes]
    per_row: np.ndarray
    repeated: np.ndarray
    stats: dict[str, np.ndarray]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets]).astype(np.float64)


def _any(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Per word whether any of its bytes is flagged."""
    return np.diff(np.append(0, np.cumsum(flags))[borders]) > 0


def parse(data: np.ndarray, offsets: np.ndarray) -> Parsed:
    inside = ~SPACE[data]
    starts, ends, per_row = spans(inside, offsets)
    body = data[inside]
    borders = np.append(0, np.cumsum(ends - starts))
    coded, values = distinct(binary(LOWER[body], borders)) if len(starts) else (np.empty(0, np.int32), [])
    # The shape of a word: classes of its characters, runs as one.
    classes = _CLASS[body]
    keep = np.ones(len(classes), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[borders[:-1]] = True
    shape_borders = np.append(0, np.cumsum(keep))[borders]
    shapes, shape_values = distinct(binary(classes[keep], shape_borders)) if len(starts) else (np.empty(0, np.int32), [])
    first = np.zeros(len(coded), bool)
    first[(np.cumsum(per_row) - per_row)[per_row > 0]] = True
    repeated = np.zeros(len(coded), bool)
    repeated[1:] = coded[1:] == coded[:-1]
    repeated &= ~first
    row = np.repeat(np.arange(len(per_row)), per_row)
    pairs = np.unique(row * np.int64(max(len(values), 1)) + coded)
    seen = np.bincount(pairs // max(len(values), 1), minlength=len(per_row))
    loud = _any(_UPPER[body], borders) & ~_any(_LOWER[body], borders)
    words, size = np.maximum(per_row, 1), np.maximum(_per_row(inside, offsets), 1)
    letters = np.maximum(_per_row(_UPPER[data] | _LOWER[data], offsets), 1)
    stats = {
        "words": per_row.astype(np.float64),
        "word_length": _per_row(inside & ((data & 0xC0) != 0x80), offsets) / words,
        "symbols": _per_row(_SYMBOL[data], offsets) / size,
        "capitals": _per_row(_UPPER[data], offsets) / letters,
        "digits": _per_row(_DIGIT[data], offsets) / size,
        "repeated": np.bincount(row, repeated, len(per_row)) / words,
        # The share of distinct words falls with length, so the expected share grows with its root.
        "variety": np.minimum(seen / words * np.sqrt(np.maximum(words, 100) / 100), 1.0),
        "pipes": _per_row(data == ord("|"), offsets) / size,
        "shouting": np.bincount(row, loud, len(per_row)) / words,
        "cells": np.bincount(row, _any(body == ord("|"), borders), len(per_row)) / words,
        "marked": np.bincount(row, _SYMBOL[body[borders[1:] - 1]], len(per_row)) / words,
    }
    return Parsed(coded, values, shapes, shape_values, per_row, repeated, stats)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Per text and labeller 0 (against), 1 (no opinion) or 2 (for); labellers of an empty text vote against."""
    out = np.ones((len(stats["words"]), len(LABELLERS)), np.int64)
    for k, (name, side, bad, good) in enumerate(LABELLERS):
        value = stats[name]
        out[:, k] = np.where(value < bad, 0, np.where(value >= good, 2, 1)) if side == "below" else np.where(
            value > bad, 0, np.where(value <= good, 2, 1)
        )
    out[stats["words"] == 0] = 0
    return out


def pattern_of(ballots: np.ndarray) -> np.ndarray:
    return ballots @ 3 ** np.arange(len(LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and per labeller the chances of its three votes for bad and for good texts."""

    prior: float
    chances: np.ndarray  # (2, labellers, 3)

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        index = np.arange(len(LABELLERS))
        logs = [np.log(self.chances[c, index, ballots]).sum(axis=1) for c in (0, 1)]
        odds = logs[1] - logs[0] + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Per labeller the chance that a vote it casts is right."""
        right = self.prior * self.chances[1, :, 2] + (1 - self.prior) * self.chances[0, :, 0]
        wrong = self.prior * self.chances[1, :, 0] + (1 - self.prior) * self.chances[0, :, 2]
        return right / (right + wrong)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns; one pseudo text per outcome, and majority votes to begin with."""
    ballots = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = (ballots - 1).sum(axis=1) / len(LABELLERS)
    # A single vote against outweighs a few votes for: labellers look at different faults.
    q = np.where((ballots == 0).any(axis=1), 0.1, np.where(good > 0.3, 0.9, 0.5))
    model = None
    for _ in range(rounds):
        chances = np.empty((2, len(LABELLERS), 3))
        for c, weight in enumerate((counts * (1 - q), counts * q)):
            for v in range(3):
                chances[c, :, v] = ((ballots == v) * weight[:, None]).sum(axis=0) + 1
        chances /= chances.sum(axis=2, keepdims=True)
        prior = float((counts @ q + 1) / (counts.sum() + 2))
        model = LabelModel(prior, chances)
        after = model.posterior(ballots)
        if np.abs(after - q).max(initial=0.0) < 1e-9:
            break
        q = after
    return model


def feature_numbers(parsed: Parsed) -> list[np.ndarray]:
    """Per word the hashed numbers of its spelling, its shape, and whether it repeats the word before."""
    import xxhash

    one = xxhash.xxh64_intdigest
    words = np.fromiter((one(v, 1) % FEATURES for v in parsed.values), np.int64, len(parsed.values))
    shapes = np.fromiter((one(v, 2) % FEATURES for v in parsed.shape_values), np.int64, len(parsed.shape_values))
    twice = np.array([one(b"", 3) % FEATURES, one(b"=", 3) % FEATURES])
    return [words[parsed.coded], shapes[parsed.shapes], twice[parsed.repeated.astype(np.int64)]]


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (the last one the bias) of a logistic scorer over mean feature values, by full-batch Adam."""
    column = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    w, m, s = (np.zeros(FEATURES + 1) for _ in range(3))
    # Both classes weigh the same in the loss.
    balance = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    for step in range(1, steps + 1 if len(rows) else 1):
        score = np.bincount(row, w[column] * value, len(rows)) + w[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / 2
        g = np.append(np.bincount(column, error[row] * value, FEATURES), error.sum()) + 1e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all texts; at most 3 to the number of labellers rows."""

    def count(batches):
        totals = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                totals += np.bincount(pattern_of(votes(parse(data, offsets).stats)), minlength=len(totals))
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], ["pattern", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "pattern bigint, n bigint")
    return rows.groupBy("pattern").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """(key, pattern, features, values) of at most ``limit`` texts: the distinct texts with the smallest hashes.

    Neither ids nor how often a text is repeated have a say. The hashes alone are ordered, the texts below the last one
    of them are featurised side by side.
    """

    def featurize(batches):
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                parsed = parse(data, offsets)
                row = np.repeat(np.arange(end - first), parsed.per_row)
                pattern = pattern_of(votes(parsed.stats))
                numbers = np.concatenate([row * np.int64(FEATURES) + f for f in feature_numbers(parsed)])
                keys, count = np.unique(numbers, return_counts=True)
                at = np.searchsorted(keys // FEATURES, np.arange(end - first + 1))
                share = count / np.maximum(parsed.per_row, 1)[keys // FEATURES]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(pattern),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys % FEATURES, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(share, pa.float32())),
                    ],
                    ["key", "pattern", "features", "values"],
                )

    rows = docs.select(F.xxhash64(text, F.lit("train")).alias("key"), F.col(text).cast("string").alias("text"))
    last = rows.select("key").distinct().orderBy("key").limit(limit).agg(F.max("key")).head()[0]
    chosen = rows.filter(F.col("key") <= F.lit(last)) if last is not None else rows.limit(0)
    # Each split sends a text once; texts of one hash, a matter of chance, count as one.
    distinct_texts = chosen.groupBy("key").agg(F.min("text").alias("text"))
    return distinct_texts.mapInArrow(featurize, "key bigint, pattern bigint, features array<int>, values array<float>")


def fit(docs: DataFrame, text: str = "text", limit: int = TRAIN_DOCS) -> QualityModel:
    """Label model over the votes on all texts, scorer on the posteriors of at most ``limit`` distinct texts.

    The driver sees the vote patterns, a number fixed by the labellers, and the hashed features of the training texts.
    """
    counts = vote_counts(docs, text).toPandas().sort_values("pattern")
    patterns, n = counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    labels = estimate(patterns, n)
    rows = sorted(training_rows(docs, text, limit).collect())
    ballots = np.array([r["pattern"] for r in rows], np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    target = labels.posterior(ballots) if rows else np.empty(0)
    sparse = [(np.array(r["features"], np.int64), np.array(r["values"], np.float64)) for r in rows]
    return QualityModel(labels, train(sparse, target))


def scored(docs: DataFrame, model: QualityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, score, label_posterior, votes, keep).

    ``score`` is the scorer's probability that the text is good, ``votes`` one of ``-``, ``.`` and ``+`` per labeller.
    A text without words (null, empty or blank) scores 0 and is not kept. Repeated rows are scored alike; an empty table
    gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.labels.prior, model.labels.chances, model.weights))

    def score(batches):
        prior, chances, weights = sent.value
        labels = LabelModel(prior, chances)
        signs = np.array(["-", ".", "+"])
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                parsed = parse(data, offsets)
                ballots = votes(parsed.stats)
                row = np.repeat(np.arange(end - first), parsed.per_row)
                total = sum(np.bincount(row, weights[f], end - first) for f in feature_numbers(parsed))
                value = total / np.maximum(parsed.per_row, 1) + weights[-1]
                value = np.where(parsed.per_row > 0, 1 / (1 + np.exp(-np.clip(value, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(value),
                        pa.array(labels.posterior(ballots)),
                        pa.array(["".join(x) for x in signs[ballots]], pa.string()),
                        pa.array(value >= KEEP_FROM),
                    ],
                    ["doc_id", "score", "label_posterior", "votes", "keep"],
                )

    schema = "doc_id bigint, score double, label_posterior double, votes string, keep boolean"
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(score, schema)
