"""Plain Python versions of what the text queries have to return."""

import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
LATIN = re.compile("[A-Za-zÀ-ÿ]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def spaced_words(text):
    return SPACED.findall((text or "").translate(LOWER))


def fingerprint(text, words=4):
    w = spaced_words(text)
    shingles = [" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(prints, max_bits=4):
    """Smallest id per row, over (id, fingerprint) pairs; a null id counts as larger than any."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(prints))]


def contamination(docs, items, window=13):
    out = []
    split = [(i, WORDS.findall((t or "").translate(LOWER))) for i, t in items if t is not None]
    for doc, text in docs:
        w, hit, held = WORDS.findall((text or "").translate(LOWER)), set(), set()
        for item, own in split:
            n = min(window, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        held.add(str(item))
        out.append((doc, len(w), len(hit), sorted(held), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def language_model(docs, learns, weight):
    """doc rows (id, text) in order -> (n_tokens, n_known, train_tokens, base, score) per row."""
    tokens = [[*spaced_words(t), ""] for _, t in docs]
    one, two, texts = Counter(), Counter(), 0
    for (doc, _), t in zip(docs, tokens, strict=True):
        if learns(doc):
            one.update(t)
            two.update(zip([" ", *t], t, strict=False))
            texts += 1
    total, kinds = sum(one.values()), len(one)
    context = Counter(one)
    context[" "] = texts
    out = []
    for t in tokens:
        p1 = [(one[w] + 1) / (total + kinds + 1) for w in t]
        mixed = [
            two[h, w] / (context[h] + weight) + weight / (context[h] + weight) * p
            for h, w, p in zip([" ", *t], t, p1, strict=False)
        ]
        out.append((len(t), sum(one[w] > 0 for w in t), total, sum(map(math.log10, p1)), sum(map(math.log10, mixed))))
    return out


def in_fold(doc, modulus, fold=2):
    return zlib.crc32(str(doc).encode()) % modulus == fold


def jaccard_groups(rows, words=5):
    """(id, set size, smallest id that links reach) per row; a null id is named only by itself."""
    sets = []
    for _, text in rows:
        w = spaced_words(text)
        sets.append({" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = len(a & b)
            if a and b and 100 * same >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


SYMBOLS = {c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in ".,;:'\"-()?!|"}


def text_statistics(text):
    """What the labellers of the quality classifier look at, per text."""
    words = SPACED.findall(text or "")
    size = max(sum(len(w.encode()) for w in words), 1)
    n, low = max(len(words), 1), [w.translate(LOWER) for w in words]
    count = lambda f: sum(map(f, text or ""))
    upper, lower = (lambda c: "A" <= c <= "Z"), (lambda c: "a" <= c <= "z")
    return {
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "symbols": count(lambda c: c in SYMBOLS) / size,
        "capitals": count(upper) / max(count(upper) + count(lower), 1),
        "digits": count(lambda c: "0" <= c <= "9") / size,
        "repeated": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        "variety": min(len(set(low)) / n * math.sqrt(max(len(words), 100) / 100), 1.0),
        "pipes": count(lambda c: c == "|") / size,
        "shouting": sum(any(map(upper, w)) and not any(map(lower, w)) for w in words) / n,
        "cells": sum("|" in w for w in words) / n,
        "marked": sum(w[-1] in SYMBOLS for w in words) / n,
    }


def text_votes(text, labellers):
    stats = text_statistics(text)
    if not stats["words"]:
        return "-" * len(labellers)
    out = ""
    for name, side, bad, good in labellers:
        v = stats[name]
        against, favour = (v < bad, v >= good) if side == "below" else (v > bad, v <= good)
        out += "-" if against else "+" if favour else "."
    return out


def label_model(ballots, rounds=100):
    """Expectation-maximisation text by text: (share of good ones, chances of votes per class and labeller)."""
    k = len(ballots[0]) if ballots else 0
    q = []
    for b in ballots:
        mean = (b.count("+") - b.count("-")) / k
        q.append(0.1 if "-" in b else 0.9 if mean > 0.3 else 0.5)
    for _ in range(rounds):
        chances = []
        for weight in ([1 - x for x in q], q):
            rows = []
            for j in range(k):
                sums = [1 + sum(w for w, b in zip(weight, ballots, strict=True) if b[j] == v) for v in "-.+"]
                rows.append({v: s / sum(sums) for v, s in zip("-.+", sums, strict=True)})
            chances.append(rows)
        prior = (sum(q) + 1) / (len(ballots) + 2)
        after = [label_posterior(b, prior, chances) for b in ballots]
        done = max((abs(a - x) for a, x in zip(after, q, strict=True)), default=0) < 1e-9
        if done:
            break
        q = after
    return prior, chances


def label_posterior(ballot, prior, chances):
    logs = [sum(math.log(chances[c][j][v]) for j, v in enumerate(ballot)) for c in (0, 1)]
    odds = logs[1] - logs[0] + math.log(prior) - math.log(1 - prior)
    return 1 / (1 + math.exp(-max(min(odds, 50), -50)))


def shape(word):
    kind = lambda c: "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c > "\x7f" else "0" if "0" <= c <= "9" else c
    out = ""
    for c in map(kind, word):
        out += "" if out[-1:] == c else c
    return out


def scorer_features(text, features):
    """Hashed number -> share of words: spellings, shapes, and whether a word repeats the one before."""
    words, out = SPACED.findall(text or ""), Counter()
    low = [w.translate(LOWER) for w in words]
    number = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed) % features
    for k, w in enumerate(words):
        out[number(low[k], 1)] += 1
        out[number(shape(w), 2)] += 1
        out[number("=" if k and low[k] == low[k - 1] else "", 3)] += 1
    return {c: n / len(words) for c, n in out.items()}


def scorer(rows, target, steps=300):
    """(weights by feature, bias) by full-batch Adam on the balanced logistic loss."""
    w, m, s = Counter(), Counter(), Counter()
    all_good, all_bad = max(sum(target), 1e-9), max(sum(1 - t for t in target), 1e-9)
    balance = [t / all_good + (1 - t) / all_bad for t in target]
    for step in range(1, steps + 1 if rows else 1):
        g = Counter()
        for own, b, t in zip(rows, balance, target, strict=True):
            score = sum(w[c] * v for c, v in own.items()) + w["bias"]
            error = b * (1 / (1 + math.exp(-max(min(score, 30), -30))) - t) / 2
            g["bias"] += error
            for c, v in own.items():
                g[c] += error * v
        for c in list(g):
            g[c] += 1e-6 * w[c]
            m[c], s[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * s[c] + 0.001 * g[c] ** 2
            w[c] -= 0.1 * (m[c] / (1 - 0.9**step)) / (math.sqrt(s[c] / (1 - 0.999**step)) + 1e-8)
    return w


def quality(docs, labellers, features):
    """Per (id, text) row (id, score, posterior, votes, keep): labels learnt from all rows, the scorer from distinct texts."""
    ballots = [text_votes(t, labellers) for _, t in docs]
    prior, chances = label_model(ballots)
    goals = [label_posterior(b, prior, chances) for b in ballots]
    rows = [scorer_features(t, features) for _, t in docs]
    first = {t: k for k, (_, t) in reversed(list(enumerate(docs)))}.values()
    w = scorer([rows[k] for k in first], [goals[k] for k in first])
    out = []
    for (doc, _), ballot, goal, own in zip(docs, ballots, goals, rows, strict=True):
        value = sum(w[c] * v for c, v in own.items()) + w["bias"]
        score = 1 / (1 + math.exp(-max(min(value, 30), -30))) if own else 0.0
        out.append((doc, score, goal, ballot, score >= 0.5))
    return out
