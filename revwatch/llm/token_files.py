"""Token files: ids in documents' order, arithmetic-coded in blocks that are reset and checksummed each by itself.

After the last two ids (order 2) and after the last one (order 1) a block predicts the ids that it remembers there, by the
hit rates that it has learnt for their confidence; all other ids, and remembered ones that hit too seldom, are predicted by
order 0, which starts from the file's id counts and adapts to the block, without the ids that the higher orders give. So one adaptive distribution over all
ids drives the range coder, in one step per id, or two for an id that has no bucket of its own. Blocks share nothing but the
counts, so many are coded side by side, one id of each at a time.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revwatch.llm.store import partitions, shared_path
from revwatch.llm.tokens import encode_rows

BLOCK_IDS = 2048
#: Blocks that are coded side by side at most, and ids of a file, where a part has as many.
LANES = 8192
FILE_IDS = BLOCK_IDS * LANES
#: Bytes of text that are cut into words at once; fewer words are met twice in a larger chunk.
CHUNK_BYTES = 18_000_000
MAGIC = b"ACR4"

BUCKETS, GROUPS = 256, 32  # of order 0; a group is eight buckets, whose running sums are moved as one item of 16 bytes
_SHARED = 24  # buckets of several ids
_PRIOR, _GAIN_SHIFT = 2800, 12  # of order 0: what the file's counts weigh; an id that was met weighs 0xFFFF >> shift
#: Hit rates are parts of 65536; an id whose rate is below this is left to order 0 until it hits more often (1/7).
_TAKEN = np.uint16(9 << 10)
#: How fast hit rates follow, and what a hit adds to them: those of confidence 1, and the others.
_SLOW, _SLOW_HIT, _FAST, _FAST_HIT = np.uint16(6), np.uint16(1024 - 32), np.uint16(5), np.uint16(2048 - 64)
#: Hit rates to begin with, by confidence 0 to 3, of the id after two ids and of the first and second one after one id.
_RATES = ((0, 8000, 32000, 50000), (0, 5000, 12000, 36000), (0, 4000, 16000, 24000))
_NONE = 1 << 16
#: An entry of a context: an id, 14 bits that tell the context, two of confidence.
_ID, _CHECK, _SEEN, _32 = np.uint32(0xFFFF), np.uint32(0xFFFC), np.uint32(3), np.uint64(32)
_1, _MIX1, _MIX2 = np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x2C1B3C6D)
_WORDS, _BYTES = np.uint64(0x0001000100010001), np.uint64(0x0101010101010101)
_16, _56 = np.uint64(16), np.uint64(56)
_LEAST, _48 = np.uint64(1 << 48), np.uint64(48)


def _hashes() -> np.ndarray:
    h = (np.arange(_NONE + 1, dtype=np.uint32) + _1) * _MIX1
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    return (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)


_HASHES = _hashes()  # of all ids, and of none


class Order0:
    """What the file's id counts say: the ids by falling count, cut into 256 buckets in 32 groups of eight.

    The most frequent ids have a bucket each; the others share buckets of about the same mass, inside which the file's
    counts hold. Every block adapts the frequencies of its buckets.
    """

    def __init__(self, counts: np.ndarray):
        ids = np.flatnonzero(counts)
        ranked = ids[np.argsort(-counts[ids], kind="stable")]
        self.ids, self.counts = ranked, counts[ranked].astype(np.int64)
        self.upto = np.append(0, np.cumsum(self.counts))
        lone = len(ranked) if len(ranked) <= BUCKETS else BUCKETS - _SHARED
        first = np.arange(lone)
        if lone < len(ranked):
            mass = self.upto[lone] + (self.upto[-1] - self.upto[lone]) * np.arange(1, _SHARED) // _SHARED
            first = np.unique(np.concatenate([first, [lone], np.maximum(np.searchsorted(self.upto, mass), lone)]))
            first = first[first < len(ranked)]
        borders = np.append(first, len(ranked))
        self.rank, self.bucket = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.bucket[ranked] = np.repeat(np.arange(len(first)), np.diff(borders))
        self.base, self.size = self.upto[first], np.diff(self.upto[borders])
        self.head = ranked[first]
        self.shared = np.append(np.diff(borders) > 1, np.ones(BUCKETS - len(first), bool))
        self.first_shared = lone
        self.prior = np.zeros(BUCKETS, np.uint16)
        self.prior[: len(first)] = np.maximum(self.size * _PRIOR // self.upto[-1], 1) if len(ranked) else 0

    @cached_property
    def places(self) -> np.ndarray:
        """What stands at each place of the buckets of several ids, one after the other."""
        ranks = np.arange(self.first_shared, len(self.ids), dtype=np.uint16)
        return np.repeat(ranks, self.counts[self.first_shared :])


@lru_cache(1)
def _even() -> Order0:
    return Order0(np.ones(65536, np.int64))


class Model:
    """The adaptive model of ``lanes`` blocks that are coded side by side.

    After the last two ids (order 2) a block remembers one id, after the last id (order 1) two, each with a confidence.
    Their chances are the hit rates that the block has learnt for these confidences, so the orders are mixed by how well
    each did. All other ids have the rest, shared out by the block's order 0. All are parts of one row: that of order 0, in
    which the part of a remembered id with a bucket of its own has another length, and the part of any other remembered id is
    put in before its bucket.
    """

    def __init__(self, lanes: int, block_ids: int, order0: Order0):
        bits = max((block_ids - 1).bit_length(), 6)
        self.order0, self.lanes, self.lane = order0, lanes, np.arange(lanes)
        self.shift1, self.shift2 = np.uint32(32 - bits), np.uint32(31 - bits)
        # Two entries after one id, one after two ids.
        self.one, self.two = np.zeros(lanes << bits, np.uint64), np.zeros(lanes << (bits + 1), np.uint32)
        self.rates = np.repeat(np.array(_RATES, np.uint16).T.reshape(-1), lanes).reshape(4, 3, lanes)
        self.rate = np.array([[0], [lanes], [2 * lanes]])
        self.fine = np.repeat(order0.prior.reshape(GROUPS, 8).cumsum(axis=1, dtype=np.uint16).view(np.complex128), lanes)
        sums = order0.prior.reshape(GROUPS, 8).sum(axis=1).cumsum()
        self.sums = np.repeat(np.append(0, sums).astype(np.uint16), lanes).reshape(GROUPS + 1, lanes)
        self.total, self.shift = int(sums[-1]), _GAIN_SHIFT
        while self.total + (0xFFFF >> self.shift) * block_ids > 0xFFFF:
            self.shift += 1
        if self.shift > 15:
            raise ValueError(f"a block of {block_ids} ids is too long")
        self.gain = 0xFFFF >> self.shift
        self.more = np.triu(np.full((8, 8), self.gain, np.uint16)).view(np.complex128).reshape(-1)
        self.eight = self.lane << 3
        self.rows = np.repeat(np.arange(GROUPS, dtype=np.uint16), lanes).reshape(GROUPS, lanes)
        self.below, self.step = np.empty((GROUPS, lanes), bool), np.empty((GROUPS, lanes), np.uint16)
        self.hash = np.full(lanes, _HASHES[_NONE])
        self.mixed = self.hash * _MIX1
        self.check, self.held = np.empty((3, lanes), np.uint32), np.empty((3, lanes), np.uint32)
        self.pairs = np.empty((lanes, 2), np.uint32)

    def predict(self, n: int) -> np.ndarray:
        """Lengths of the rows of the first ``n`` blocks; places and lengths of the ids remembered in ``some`` of them."""
        h1, check, held = self.hash[:n], self.check[:, :n], self.held[:, :n]
        h2 = (h1 ^ self.mixed[:n]) * _MIX2
        np.bitwise_and(h2, _CHECK, out=check[0])
        np.bitwise_and(h1, _CHECK, out=check[1:])
        self.at1 = (h1 >> self.shift1) * np.int64(self.lanes) + self.lane[:n]
        self.at2 = (h2 >> self.shift2) * np.int64(self.lanes) + self.lane[:n]
        one = self.one.take(self.at1).view(np.uint32)
        held[0], held[1], held[2] = self.two.take(self.at2), one[::2], one[1::2]
        # What is left of an entry is its confidence, where it is of this context.
        seen = held & _ID
        seen ^= check
        seen *= seen <= _SEEN
        seen = self.seen = seen.astype(np.uint8)
        self.ids = held >> np.uint32(16)
        known = self.known = seen > 0
        twice = self.ids[1:] == self.ids[0]
        twice &= known[0]
        seen = seen.copy()
        seen[1:] *= ~twice  # remembered twice: once is enough
        self.fresh = seen == 1
        self.firm = np.bitwise_or.reduce(seen, axis=0) > 1
        taken = self.rates[1, :, :n] >= _TAKEN
        taken &= self.fresh
        some = self.some = (np.bitwise_or.reduce(taken, axis=0) | self.firm).nonzero()[0]
        total = np.full(n, self.total, np.uint64)
        if len(some):
            seen = self.firmly = seen.take(some, axis=1)
            self.own = seen * np.int64(3 * self.lanes) + (self.rate + some)
            p = self.p = self.rates.reshape(-1).take(self.own)
            taken = self.taken = (p >= _TAKEN) & (seen > 0)
            ids = self.asked = self.ids.take(some, axis=1)
            part = p * taken / 65536
            rest = 1 - part[0]
            for k in 1, 2:
                part[k] *= rest
                rest -= part[k]
            bucket = self.order0.bucket.take(ids)
            at = (bucket >> 3) * self.lanes + some
            begin, size = self._span(self.fine.view(np.uint16), (at << 3) + (bucket & 7), bucket & 7)
            at = self.at = self.sums.take(at) + begin
            size *= taken & ~self.order0.shared.take(bucket)
            left = np.maximum(self.total - size.sum(axis=0), 1)
            self.length = ((part * (left / rest)).astype(np.int64) + 1) * taken
            more = self.more_by = self.length - size
            place = self.place = at.copy()
            for k, other in (0, 1), (0, 2), (1, 2):
                first = at[k] <= at[other]
                place[other] += more[k] * first
                place[k] += more[other] * ~first
            total[some] += more.sum(axis=0).astype(np.uint64)
        return total

    @staticmethod
    def _span(sums: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the parts that end at ``sums[at]`` and have this place in their group."""
        begin = sums.take(at - 1)
        begin *= place > 0
        return begin.astype(np.int64), (sums.take(at) - begin).astype(np.int64)

    def part(self, n: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the buckets in the rows of order 0."""
        group, self.place0 = bucket >> 3, bucket & 7
        self.group = group.astype(np.uint16)
        self.at0 = group * self.lanes + self.lane[:n]
        self.ends = self.fine.take(self.at0).view(np.uint16)
        begin, size = self._span(self.ends, self.eight[:n] + self.place0, self.place0)
        begin += self.sums.take(self.at0)
        return begin, size

    def find(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets at the places ``at`` in the rows of order 0, their begins and lengths."""
        below = np.less_equal(self.sums[1:, :n], at.astype(np.uint16), out=self.below[:, :n])
        group = np.add.reduce(below.view(np.uint8), axis=0, dtype=np.uint8)
        self.group, group = group.astype(np.uint16), group.astype(np.int64)
        self.at0 = group * self.lanes + self.lane[:n]
        base = self.sums.take(self.at0)
        self.ends = self.fine.take(self.at0).view(np.uint16)
        inside = ((at - base).view(np.uint64) * _WORDS).repeat(2).view(np.uint16)
        self.place0 = ((self.ends <= inside).view(np.uint64) * _BYTES >> _56).view(np.int64)
        begin, size = self._span(self.ends, self.eight[:n] + self.place0, self.place0)
        begin += base
        return (group << 3) + self.place0, begin, size

    def moved(self, begin: np.ndarray, size: np.ndarray, hit: np.ndarray) -> None:
        """Turns parts of order 0 into those of the whole rows; ``hit`` tells which ids are remembered ones."""
        own = begin.take(self.some)
        own += (self.more_by * (self.at <= own)).sum(axis=0)
        length = size.take(self.some)
        for k in range(3):
            np.copyto(own, self.place[k], where=hit[k])
            np.copyto(length, self.length[k], where=hit[k])
        begin[self.some], size[self.some] = own, length

    def learn(self, n: int, now: np.ndarray) -> None:
        """Takes in the next id of every block, the one last asked for by ``part`` or ``find``."""
        step = np.subtract(self.group - np.uint16(1), self.rows[:, :n], out=self.step[:, :n])
        step >>= np.uint16(self.shift)
        self.sums[1:, :n] += step
        self.total += self.gain
        self.ends += self.more.take(self.place0).view(np.uint16)
        self.fine[self.at0] = self.ends.view(np.complex128)
        now32 = now.astype(np.uint32)
        same = self.ids == now32
        same &= self.known
        # Hit rates: those of the lowest confidence of all blocks, then those of the others.
        if len(some := self.some):
            tried = self.firmly > 1
            hit = same.take(some, axis=1)
            tried[1:] &= ~hit[0]
            tried[2] &= ~hit[1]
            rate = self.p >> _FAST
            rate -= hit * _FAST_HIT
            rate *= tried
            self.rates.reshape(-1)[self.own.reshape(-1)] = (self.p - rate).reshape(-1)
        tried, rate = self.fresh, self.rates[1, :, :n]
        tried[1:] &= ~same[0]
        tried[2] &= ~same[1]
        less = rate >> _SLOW
        less -= same * _SLOW_HIT
        less *= tried
        rate -= less
        # A new id after two ids; after one id the new one is the second, or the first of a new context.
        new = now32 << np.uint32(16)
        new |= _1
        new = new | self.check[:2, :n]
        new2, new1 = new
        known, pairs, held = self.known[1], self.pairs[:n], self.held
        pairs[:, 0] = np.where(known, held[1, :n], new1)
        np.multiply(new1, known, out=pairs[:, 1])
        # Ids that came again gain confidence, others lose it; the second id changes places with the first when it came.
        if len(some := (np.bitwise_or.reduce(same, axis=0) | self.firm).nonzero()[0]):
            new, held, same, seen = (x.take(some, axis=1) for x in (new, held[:, :n], same, self.seen))
            bare = held & ~_SEEN
            up = bare | np.minimum(seen + np.uint8(1), np.uint8(3))
            down = bare[1] | np.maximum(seen[1], np.uint8(2)) - np.uint8(1)
            new2[some] = np.where(same[0], up[0], np.where(seen[0] > 1, bare[0] | _1, new[0]))
            known = seen[1] > 0
            swap = same[2] & ~same[1]
            first = np.where(same[1], up[1], np.where(swap, bare[2] | np.uint32(2), down))
            second = np.where(same[1], held[2], np.where(swap, held[1], new[1]))
            pairs[some, 0] = np.where(known, first, new[1])
            pairs[some, 1] = second * known
        self.two[self.at2] = new2
        self.one[self.at1] = pairs.view(np.uint64).reshape(-1)
        np.multiply(self.hash[:n], _MIX1, out=self.mixed[:n])
        self.hash[:n] = _HASHES.take(now)


class RangeEncoder:
    """Numbers of 64 bits; a carry out of them goes into the last digit, which is held back, and from there at the end."""

    def __init__(self, lanes: int, digits: int):
        self.low, self.held = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint32)
        self.width = np.full(lanes, ~np.uint64(0), np.uint64)
        self.out = np.zeros((lanes, digits), np.uint32)
        self.used = np.zeros(lanes, np.int64)

    def room(self, digits: int) -> None:
        if self.used.max() + digits > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out[:, :digits]), np.zeros_like(self.out)], axis=1)

    def put(self, act: slice | np.ndarray, lane: np.ndarray, start: np.ndarray, share: np.ndarray, total: np.ndarray) -> None:
        """Narrows the lanes ``act`` to ``share`` of ``total`` parts from ``start`` on."""
        width = self.width[act] // total
        begin = width * start.view(np.uint64)
        width *= share.view(np.uint64)
        low = self.low[act] + begin
        held = self.held[act] + (low < begin)
        used = self.used[act].copy()
        out, row = self.out.reshape(-1), lane * self.out.shape[1]
        while (move := width < _LEAST).any():
            out[row + used] = held
            used += move
            held = np.where(move, (low >> _48).astype(np.uint32), held)
            shift = move * _16
            low <<= shift
            width <<= shift
        self.low[act], self.width[act], self.held[act], self.used[act] = low, width, held, used

    def finish(self) -> list[bytes]:
        """The digits of each lane, up to the shortest number inside its width."""
        self.room(2)
        last = self.low + (_LEAST - np.uint64(1))
        lane = np.arange(len(last))
        self.out[lane, self.used] = self.held + (last < self.low)
        self.out[lane, self.used + 1] = last >> _48
        while len((over := (self.out > 0xFFFF).nonzero())[0]):
            self.out[over] &= np.uint32(0xFFFF)
            self.out[over[0], over[1] - 1] += _1
        digits = self.out.astype("<u2")
        return [digits[i, 1 : n + 2].tobytes() for i, n in enumerate(self.used.tolist())]


class RangeDecoder:
    def __init__(self, payloads: list[bytes]):
        sizes = [len(p) // 2 for p in payloads]
        self.columns = max(sizes) + 8
        digits = np.zeros((len(payloads), self.columns), np.uint16)
        for i, p in enumerate(payloads):
            digits[i, : sizes[i]] = np.frombuffer(p, "<u2")
        self.width = np.full(len(payloads), ~np.uint64(0), np.uint64)
        self.code = np.zeros(len(payloads), np.uint64)
        for k in range(4):
            self.code = self.code << _16 | digits[:, k].astype(np.uint64)
        self.digits = digits.reshape(-1)
        self.at = np.arange(len(payloads)) * self.columns + 4

    def look(self, act: slice | np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which of ``total`` parts each lane of ``act`` stands in."""
        self.unit = self.width[act] // total
        return (self.code[act] // self.unit).view(np.int64)

    def take(self, act: slice | np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        """Narrows the lanes to the part found by ``look``, as ``RangeEncoder.put`` does."""
        code = self.code[act] - self.unit * start.view(np.uint64)
        width = self.unit * share.view(np.uint64)
        at = self.at[act].copy()
        while (move := width < _LEAST).any():
            shift = move * _16
            code <<= shift
            code |= self.digits.take(at).astype(np.uint64) * move
            at += move
            width <<= shift
        self.code[act], self.width[act], self.at[act] = code, width, at


def _lengths(total: int, block_ids: int) -> list[int]:
    return [min(block_ids, total - a) for a in range(0, total, block_ids)]


def _side_by_side(total: int, block_ids: int, lanes: int) -> list[list[int]]:
    """Lengths of all blocks, in runs of at most ``lanes`` blocks that are about as many."""
    lengths = _lengths(total, block_ids)
    runs = -(-len(lengths) // lanes)
    borders = [len(lengths) * k // runs for k in range(runs + 1)] if runs else []
    return [lengths[a:b] for a, b in zip(borders, borders[1:], strict=False)]


def encode_blocks(
    ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES, counts: np.ndarray | None = None
) -> list[bytes]:
    """The payloads of consecutive blocks of ``block_ids`` ids below 65536; only the last block may be shorter.

    ``counts`` of all ids shape order 0; without them, ids are alike at first. An id takes one step of the range coder
    if its block remembers it or it has a bucket of its own, else two.
    """
    order0 = _even() if counts is None else Order0(np.asarray(counts))
    out, at = [], 0
    for lengths in _side_by_side(len(ids), block_ids, lanes):
        own = ids[at : at + sum(lengths)]
        at += len(own)
        table = np.zeros((len(lengths), block_ids), np.uint16)
        table.reshape(-1)[: len(own)] = own
        table = np.ascontiguousarray(table.T)
        model, coder = Model(len(lengths), block_ids, order0), RangeEncoder(len(lengths), block_ids // 2 + 256)
        for step in range(lengths[0]):
            if step % 16 == 0:
                coder.room(16 * 8)
            n = len(lengths) if step < lengths[-1] else len(lengths) - 1
            now = table[step, :n].astype(np.int64)
            total = model.predict(n)
            bucket = order0.bucket.take(now)
            begin, size = model.part(n, bucket)
            shared = order0.shared.take(bucket)
            if len(some := model.some):
                hit = model.taken & (model.asked == now.take(some))
                model.moved(begin, size, hit)
                shared[some] &= ~hit.any(axis=0)
            coder.put(slice(n), model.lane[:n], begin, size, total)
            many = shared.nonzero()[0]
            if len(many):
                rank, bucket = order0.rank.take(now.take(many)), bucket.take(many)
                begin = order0.upto.take(rank) - order0.base.take(bucket)
                coder.put(many, many, begin, order0.counts.take(rank), order0.size.take(bucket).view(np.uint64))
            model.learn(n, now)
        out += coder.finish()
    return out


def decode_blocks(
    payloads: list[bytes], total: int, block_ids: int = BLOCK_IDS, lanes: int = LANES, counts: np.ndarray | None = None
) -> np.ndarray:
    """The ids that ``encode_blocks`` was given."""
    order0 = _even() if counts is None else Order0(np.asarray(counts))
    out, done = [], 0
    for lengths in _side_by_side(total, block_ids, lanes):
        table = np.zeros((block_ids, len(lengths)), np.uint16)
        model, coder = Model(len(lengths), block_ids, order0), RangeDecoder(payloads[done : done + len(lengths)])
        done += len(lengths)
        for step in range(lengths[0]):
            n = len(lengths) if step < lengths[-1] else len(lengths) - 1
            at = coder.look(slice(n), model.predict(n))
            if len(some := model.some):
                own = at.take(some)
                past = own >= model.place + model.length
                hit = (own >= model.place) & ~past
                own -= (model.more_by * past).sum(axis=0)
                for k in range(3):
                    np.copyto(own, model.at[k], where=hit[k])
                at[some] = own
            bucket, begin, size = model.find(n, at)
            now, shared = order0.head.take(bucket), order0.shared.take(bucket)
            if len(some):
                model.moved(begin, size, hit)
                own = now.take(some)
                for k in range(3):
                    np.copyto(own, model.asked[k], where=hit[k])
                now[some] = own
                shared[some] &= ~hit.any(axis=0)
            coder.take(slice(n), begin, size)
            many = shared.nonzero()[0]
            if len(many):
                bucket = bucket.take(many)
                base = order0.base.take(bucket)
                part = coder.look(many, order0.size.take(bucket).view(np.uint64)) + base
                rank = order0.places.take(part - order0.upto[order0.first_shared])
                coder.take(many, order0.upto.take(rank) - base, order0.counts.take(rank))
                now[many] = order0.ids.take(rank)
            table[step, :n] = now
            model.learn(n, now)
        out.append(table.T.reshape(-1)[: sum(lengths)])
    return np.concatenate(out) if out else np.empty(0, np.uint16)


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: head, index of documents and id counts with its checksum, and blocks with theirs."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    uses = np.bincount(ids, minlength=1)
    tail = counts.astype("<i8").tobytes() + uses.astype("<u4").tobytes()
    index = zlib.compress(known.tobytes() + numbers.tobytes() + tail, 1)
    payloads = encode_blocks(ids, counts=uses)
    parts = [MAGIC, struct.pack("<IIII", len(doc_ids), len(payloads), len(index), zlib.crc32(index)), index]
    for k, payload in enumerate(payloads):
        own = ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u2").tobytes()
        parts += [struct.pack("<IIII", len(own) // 2, len(payload), zlib.crc32(own), zlib.crc32(payload)), payload]
    return b"".join(parts)


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file; a wrong checksum is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, blocks, size, crc = struct.unpack_from("<IIII", data, 4)
    index = data[20 : 20 + size]
    if zlib.crc32(index) != crc:
        raise ValueError("the index of a token file is damaged")
    index = zlib.decompress(index)
    known = np.frombuffer(index, np.uint8, docs)
    numbers = np.frombuffer(index, "<i8", docs, docs)
    counts = np.frombuffer(index, "<i8", docs, 9 * docs)
    uses = np.frombuffer(index, "<u4", offset=17 * docs).astype(np.int64)
    at, payloads, checks, total = 20 + size, [], [], 0
    for _ in range(blocks):
        n, held, check, coded = struct.unpack_from("<IIII", data, at)
        payloads.append(data[at + 16 : at + 16 + held])
        if zlib.crc32(payloads[-1]) != coded:
            raise ValueError(f"block {len(checks)} of a token file is damaged")
        checks.append(check)
        at, total = at + 16 + held, total + n
    ids = decode_blocks(payloads, total, counts=uses)
    for k, check in enumerate(checks):
        if zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u2").tobytes()) != check:
            raise ValueError(f"block {k} of a token file is damaged")
    return [d if k else None for d, k in zip(numbers.tolist(), known.tolist(), strict=True)], counts, ids


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
    files_at_least: int = 1,
) -> str:
    """Writes the ids of all texts, each followed by ``end_id``, and returns the folder.

    Documents are in ascending order of their ids, null ids first and rows with one id in the order of a hash of their
    texts; a null text is an empty one. The folder is a Parquet table with one file of the format above per row:
    (part, file, start_in_part, n_ids, data), parts and files in the documents' order. Ids must be below 65536.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows that are alike in id and text may be many; the running number lets a range end among them.
    order = ["doc_id", "tie", "row"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # Half as many parts as the session shuffles into: each has twice the blocks, which are coded side by side.
    parts = max(-(-partitions(spark) // 2), files_at_least)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["part", "file", "start_in_part", "n_ids", "data"]
        keys, counts, held, size, files, start = [], [], [], 0, 0, 0

        def made():
            per_doc, ids = np.concatenate(counts), np.concatenate(held)
            columns = [[part], [files], [start], [len(ids)], [file_bytes(keys, per_doc, ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for first, end, ids, n in encode_rows(batch.column(1), vocabulary, CHUNK_BYTES):
                total = n + 1
                full = np.full(int(total.sum()), end_id, np.uint16)
                is_text = np.ones(len(full), bool)
                is_text[np.cumsum(total) - 1] = False
                full[is_text] = ids
                keys += batch.column(0).slice(first, end - first).to_pylist()
                counts.append(total)
                held.append(full)
                size += len(full)
                if size >= FILE_IDS:
                    yield made()
                    files, start = files + 1, start + size
                    keys, counts, held, size = [], [], [], 0
        if keys:
            yield made()

    schema = "part int, file int, start_in_part bigint, n_ids bigint, data binary"
    made_files = ordered.select("doc_id", "text").mapInArrow(write, schema)
    made_files.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return path


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of a folder's files: (doc_id, start, n_tokens, ids_crc32), read back from the coded ids.

    ``start`` counts the ids of all documents before it. The running sum over the parts has one row per part.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))

    def read(batches):
        for batch in batches:
            for part, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts, ids = read_file(data)
                wide = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(keys), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(begins + start, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
                )

    schema = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    rows = files.select("part", "start_in_part", "data").mapInArrow(read, schema)
    return rows.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
