"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

The two vocabularies split a text by patterns none of which matches a character other than white space followed by white
space, or a letter followed by a mark. So a text may be cut before any space or line feed that follows such a character, and
before an ASCII mark that follows an ASCII letter: the ids of the parts, put together, are those of the text. Parts repeat,
so their ids are kept; for a vocabulary that lower-cases, A-Z is lower-cased first. Texts with any other white space are
encoded whole. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from revwatch.llm.store import worker_state
from revwatch.llm.texts import CHUNK_BYTES, LOWER, binary, chunks, distinct, gather

KEPT_WORDS = 200_000

# ASCII letters, and marks: printable ASCII other than letters, digits and space.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_MARK[0x30:0x3A] = False


#: How byte-level vocabularies write a byte: printable ones as themselves, the others as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}

# Parts that are one word of Latin letters, behind a space or not: no pattern splits them, and their normal form is theirs.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
_LOWER_WORD = re.compile(rb" ?(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")


class WordMemory:
    """Ids of words seen before, in two generations of at most ``KEPT_WORDS`` words, so that memory stays bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.model = self.tokenizer.model
        self.plain = (_LOWER_WORD if self.lowers else _WORD).fullmatch
        self.old, self.new = {}, {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct parts, each an array of 16-bit numbers (both vocabularies fit)."""
        out = [self.new.get(p) for p in parts]
        unseen = []
        for i, found in enumerate(out):
            if found is None:
                found = self.old.get(parts[i])
                if found is None and self.plain(parts[i]):
                    # The merges alone; a vocabulary that drops white space has no use for the space.
                    word = parts[i].lstrip(b" ") if self.lowers else parts[i]
                    merged = self.model.tokenize(word.decode("latin-1").translate(_WRITTEN))
                    out[i] = self.new[parts[i]] = array("H", [t.id for t in merged]).tobytes()
                elif found is None:
                    unseen.append(i)
                else:
                    out[i] = self.new[parts[i]] = found
        for at in range(0, len(unseen), 256):
            some = unseen[at : at + 256]
            coded = self.tokenizer.encode(
                [parts[i].decode() for i in some], is_pretokenized=True, add_special_tokens=False
            )
            ids = np.array(coded.ids, np.uint16)
            borders = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            for j, i in enumerate(some):
                out[i] = self.new[parts[i]] = ids[borders[j] : borders[j + 1]].tobytes()
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        return out


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Where white space other than space and line feed may begin; bytes that merely look like it are included."""
    odd = ((data >= 9) & (data <= 13) & (data != 10)) | ((data >= 28) & (data <= 31))
    wide = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3)))
    if len(wide):
        lead, follow = data[wide], data[wide + 1]
        found = (
            ((lead == 0xC2) & ((follow == 0x85) | (follow == 0xA0)))
            | ((lead == 0xE1) & (follow == 0x9A))
            | ((lead == 0xE2) & ((follow == 0x80) | (follow == 0x81)))
            | ((lead == 0xE3) & (follow == 0x80))
        )
        odd[wide[found]] = True
    return odd


def encode_rows(
    column: pa.Array, path: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, ids, ids per row) of a text column; null counts as empty."""
    state = worker_state("words")
    if path not in state:
        state[path] = WordMemory(path)
    memory = state[path]
    for first, end, data, offsets in chunks(column, limit):
        rows = end - first
        if not len(data):
            yield first, end, np.empty(0, np.uint16), np.zeros(rows, np.int64)
            continue
        space = (data == 32) | (data == 10)
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        odd = np.flatnonzero(_odd_space(data))
        whole = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        per_row = np.diff(np.searchsorted(starts, offsets))
        parts = binary(LOWER[data] if memory.lowers else data, np.append(starts, len(data)))
        numbers, values = distinct(parts)
        if len(whole):
            # The words of these rows are left to the library's own splitting.
            in_whole = np.zeros(rows, bool)
            in_whole[whole] = True
            numbers = numbers.copy()
            numbers[np.repeat(in_whole, per_row)] = -1
            used, back = np.unique(numbers, return_inverse=True)
            values = [b"" if i < 0 else values[i] for i in used]
            numbers = back
        coded = memory.ids(values)
        sizes = np.fromiter((len(x) for x in coded), np.int64, len(coded)) // 2
        pool = np.frombuffer(b"".join(coded), np.uint16)
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[numbers]
        ids = pool[gather(begins[numbers], lengths)]
        borders = np.append(0, np.cumsum(lengths))
        row_borders = borders[np.append(0, np.cumsum(per_row))]
        counts = np.diff(row_borders)
        if len(whole):
            pieces = []
            for r in range(rows):
                if in_whole[r]:
                    own = memory.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode())
                    pieces.append(np.array(own, np.uint16))
                    counts[r] = len(own)
                else:
                    pieces.append(ids[row_borders[r] : row_borders[r + 1]])
            ids = np.concatenate(pieces)
        yield first, end, ids, counts
