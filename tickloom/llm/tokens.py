"""Ids of whole texts, each distinct chunk of a worker's texts encoded once.

Texts are cut where the tokenizer's own pre-tokenizer always cuts, so ids of chunks in a row
are the ids of the text:

* `spaced` vocabularies (byte-level, white space kept): before the last white space character
  of a run that is followed by a word, around other runs, as `" ?\\S+|\\s+(?!\\S)|\\s"` does.
  Texts with white space beyond ASCII are one chunk.
* other vocabularies (white space dropped): at ASCII white space.
* both: between a letter (of ASCII or Latin-1) and ASCII punctuation, except after an
  apostrophe, which may begin a contraction.

The string of a special token in a text is that token's id, as the library has it by default; a text
with one is a single chunk.

Chunks meet by the 64-bit hashes of `bytestext`; a worker keeps at most `CACHE` of them, so two of them
share a hash with a probability of about one in a million.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

from tickloom.llm.bytestext import _SPACE, ROLLS, U, counted

CACHE = 2_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _inner_cuts(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token always begins at a byte inside a word."""
    cut = np.zeros(len(data), bool)
    sign = np.flatnonzero(_SIGN[data])
    # Signs are few: look at their neighbours only.
    left = sign[sign > 0] - 1
    last = data[left]
    letter = _LETTER[last] | (_LATIN[last] & (left > 0) & (data[left - 1] == 0xC3))
    cut[left[letter] + 1] = True
    right = sign[(sign < len(data) - 1) & (data[sign] != 0x27)] + 1
    letter = _LETTER[data[right]] | ((data[right] == 0xC3) & _LATIN[data[np.minimum(right + 1, len(data) - 1)]])
    cut[right[letter]] = True
    return cut


class Encoder:
    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = special[0]
        self.specials = re.compile(b"|".join(re.escape(text.encode()) for _, text in special))
        self.spaced = spaced
        self.size = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        #: Open addressing by the low bits of a chunk's hash; -1 is free.
        self.table = np.full(1 << (2 * CACHE - 1).bit_length(), -1, np.int32)
        self.n = self.n_ids = 0
        self.keys, self.starts, self.sizes = np.zeros(1 << 12, U), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 for new ones."""
        place = (hashes & U(len(self.table) - 1)).astype(np.int64)
        slots = self.table[place]
        open_ = np.flatnonzero((slots >= 0) & (self.keys[slots] != hashes))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.table) - 1)
            slots[open_] = self.table[place[open_]]
            own = slots[open_]
            open_ = open_[(own >= 0) & (self.keys[own] != hashes[open_])]
        return slots

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put new chunks, all different, into the table."""
        slots = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        place = (hashes & U(len(self.table) - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.table[place[left]] < 0]
            self.table[place[free]] = slots[free]
            # Of several chunks that took one place the last has it.
            left = left[self.table[place[left]] != slots[left]]
            place[left] = (place[left] + 1) & (len(self.table) - 1)
        starts = self.n_ids + np.cumsum(sizes) - sizes
        for name, value, first in (("keys", hashes, self.n), ("starts", starts, self.n), ("sizes", sizes, self.n), ("ids", ids, self.n_ids)):
            have = getattr(self, name)
            if first + len(value) > len(have):
                have = np.concatenate([have, np.zeros(max(len(have), len(value)), have.dtype)])
                setattr(self, name, have)
            have[first : first + len(value)] = value
        self.n += len(hashes)
        self.n_ids += len(ids)

    @staticmethod
    def _rows(pattern: re.Pattern, raw: bytes, offsets: np.ndarray) -> set[int]:
        """The rows that hold a match."""
        return {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in pattern.finditer(raw)}

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends."""
        n = len(data)
        first_of_row = np.zeros(n + 1, bool)
        first_of_row[offsets] = True
        first_of_row = first_of_row[:n]
        inside = ~_SPACE[data]
        before = np.concatenate([[False], inside[:-1]])
        word = inside & (~before | first_of_row)
        inner = _inner_cuts(data)
        raw = data.tobytes()
        whole = self._rows(self.specials, raw, offsets)
        if not self.spaced:
            opens = word | inner
            stop = inside.copy()
            stop[:-1] &= ~inside[1:] | first_of_row[1:] | inner[1:]
            for row in whole:
                a, z = offsets[row], offsets[row + 1]
                opens[a:z], stop[a:z] = False, False
                opens[a], stop[z - 1] = True, True
            return np.flatnonzero(opens), np.flatnonzero(stop) + 1
        opens = first_of_row | inner
        opens |= ~inside & before
        preceded = np.flatnonzero(word & ~first_of_row)
        opens[preceded - 1] = True
        opens[preceded[data[preceded - 1] != 0x20]] = True
        for row in whole | self._rows(_WIDE_SPACE, raw, offsets):
            opens[offsets[row] + 1 : offsets[row + 1]] = False
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], n)

    def _encode_all(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in turn and their number for each.

        Special tokens cut a text before anything else, so chunks with one between them are
        encoded in one call as if alone. Chunks that may hold one, or a part of one, go singly.
        """
        if any(b"<" in c for c in chunks):
            own = [self.tokenizer.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids if b"<" in c else None for c in chunks]
            rest, sizes = self._encode_all([c for c, x in zip(chunks, own, strict=True) if x is None])
            parts = iter(np.split(rest, np.cumsum(sizes)[:-1]))
            every = [next(parts) if x is None else np.array(x, np.int32) for x in own]
            return np.concatenate(every).astype(np.int32), np.array([len(x) for x in every], np.int64)
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        number, mark = self.mark
        text = (mark.encode().join(chunks) + mark.encode()).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(ids == number)
        return ids[ids != number], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and the offsets of rows in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends = self._chunks(data, offsets)
        hashes = ROLLS[0].spans(ROLLS[0].prefixes(data), starts, ends)
        slots = self._find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.n + len(keys) > CACHE and self.n:
                self._clear()
                new = np.arange(len(hashes))
                keys, first = np.unique(hashes, return_index=True)
            while 2 * (self.n + len(keys)) > len(self.table):
                self.table = np.full(2 * len(self.table), -1, np.int32)
            raw, at = data.tobytes(), new[first]
            self._add(keys, *self._encode_all([raw[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            slots[new] = self._find(hashes[new])
        sizes = self.sizes[slots].astype(np.int64)
        ids = self.ids[counted(self.starts[slots], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, before[np.searchsorted(starts, offsets)]


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder.

    Spark sends this module to workers by value, anew for every task, so what a worker
    keeps between tasks lies in a module of its own.
    """
    kept = sys.modules.setdefault("tickloom_worker", types.ModuleType("tickloom_worker"))
    held = kept.__dict__.setdefault("encoders", {})
    if (path, spaced) not in held:
        held[path, spaced] = Encoder(path, spaced)
    return held[path, spaced]
