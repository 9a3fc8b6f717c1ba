"""Ids of whole Arrow columns from a public tokenizer file, with a bounded word cache.

The tokenizer's normaliser and splitter never look across white space, so a
text's ids are those of its white-space separated chunks, in order. Chunks are
hashed as one array; known ones are looked up, unknown ones are encoded in one
call to the library, a batch of them joined by a special token, which no chunk
contains and the library cuts at first. A chunk whose bytes look like a special
token isn't lower-cased or cached.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clipledger.llm.base import hash_words, lower_bytes, row_starts, runs, slices, word_bounds

#: Ids of the cached chunks; beyond this the cache of a Python worker starts anew.
CACHE_WORDS, CACHE_IDS, FIRST_SLOTS = 1 << 20, 1 << 23, 1 << 12
JOINED = 256
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[0x2C, 0x2E]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """The file's place on this machine; workers ask for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a tokenizer file whose splitter separates at white space and at a last full stop or comma."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        special = self.library.get_added_tokens_decoder()
        #: A special token as (id, text): spelt so that ``_rows`` keeps texts with it apart, cut out before any other rule.
        self.mark = next(((k, x.content) for k, x in sorted(special.items()) if x.special and not x.normalized and not x.single_word and not x.lstrip and not x.rstrip and "<|" in x.content), None)
        self._clear()

    def _clear(self) -> None:
        self._slots(FIRST_SLOTS)
        self.pool = np.zeros(1 << 16, self.width)
        self.words = self.used = 0

    def _slots(self, many: int) -> None:
        self.slots = np.zeros(many, np.uint64)
        self.start = np.zeros(many, np.int32)
        self.count = np.zeros(many, np.int32)

    def _claim(self, keys: np.ndarray) -> np.ndarray:
        """Give each new key a slot; of keys that want the same free one the first gets it."""
        mask = np.int64(len(self.slots) - 1)
        at = (keys >> np.uint64(40)).astype(np.int64) & mask
        left = np.arange(len(keys))
        while len(left):
            want = left[self.slots[at[left]] == 0]
            _, first = np.unique(at[want], return_index=True)
            self.slots[at[want[first]]] = keys[want[first]]
            left = left[self.slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        return at

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't cached (open addressing)."""
        mask = np.int64(len(self.slots) - 1)
        at = (keys >> np.uint64(40)).astype(np.int64) & mask
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.slots[at[open_]]
            same = held == keys[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same & (held != 0)]
            at[open_] = (at[open_] + 1) & mask
        return found

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, ids per chunk) from the library."""
        if self.mark is None:
            ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter((y for x in ids for y in x), self.width), np.array([len(x) for x in ids], np.int64)
        number, mark = self.mark
        joined = [mark.join([*texts[a : a + JOINED], ""]) for a in range(0, len(texts), JOINED)]
        flat = np.concatenate([np.array(x.ids, self.width) for x in self.library.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == number)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _store(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.width)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.words += len(keys)
        if 2 * self.words > len(self.slots):
            held = np.flatnonzero(self.slots)
            old = self.slots[held], self.start[held], self.count[held]
            self._slots(1 << (4 * self.words - 1).bit_length())
            at = self._claim(old[0])
            self.start[at], self.count[at] = old[1:]
        at = self._claim(keys)
        self.start[at], self.count[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, words = word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, self.width), np.zeros(len(offsets) - 1, np.int64)
        low = lower_bytes(data)
        # "word." is "word" and ".": fewer different chunks, the same ids
        cut = (ends - starts > 1) & _TAIL[data[ends - 1]]
        cut[cut] &= _LETTER[data[ends[cut] - 2]]
        many = 1 + cut
        spot = np.cumsum(many) - many
        a = np.empty(int(many.sum()), np.int64)
        b = np.empty_like(a)
        a[spot], b[spot] = starts, ends - cut
        a[spot[cut] + 1], b[spot[cut] + 1] = ends[cut] - 1, ends[cut]
        keys = hash_words(low, a, b) | np.uint64(1)
        odd = np.zeros(len(a), bool)
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        if len(marks):
            odd[np.searchsorted(a, marks, "right") - 1] = True
        slot = self._find(keys)
        new = np.flatnonzero((slot < 0) & ~odd)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            if self.words + len(fresh) > CACHE_WORDS or self.used > CACHE_IDS:
                self._clear()
                fresh, where = np.unique(keys[~odd], return_index=True)
                new = np.flatnonzero(~odd)
            raw = low.tobytes()
            texts = [raw[i:j].decode("utf-8") for i, j in zip(a[new[where]].tolist(), b[new[where]].tolist())]
            if len(fresh) <= CACHE_WORDS:
                self._store(fresh, *self._encode(texts))
                slot = self._find(keys)
        if odd.any() or (slot < 0).any():
            return self._plain(data, offsets)
        count = self.count[slot].astype(np.int64)
        ids = self.pool[runs(self.start[slot].astype(np.int64), count)]
        per_row = np.diff(row_starts(count)[np.searchsorted(a, offsets)])
        return ids, per_row

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        rows = [self.library.encode(raw[i:j].decode("utf-8"), add_special_tokens=False).ids for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        counts = np.array([len(x) for x in rows], np.int64)
        return np.fromiter((y for x in rows for y in x), self.width, int(counts.sum())), counts

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, first id of each row and the end) of slices of a text column."""
        for first, last, data, offsets in slices(column):
            ids, counts = self._rows(data, offsets)
            yield first, last, ids, row_starts(counts)


def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

