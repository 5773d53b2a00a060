"""A worker's table of the words it has met, looked up for whole byte arrays at once.

A word is read as up to four overlapping 64-bit pieces at its two ends, which are the whole of a word of
at most 32 bytes. A hash of the pieces finds a word and the pieces are then compared; longer words are
compared byte by byte. Two words with one hash are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes whose words are looked up together, and words after which the table is emptied.
SLICE, LIMIT = 1 << 20, 700_000
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``first[k] .. first[k] + sizes[k] - 1`` of all k, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The four 64-bit pieces of each word: first, last, second and last but one; zero where a word has no such."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = [at[starts] & MASKS[np.minimum(sizes, 8)]]
    for least, offset in ((8, sizes - 8), (16, 8), (24, sizes - 16)):
        piece = np.zeros(len(starts), np.uint64)
        k = np.flatnonzero(sizes > least)
        piece[k] = at[starts[k] + (offset if least == 16 else offset[k])]
        out.append(piece)
    return out


class WordTable:
    """Words and the ids that ``learn`` gives them: ``learn(words) -> (ids, at)``, ``at`` one longer than words."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hash, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64)
        self.pieces = [np.zeros(1 << 14, np.uint64) for _ in range(4)]
        self.ids_at, self.ids = np.zeros((1 << 14) + 1, np.int64), np.zeros(1 << 16, np.uint32)
        self.long: dict[int, bytes] = {}
        self.odd: dict[bytes, int] = {}

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = len(self.slots) - 1
        at = self._place(h)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        while len(left):
            at[left] = (at[left] + 1) & mask
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.hash[out[left]] != h[left])]
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        mask, left = len(self.slots) - 1, numbers.astype(np.int32)
        at = self._place(self.hash[left])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot, the last wins
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & mask

    def _store(self, words: list[bytes], h: np.ndarray, parts: list[np.ndarray], visible: bool) -> None:
        ids, at = self.learn(words)
        k, n = self.n, self.n + len(words)

        def room(a, size):
            return a if size <= len(a) else np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)])

        self.hash, self.size, self.ids_at = room(self.hash, n), room(self.size, n), room(self.ids_at, n + 1)
        self.pieces = [room(p, n) for p in self.pieces]
        self.hash[k:n], self.size[k:n] = h, np.fromiter(map(len, words), np.int64, len(words))
        for p, new in zip(self.pieces, parts, strict=True):
            p[k:n] = new
        self.long |= {k + i: words[i] for i in np.flatnonzero(self.size[k:n] > 32).tolist()}
        self.ids_at[k + 1:n + 1] = self.ids_at[k] + at[1:]
        self.ids = room(self.ids, int(self.ids_at[n]))
        self.ids[self.ids_at[k]:self.ids_at[n]] = ids
        self.n = n
        if not visible:
            return
        if n * 3 > len(self.slots):
            self.slots = np.full(1 << int(np.ceil(np.log2(n * 6))), -1, np.int32)
            _, first = np.unique(self.hash[:n], return_index=True)
            self._insert(first)
        else:
            self._insert(np.arange(k, n))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word ``data[starts[k]:ends[k]]``; unknown words are learned."""
        if self.n > self.limit:
            self.clear()
        sizes = ends - starts
        parts = pieces(data, starts, sizes)
        h = sizes.astype(np.uint64) * MIX[4]
        for p, m in zip(parts, MIX, strict=False):
            h = (h ^ p) * m
            h ^= h >> np.uint64(29)
        h *= MIX[0]
        found = self._find(h).astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            first, raw = new[first], data.tobytes()
            self._store([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)],
                        keys, [p[first] for p in parts], True)
            found[new] = self._find(h[new])
        wrong = (self.size[found] != sizes) | (self.pieces[0][found] != parts[0]) | (self.pieces[1][found] != parts[1])
        wide = np.flatnonzero(sizes > 16)
        wrong[wide] |= (self.pieces[2][found[wide]] != parts[2][wide]) | (self.pieces[3][found[wide]] != parts[3][wide])
        for i in wide[sizes[wide] > 32].tolist():
            wrong[i] |= self.long.get(int(found[i])) != data[starts[i]:ends[i]].tobytes()
        for i in np.flatnonzero(wrong).tolist():
            word = data[starts[i]:ends[i]].tobytes()
            if word not in self.odd:
                self.odd[word] = self.n
                self._store([word], h[i:i + 1], [p[i:i + 1] for p in parts], False)
            found[i] = self.odd[word]
        return found

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in one array, and how many each word has."""
        first = self.ids_at[numbers]
        sizes = self.ids_at[numbers + 1] - first
        return self.ids[ragged(first, sizes)], sizes
