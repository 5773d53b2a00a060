"""SentencePiece encoding and decoding as a max-plus scan over boundary states.

The model's tokens of a text are a best path in a lattice: nodes are pairs (position, token that ends
there), and an arc appends a token. For a model of type BPE an arc weighs zero if the two neighbouring
tokens leave each other whole when their join is merged alone, else minus infinity; a text has exactly one
path of finite weight, and it is the segmentation that the merge rules give. Adding the tokens' scores to
the arcs leaves that path the best one, and gives matrices whose entries are scores of partial texts.

A document of more than ``CHUNK`` characters is cut into chunks. The boundary states of a cut are the
(overhang, token) pairs which a token across or before it can have. Each chunk gives the matrix of best
scores from its entry to its exit states, on its own; the matrices combine associatively under (max, +);
once the states on the best path are known, each chunk is traced back on its own. No token crosses a
change from another character to the space mark, so all paths meet there, and the rows of a matrix differ
only up to the first such place. Between such places lie units, which are solved together as arrays.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .word_table import SLICE, WordTable, ragged

CHUNK = 32_768
#: Units that are solved together, and units that a worker remembers.
UNITS, TABLE = 20_000, 700_000
SPACE = "▁"
NONE, START = -2, -1
LOWEST = 1 << 40


class Table:
    """An open-addressing hash table from 64-bit keys to numbers, probed for whole arrays."""

    def __init__(self, keys, values):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        mask = (1 << self.bits) - 1
        for k, v in zip(keys, values, strict=True):
            at = self._slot(np.array([k], np.int64))[0]
            while self.keys[at] != -1:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = k, v

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Model:
    """Lattice tables of a SentencePiece BPE model; picklable, for broadcast."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        piece = {i: sp.id_to_piece(i) for i in plain}
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_id[self.raw[i][0]] = i
            elif i in piece:
                self.raw[i] = piece[i].replace(SPACE, " ").encode()
        # Runs of the space mark merge after everything else (lowest score), so they are joined afterwards.
        runs = {len(p): i for i, p in piece.items() if len(p) > 1 and set(p) == {SPACE}}
        order = {i: r for r, i in enumerate(sorted((i for i in plain if piece[i] not in {SPACE * k for k in runs}),
                                                   key=lambda i: (-sp.get_score(i), i)))}
        ids = {piece[i]: i for i in order}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.full(n, LOWEST, np.int64)
        self.left, self.right = np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
        usable = {}
        for p, i in ids.items():
            self.rank[i] = -1 if len(p) == 1 else order[i]
            halves = self._last_merge(p, ids, order)
            if halves is not None:
                usable[p] = i
                self.left[i], self.right[i] = halves
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pair = Table([a << 32 | b for a, b in pairs], list(pairs.values()))
        self.longest = max(map(len, usable))
        nodes, token = {"": 0}, {}
        for p in sorted(usable):
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
            token[nodes[p]] = usable[p]
        self.step = Table([nodes[p[:-1]] << 21 | ord(p[-1]) for p in nodes if p], [v for p, v in nodes.items() if p])
        self.token = np.full(len(nodes), NONE, np.int64)
        for v, i in token.items():
            self.token[v] = i
        self.size = np.ones(n, np.int64)
        for p, i in ids.items():
            self.size[i] = len(p)
        self.space = ids.get(SPACE, NONE)
        self.run_sizes, self.n = runs, n
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])
        self.raw_data = np.frombuffer(b"".join(self.raw), np.uint8)

    @staticmethod
    def _last_merge(p: str, ids: dict, order: dict):
        """The halves that are merged last when the piece is built from its characters; None if it is never built."""
        parts = list(p)
        if len(parts) == 1:
            return NONE, NONE
        while len(parts) > 1:
            best = min(((order[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return ids.get(parts[0], NONE), ids.get(parts[1], NONE)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return None

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay apart when the characters of both are merged as one text.

        Merges run in order of rank. Going back in time from the finished tokens, the two that meet at the
        seam are undone, the later built first; they would join if their join's merge came before either
        was built into what it became (of equal ranks, the left one comes first).
        """
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n))
        x, y = a[at], b[at]
        x_until, y_until = np.full(len(at), LOWEST, np.int64), np.full(len(at), LOWEST, np.int64)
        while len(at):
            joined = self.pair.get(x << 32 | y)
            merged = np.where(joined >= 0, self.rank[joined], LOWEST)
            meets = (merged < x_until) & (merged <= y_until) & (joined >= 0)
            out[at[meets]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            lx, ly = self.right[x], self.left[y]
            going = ~meets & np.where(undo_x, lx >= 0, ly >= 0)
            x_until = np.where(undo_x, rx, x_until)[going]
            y_until = np.where(undo_x, y_until, ry)[going]
            x, y = np.where(undo_x, lx, x)[going], np.where(undo_x, y, ly)[going]
            at = at[going]
        return out

    # -- units ------------------------------------------------------------------------------------

    def arcs(self, cp: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the lattice: start, length and id. ``end[i]``: where the unit of character ``i`` ends.

        A character that is no piece is a token of its own, with id ``n`` plus its code point.
        """
        start, node, out = np.arange(len(cp)), np.zeros(len(cp), np.int64), []
        for m in range(1, self.longest + 1):
            live = start + m <= end[start]
            start, node = start[live], node[live]
            node = self.step.get(node << 21 | cp[start + m - 1])
            if m == 1:
                lone = (node < 0) | (self.token[node] < 0)
                out.append((start[lone], np.ones(int(lone.sum()), np.int64), cp[start[lone]] + self.n))
            start, node = start[node >= 0], node[node >= 0]
            if not len(start):
                break
            t = self.token[node]
            hit = t >= 0
            out.append((start[hit], np.full(int(hit.sum()), m), t[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and where each unit's begin (one entry more than units)."""
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        begin = np.repeat(ends - sizes, sizes)
        start, size, token = self.arcs(cp, np.repeat(ends, sizes))
        depth = start + size - begin[start]
        at = np.argsort(depth, kind="stable")
        start, size, token = start[at], size[at], token[at]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        last = np.full(len(cp) + 1, NONE, np.int64)  # the token on the path that ends before a position
        back = np.zeros(len(cp) + 1, np.int64)
        for d in range(1, len(cuts) - 1):
            s, m, t = (x[cuts[d]:cuts[d + 1]] for x in (start, size, token))
            first = s == begin[s]
            before = np.where(first, START, last[s])
            ok = first | (before >= 0)
            s, m, t, before = s[ok], m[ok], t[ok], before[ok]
            ok = self.apart(before, t)
            last[s[ok] + m[ok]], back[s[ok] + m[ok]] = t[ok], s[ok]
        marked = np.zeros(len(cp) + 1, bool)
        pos = ends.copy()
        floor = ends - sizes
        while len(pos):
            marked[pos] = True
            pos = back[pos]
            more = pos > floor
            pos, floor = pos[more], floor[more]
        where = np.flatnonzero(marked)
        ids = last[where]
        counts = np.bincount(np.repeat(np.arange(len(units)), sizes)[where - 1], minlength=len(units))
        return self._finish(ids, np.concatenate([[0], np.cumsum(counts)]), units)

    def _finish(self, ids, at, units):
        """Replace characters outside the vocabulary by their bytes, and join runs of space marks."""
        small = (ids >= self.n) & (ids < self.n + 128)
        ids = np.where(small, self.byte_id[np.where(small, ids - self.n, 0)], ids)
        odd = {int(k) for k in np.searchsorted(at, np.flatnonzero(ids >= self.n), "right") - 1}
        odd |= {k for k, u in enumerate(units) if u.startswith(SPACE * 2)} if self.run_sizes else set()
        if not odd:
            return ids, at
        parts = np.split(ids, at[1:-1])
        for k in odd:
            parts[k] = np.array(self.plain(parts[k].tolist()), np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def plain(self, ids: list[int]) -> list[int]:
        out: list[int] = []
        k = 0
        while k < len(ids):
            j = k
            while j < len(ids) and ids[j] == self.space:
                j += 1
            if j - k > 1:
                out += self.run(j - k)
                k = j
                continue
            i = ids[k]
            out += [i] if i < self.n else [int(self.byte_id[b]) for b in chr(i - self.n).encode("utf-8", "replace")]
            k += 1
        return out

    def run(self, n: int) -> list[int]:
        """Tokens of ``n`` space marks; the pieces made of marks alone have one score, so the leftmost pair merges first."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.run_sizes:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.space if s == 1 else self.run_sizes[s] for s in sizes]

    # -- chunks -----------------------------------------------------------------------------------

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """Boundary states of a cut between ``left`` and ``right``: (overhang, token that covers or meets the cut)."""
        if not left or not right:
            return [(0, START)]
        if right[0] == SPACE and left[-1] != SPACE:
            return [(0, START)]
        near = left[-self.longest:] + right[:self.longest]
        cut = len(left[-self.longest:])
        cp = np.array([ord(c) for c in near], np.int64)
        start, size, token = self.arcs(cp, np.full(len(cp), len(cp)))
        return [(int(s + m) - cut, int(t)) for s, m, t in zip(start, size, token, strict=True) if s < cut <= s + m]

    def _walk(self, text: str, entry: tuple[int, int], stop: int) -> tuple[dict, dict]:
        """Best scores at nodes (position, token) of ``text`` reached from a state, and each node's predecessor."""
        cp = np.array([ord(c) for c in text], np.int64)
        start, size, token = self.arcs(cp, np.full(len(cp), len(cp)))
        by_start: dict[int, list] = {}
        for s, m, t in zip(start.tolist(), size.tolist(), token.tolist(), strict=True):
            by_start.setdefault(s, []).append((m, t))
        score, back, at = {(entry[0], entry[1]): 0.0}, {}, {entry[0]: [entry[1]]}
        for pos in range(entry[0], stop):
            before, after = at.pop(pos, []), by_start.get(pos, [])
            if not before or not after:
                continue
            a = np.repeat(np.array(before), len(after))
            b = np.tile(np.array([t for _, t in after]), len(before))
            ok = self.apart(a, b) | (a == START)
            for k in np.flatnonzero(ok).tolist():
                m, t = after[k % len(after)]
                node, value = (pos + m, t), score[(pos, int(a[k]))] + (self.score[t] if t < self.n else 0.0)
                if value > score.get(node, -np.inf):
                    if node not in score:
                        at.setdefault(pos + m, []).append(t)
                    score[node], back[node] = value, (pos, int(a[k]))
        return score, back

    @staticmethod
    def _first_reset(text: str) -> int:
        """Where the first unit that begins inside the text begins, or -1."""
        found = re.search(f"[^{SPACE}](?={SPACE})", text)
        return found.end() if found else -1

    @staticmethod
    def _last_reset(text: str) -> int:
        return max((m.end() for m in re.finditer(f"[^{SPACE}](?={SPACE})", text[-4096:])), default=-1 - len(text)) + max(0, len(text) - 4096)

    def transfer(self, left: str, text: str, right: str) -> dict:
        """Matrix {(entry, exit): best score} of a chunk between its left and right context."""
        n, exits = len(text), set(self.states(left + text, right))
        whole = text + right[:self.longest]
        inner = self._first_reset(text)
        out = {}
        if inner < 0:
            for entry in self.states(left, text + right):
                score, _ = self._walk(whole, entry, n)
                self._leave(out, entry, score, n, exits, 0.0)
            return out
        rest = max(self._last_reset(text), inner)
        middle = self._sum(text[inner:rest]) if rest > inner else 0.0
        tail, _ = self._walk(whole[rest:], (0, START), n - rest)
        for entry in self.states(left, text + right):
            head, _ = self._walk(text[:inner], entry, inner)
            reached = max((v for (p, _), v in head.items() if p == inner), default=-np.inf)
            if reached > -np.inf:
                self._leave(out, entry, tail, n - rest, exits, reached + middle)
        return out

    def _whole(self, marked: str) -> np.ndarray:
        """Ids of whole units of a normalised text, by way of the table."""
        data = np.frombuffer(marked[1:].replace(SPACE, " ").encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0] if len(data) else np.array(self.plain([self.space]), np.int64)

    def _sum(self, text: str) -> float:
        return float(self.score[self._whole(text)].sum())

    @staticmethod
    def _leave(out: dict, entry, score: dict, n: int, exits: set, extra: float) -> None:
        for (pos, token), value in score.items():
            if pos < n:
                continue
            to = (0, START) if exits == {(0, START)} and pos == n else (pos - n, token)
            if to in exits:
                out[entry, to] = max(out.get((entry, to), -np.inf), value + extra)

    def trace(self, left: str, text: str, right: str, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the tokens between two boundary states of a chunk."""
        n, whole = len(text), text + right[:self.longest]
        inner = self._first_reset(text)
        if inner < 0:
            return self.plain(self._path(whole, entry, n, leave))
        rest = max(self._last_reset(text), inner)
        head = self._path(text[:inner], entry, inner, (0, START))
        tail = self._path(whole[rest:], (0, START), n - rest, leave)
        middle = self._whole(text[inner:rest]).tolist() if rest > inner else []
        return self.plain(head) + middle + self.plain(tail)

    def _path(self, text: str, entry, n: int, leave) -> list[int]:
        score, back = self._walk(text, entry, n)
        goals = [k for k in score if k[0] == n] if leave == (0, START) else [(n + leave[0], leave[1])]
        node, out = max(goals, key=lambda k: score[k]), []
        while node != (entry[0], entry[1]):
            out.append(node[1])
            node = back[node]
        return out[::-1]

    # -- texts ------------------------------------------------------------------------------------

    def _units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that words make with a space mark before them, solved together in parts."""
        texts = [SPACE + w.decode("utf-8") for w in words]
        parts, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for a in range(0, len(texts), UNITS):
            ids, at = self.solve(texts[a:a + UNITS])
            parts.append(ids)
            counts.append(np.diff(at))
        return np.concatenate(parts), np.cumsum(np.concatenate(counts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of the UTF-8 texts ``data[offsets[k]:offsets[k + 1]]``; a unit that was met before is looked up.

        Texts with a space at either end, two spaces together or a space mark are cut into units one by one.
        """
        if not hasattr(self, "table"):
            self.table = WordTable(self._units, TABLE)
        out: list[np.ndarray] = []
        a = 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            out += self._slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            a = b
        return out

    def _slice(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        sizes = np.diff(at)
        space = data == 32
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        beside = space & (edge[:-1] | edge[1:])  # a space at an end of a text, or after another
        beside[1:] |= space[1:] & space[:-1]
        mark = np.zeros(len(data), bool)
        mark[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        odd = np.zeros(len(sizes), bool)
        odd[np.searchsorted(at, np.flatnonzero(beside | mark), "right") - 1] = True
        begins = ~space & edge[:-1]
        begins[1:] |= ~space[1:] & space[:-1]
        stops = ~space & edge[1:]
        stops[:-1] |= ~space[:-1] & space[1:]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if odd.any():
            use = ~odd[np.searchsorted(at, starts, "right") - 1]
            starts, ends = starts[use], ends[use]
        ids, n = self.table.gather(self.table.numbers(data, starts, ends))
        cut = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, at)]
        out = [ids[p:q] for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            units = units_of(normal(data[at[k]:at[k + 1]].tobytes().decode("utf-8")))
            index = {w: i for i, w in enumerate(dict.fromkeys(units))}
            flat, pos = self.solve(list(index))
            out[k] = np.concatenate([flat[pos[i]:pos[i + 1]] for i in map(index.__getitem__, units)]).astype(np.uint32)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of ids: space marks become spaces, and the first of them is dropped."""
        ids = ids.astype(np.int64)
        data = self.raw_data[ragged(self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids])].tobytes()
        return data.removeprefix(b" ")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def normal(text: str) -> str:
    """The model's input: spaces become marks, with one before the text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def units_of(marked: str) -> list[str]:
    """Units of a normalised text, each with the run of space marks that it begins with."""
    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)


def combine(a: dict, b: dict) -> dict:
    """(max, +) product of two transfer matrices; associative."""
    rows: dict = {}
    for (k, j), v in b.items():
        rows.setdefault(k, []).append((j, v))
    out: dict = {}
    for (i, k), v in a.items():
        for j, w in rows.get(k, ()):
            if v + w > out.get((i, j), -np.inf):
                out[i, j] = v + w
    return out


def cut(text: str, size: int) -> list[int]:
    """Where chunks of a normalised text begin; a run of space marks is not cut."""
    at, out = 0, [0]
    while at + size < len(text):
        at += size
        while at < len(text) and text[at] == SPACE:
            at += 1
        if at < len(text):
            out.append(at)
    return out


def chosen_states(matrices: list[dict]) -> list[tuple]:
    """The state at each cut on the best path, ends included, from prefix and suffix products."""
    prefix = [{((0, START), (0, START)): 0.0}]
    for m in matrices:
        prefix.append(combine(prefix[-1], m))
    states = [max(prefix[-1], key=prefix[-1].get)[1]]
    for k in range(len(matrices) - 1, -1, -1):
        before = {i: prefix[k][(0, START), i] for (s, i) in prefix[k] if s == (0, START)}
        states.append(max((i for (i, j) in matrices[k] if j == states[-1] and i in before),
                          key=lambda i: before[i] + matrices[k][i, states[-1]]))  # noqa: B023
    return states[::-1]


def encode_in_chunks(model: Model, text: str, size: int = CHUNK) -> list[int]:
    """Ids of one text by the chunked scan, on one machine; the distributed form runs the same three steps."""
    marked = normal(text)
    if not marked:
        return []
    at = cut(marked, size)
    parts = [(marked[max(0, a - model.longest):a], marked[a:b], marked[b:b + model.longest])
             for a, b in zip(at, [*at[1:], len(marked)], strict=True)]
    states = chosen_states([model.transfer(*p) for p in parts])
    return [i for p, s, e in zip(parts, states[:-1], states[1:], strict=True) for i in model.trace(*p, s, e)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _report(model: Model, doc_ids, texts: list[bytes], ids: list[np.ndarray], chunks: list[int]) -> pa.RecordBatch:
    mark = SPACE.encode()
    same = [model.decode_bytes(i) == t.replace(mark, b" ") for i, t in zip(ids, texts, strict=True)]
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.record_batch(
        [doc_ids, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32))), pa.array([len(i) for i in ids], pa.int64()),
         pa.array([_crc(i) for i in ids], pa.int64()), pa.array(chunks, pa.int32()), pa.array(same, pa.bool_())],
        ["doc_id", "ids", "n_tokens", "ids_crc32", "n_chunks", "round_trip"])


OUT = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, n_chunks int, round_trip boolean"


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id, ids, n_tokens, ids_crc32, n_chunks, round_trip``.

    ``ids`` are the ids of the SentencePiece BPE model at ``path``; null counts as empty, and an empty text
    has no ids. ``round_trip`` tells whether decoding gives the text back (a space mark in the input decodes
    to a space, which counts as the same). Texts over ``chunk`` characters go through the chunked scan,
    their chunks dealt over all tasks. Repeated rows are encoded each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(path))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                c = b.slice(a, 2000)
                text = c.column("text").cast(pa.binary())
                offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
                ids = shared.value.encode(np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets)
                yield _report(shared.value, c.column("doc_id"), text.to_pylist(), ids, np.minimum(np.diff(offsets), 1).tolist())

    small = rows.where(F.length("text") <= chunk).mapInArrow(short, OUT)
    giants = rows.where(F.length("text") > chunk)

    def split(frames):
        for f in frames:
            for doc, rid, text in zip(f["doc_id"], f["rid"], f["text"], strict=True):
                marked, edge = normal(text), shared.value.longest
                at = cut(marked, chunk)
                yield pd.DataFrame([(doc, rid, k, len(at), marked[max(0, a - edge):a], marked[a:b], marked[b:b + edge])
                                    for k, (a, b) in enumerate(zip(at, [*at[1:], len(marked)], strict=True))],
                                   columns=["doc_id", "rid", "k", "n", "before", "chunk", "after"])

    chunks = stage(giants.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(
        split, "doc_id long, rid long, k int, n int, before string, chunk string, after string"), "pieces-chunks")
    dealt = chunks.repartition("rid", "k")

    def matrices(frames):
        for f in frames:
            got = [shared.value.transfer(*x) for x in zip(f["before"], f["chunk"], f["after"], strict=True)]
            yield pd.DataFrame({"rid": f["rid"], "k": f["k"],
                                "m": [[(*i, *j, float(v)) for (i, j), v in m.items()] for m in got]})

    entry = "array<struct<a int, b int, c int, d int, v double>>"
    each = dealt.mapInPandas(matrices, f"rid long, k int, m {entry}")

    def resolve(f):
        f = f.sort_values("k")
        found = chosen_states([{((r["a"], r["b"]), (r["c"], r["d"])): r["v"] for r in m} for m in f["m"]])
        return pd.DataFrame([(r, k, *s, *e) for r, k, s, e in zip(f["rid"], f["k"], found[:-1], found[1:], strict=True)],
                            columns=["rid", "k", "a", "b", "c", "d"])

    states = stage(each.groupBy("rid").applyInPandas(resolve, "rid long, k int, a int, b int, c int, d int"), "pieces-states")

    def trace(frames):
        for f in frames:
            got = [np.array(shared.value.trace(p, x, q, (a, b), (c, d)), "<u4").tobytes() for p, x, q, a, b, c, d in
                   zip(*(f[c] for c in ("before", "chunk", "after", "a", "b", "c", "d")), strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "rid": f["rid"], "k": f["k"], "chunk": f["chunk"], "ids": got})

    traced = chunks.join(states, ["rid", "k"]).mapInPandas(trace, "doc_id long, rid long, k int, chunk string, ids binary")
    whole = traced.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "chunk", "ids"))).alias("parts"))

    def join(batches):
        for b in batches:
            for doc, parts in zip(b.column("doc_id"), b.column("parts").to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                text = "".join(p["chunk"] for p in parts)[1:].encode()
                yield _report(shared.value, pa.array([doc.as_py()], pa.int64()), [text], [ids], [len(parts)])

    return small.unionByName(whole.select("doc_id", "parts").mapInArrow(join, OUT))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``, the text of its array of ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(path))

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else shared.value.decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", text(ids))
