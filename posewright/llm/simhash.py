"""SimHash near-duplicates: fingerprints, then a binary-trie self-join within a Hamming budget.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. The self-join runs
over distinct fingerprints, so copies are one node. The 64 bits are cut into blocks; two fingerprints
within ``k`` bits agree on all but ``k`` blocks, so each choice of the remaining blocks makes a trie
whose top (the chosen bits) is fixed. Fingerprints with equal top bits share a bucket, and each bucket is
a subtrie that is joined with itself by walking node pairs together: the walk adds the bits in which two
nodes differ and drops a pair when the sum passes ``k``. More blocks are taken when the corpus is so
large that buckets would grow; no link is lost for any choice. A bucket that is crowded all the same is
dealt again by blocks of its remaining bits, of which two linked fingerprints have one in common, until
no bucket is too large for one task; buckets are counted before their rows are moved.

A bucket returns a spanning forest of its links, at most one link for each fingerprint, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..staging import stage
from .rows import take_out

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Mean fingerprints in a bucket beyond which one more block is cut, and pairs that one step of the walk expands.
BUCKET, STEP = 20_000, 1 << 20
#: Fingerprints of a bucket beyond which it is dealt again.
CROWDED = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; zero if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hasher = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hasher(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        ends = (starts[1:] - 1)[shingle - 1:].tolist()
        hashes = [hasher(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the values, counted in slices of bounded size."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[a:a + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return int(sum(1 << int(b) for b in bits))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, fp)`` of every row: the text's digest, and the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column("doc_id"), b.column("key"), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, "doc_id long, key long, fp long")


def plan_tables(n: int, max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Bit positions that each table fixes: of ``max_bits + extra`` blocks, any ``extra`` of them."""
    for extra in range(1, 5):
        blocks = [tuple(x) for x in np.array_split(np.arange(64), max_bits + extra)]
        tables = [sum(c, ()) for c in combinations(blocks, extra)]
        if n / 2 ** min(map(len, tables)) <= BUCKET:
            break
    return tables


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Union the links (a, b) into ``label``, where each entry points to the smallest index of its tree."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_links(fps: np.ndarray, bucket: np.ndarray, order: tuple[int, ...], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, root indexes) of the links within ``max_bits`` inside each bucket.

    ``fps`` must be sorted by bucket, then by the bits of ``order``, most significant first. A node is a
    range of the array and a depth in ``order``; its children are found from running sums of the next bit.
    """
    n = len(fps)
    label = np.arange(n)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    keep = hi - lo > 1
    zeros_at = {}

    def zeros(depth):
        if depth not in zeros_at:
            bit = (fps >> np.uint64(order[depth])) & np.uint64(1)
            zeros_at[depth] = np.r_[0, np.cumsum(bit == 0, dtype=np.int32)].astype(np.int32)
        return zeros_at[depth]

    stack = [(0, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(int(keep.sum()), np.int8))]
    linked, turns = False, np.arange(n)
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > STEP:
            # Nodes with themselves go first, then the nearest pairs: what they link need not be walked again.
            at = np.lexsort((diff, al != bl))
            for s in range((len(al) - 1) // STEP * STEP, -1, -STEP):
                stack.append((depth, *(x[at[s:s + STEP]] for x in (al, ah, bl, bh, diff))))
            continue
        if linked:
            turns[0] = 0
            turns[1:] = np.cumsum(label[1:] != label[:-1])
            linked = False
        # Two nodes whose leaves are all in one tree already can add no link to the forest.
        done = (label[al] == label[bl]) & (turns[al] == turns[ah - 1]) & (turns[bl] == turns[bh - 1])
        done &= (ah - al > 1) | (al != bl)
        if done.any():
            al, ah, bl, bh, diff = (x[~done] for x in (al, ah, bl, bh, diff))
        same = al == bl
        single = (ah - al == 1) & (bh - bl == 1)
        # Two leaves are compared at once; a leaf with itself is no link.
        leaf = single & ~same
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
            if near.any():
                label, linked = _forest(n, x[near], y[near], label), True
        rest = ~single
        if depth == len(order) or not rest.any():
            if rest.any():  # equal on all bits: fingerprints are distinct, so this holds only for repeats
                spread = np.repeat(al[rest], (ah - al)[rest])
                inside = np.concatenate([np.arange(p, q) for p, q in zip(al[rest], ah[rest], strict=True)])
                label, linked = _forest(n, spread, inside, label), True
            continue
        al, ah, bl, bh, diff, same = al[rest], ah[rest], bl[rest], bh[rest], diff[rest], same[rest]
        z = zeros(depth)
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        parts = []
        for pl, ph, ql, qh, cost, use in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None),
                                          (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)):
            ok = (pl < ph) & (ql < qh) & (diff + cost <= max_bits)
            ok &= ~((pl == ql) & (ph - pl == 1))
            if use is not None:
                ok &= use
            parts.append((pl[ok], ph[ok], ql[ok], qh[ok], diff[ok] + np.int8(cost)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(al):
            stack.append((depth + 1, al, ah, bl, bh, diff))
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


class Deal:
    """The bit positions that each table fixes; a table of number ``len(tables)`` or more is a crowded one dealt again."""

    def __init__(self, tables: list[tuple[int, ...]], max_bits: int):
        self.tables, self.blocks = [tuple(map(int, t)) for t in tables], max_bits + 1

    def fixed(self, t: int) -> tuple[int, ...]:
        if t < len(self.tables):
            return self.tables[t]
        parent, k = divmod(t - len(self.tables), self.blocks)
        return self.fixed(parent) + tuple(self.rest(parent)[k::self.blocks].tolist())  # every block has high and low bits

    def rest(self, t: int) -> np.ndarray:
        """The positions left, from the highest down."""
        return np.array(sorted(set(range(64)) - set(self.fixed(t)), reverse=True))

    def again(self, t: int) -> list[int]:
        """The tables of one block each that take the place of ``t``."""
        return [len(self.tables) + t * self.blocks + k for k in range(self.blocks)]

    def rows(self, t: int, fp: np.ndarray) -> pa.RecordBatch:
        """``t, key, fp``: the bits that a table fixes are its key."""
        mask = np.uint64(sum(1 << b for b in self.fixed(t)))
        return pa.record_batch([pa.array(np.full(len(fp), t, np.int64)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))], ["t", "key", "fp"])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(i, j)`` between distinct signed fingerprints ``fp``, enough to connect all within ``max_bits``."""
    n = fps.count()
    deal = Deal(plan_tables(n, max_bits), max_bits)

    def first(batches):
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(len(deal.tables)):
                yield deal.rows(t, v)

    def again(batches):
        for b in batches:
            v, t = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("t").to_numpy()
            for old in np.unique(t).tolist():
                for new in deal.again(old):
                    yield deal.rows(new, v[t == old])

    def join(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        t, key = whole["t"].to_numpy(), whole["key"].to_numpy()
        v = whole["fp"].to_numpy().view(np.uint64)
        for table in np.unique(t).tolist():
            mine = t == table
            f, k, order = v[mine], key[mine], tuple(deal.rest(table).tolist())
            rest = np.zeros(len(f), np.uint64)
            for bit in order:
                rest = (rest << np.uint64(1)) | ((f >> np.uint64(bit)) & np.uint64(1))
            at = np.lexsort((rest, k))
            f, k = f[at], k[at]
            child, root = trie_links(f, k, order, max_bits)
            if len(child):
                s = f.view(np.int64)
                yield pa.record_batch([pa.array(s[child]), pa.array(s[root])], ["i", "j"])

    schema = "t long, key long, fp long"
    dealt, most, calm = fps.mapInArrow(first, schema), n * len(deal.tables), None
    while n > CROWDED:
        crowded = stage(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("t", "key"), "simhash-crowded", rows=most // CROWDED)
        if crowded.isEmpty():
            break
        near = F.broadcast(crowded)  # 16 bytes for every CROWDED rows at least
        rest = dealt.join(near, ["t", "key"], "left_anti")
        calm = calm.unionByName(rest) if calm is not None else rest
        dealt = stage(dealt.join(near, ["t", "key"], "left_semi").select("t", "fp").mapInArrow(again, schema), "simhash-again")
        most *= deal.blocks
    dealt = calm.unionByName(dealt) if calm is not None else dealt
    return dealt.repartition("t", "key").mapInArrow(join, "i long, j long")


def labelled(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, key, fp, component_id, component_size`` and the component's own number, of every row."""
    rows = stage(fingerprints(docs, shingle), "simhash-rows")
    n = rows.count()
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-nodes", rows=n)
    joined = stage(links(nodes.select("fp"), max_bits).distinct(), "simhash-links", rows=n)
    parts = connected_components(joined)
    named = stage(nodes.join(parts, nodes["fp"] == parts["node"], "left").select(
        "fp", "low", "n", F.coalesce("component", "fp").alias("component")), "simhash-named", rows=n)
    heads = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"))
    label = stage(named.join(heads, "component").select("fp", "component", "component_id", "component_size"), "simhash-labels", rows=n)
    return rows.join(label, "fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``, plus ``component_size`` in documents.

    Null and blank texts have fingerprint zero and are linked like any other. A text shorter than a
    shingle is hashed whole. Repeated rows are separate members of one component. Null ids are members,
    but no component is named after one unless it has no other. An empty table gives an empty result.
    """
    return labelled(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, the one with the smallest id (then digest), with all its columns."""
    rows = stage(labelled(docs, shingle, max_bits).where("component_size > 1").select("doc_id", "key", "component"), "simhash-members")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select(
        F.col("component").alias("c"), F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    verdicts = rows.join(first, rows["component"] == first["c"]).select(
        "doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))).alias("kept"))
    return take_out(docs, F.xxhash64("text"), verdicts)
