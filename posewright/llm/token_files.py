"""Token ids of a corpus as files of entropy-coded blocks.

A static range asymmetric numeral system (rANS) codes the ids with one shared table of frequencies, which
are counted over all documents. The corpus is one sequence in ascending document order, cut into blocks of
whole documents. A block stands alone: a header with its place in the sequence, its documents' ids and
lengths, the states of its interleaved lanes at the start and at checkpoints, the shared stream of 32-bit
words, and a checksum. So blocks, and the stretches between checkpoints of one block, decode in parallel.
The folder of a run of blocks is named by the place of its first id, so that the files stand in order.

Block layout, little-endian: ``HEAD``; for each document its id (int64), whether it is null (uint8) and its
length (int64); for each checkpoint the word it starts at (int64) and its lane states (uint64); the words
(uint32). The checksum in the head is CRC-32 of all that follows it. A row of the Parquet file is one
block, so that Spark's committer makes the written file complete or absent.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from ..staging import discard, new_path, release, stage
from .word_table import SLICE, WordTable

END_ID, BITS, LOW = 1, 20, np.uint64(1 << 32)
#: Tokens of a block (one long document may have more), lanes, and steps between checkpoints.
BLOCK, LANES, CHECKPOINT = 1 << 20, 4096, 128
#: Rows (about) from which the cuts inside of frequent document ids are taken, and ids of a row up to which a cut compares them.
CUT_ROWS, CUT_IDS = 2000, 1 << 14
HEAD = struct.Struct("<4sIIIIqqqqqI")
MAGIC = b"PWT1"


class Encoder:
    """Ids of whole texts by the tokenizers library, one call for each distinct word.

    White space ends a word for this kind of tokenizer whatever stands beside it, and so does a comma or
    point after a letter or digit and before white space: a text's ids are those of its parts between such
    places. Parts are taken at ASCII white space, in lower case as far as A-Z go, since the tokenizer lowers
    all letters; a slice with the beginning of a special token keeps its case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.table = WordTable(self.learn)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: lower-case letters a-z by the model alone, other letters together, the rest one by one.

        A word of letters is one piece of the pre-tokenizer. Characters of A-Z, a-z stand for themselves in
        the model.
        """
        texts = [w.decode("utf-8") for w in words]
        out: list = [None] * len(words)
        wide, odd = [], []
        for k, (w, t) in enumerate(zip(words, texts, strict=True)):
            if w.isascii() and w.isalpha() and w.islower():
                out[k] = [x.id for x in self.tokenizer.model.tokenize(t)]
            else:
                (wide if t.isalpha() else odd).append(k)
        if wide:
            got = self.tokenizer.encode(" ".join([texts[k] for k in wide]), add_special_tokens=False)
            which, ids = np.array(got.word_ids), np.array(got.ids)
            if len(np.unique(which)) == len(wide) and which[-1] == len(wide) - 1:
                cut = np.searchsorted(which, np.arange(len(wide) + 1)).tolist()
                ids = ids.tolist()
                for n, k in enumerate(wide):
                    out[k] = ids[cut[n]:cut[n + 1]]
            else:
                odd += wide
        for k, e in zip(odd, self.tokenizer.encode_batch([texts[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = e.ids
        at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return np.fromiter(chain.from_iterable(out), np.uint32, int(at[-1])), at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[k]:offsets[k + 1]]`` in one array, and where each text's begin."""
        parts, counts, a = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            ids, n = self._slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            parts.append(ids)
            counts.append(n)
            a = b
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _slice(self, data, offsets):
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if b"<|" not in data.tobytes():
            data = LOWER[data]
        kind = KIND[data]
        space = kind == 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = ~space, ~space
        begins[1:] &= space[:-1] | edge[1:-1]
        stops[:-1] &= space[1:] | edge[1:-1]
        # A comma or point that ends a part stands alone if an ASCII or Latin-1 letter, or a digit, is before it.
        mark = np.flatnonzero(stops & ~begins & (kind == 2))
        before = data[mark - 1]
        latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (data[np.maximum(mark - 2, 0)] == 0xC3) & ~begins[mark - 1]
        mark = mark[(kind[mark - 1] == 3) | latin]
        begins[mark] = True
        stops[mark - 1] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        ids, n = self.table.gather(self.table.numbers(data, starts, ends))
        sums = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])


@cache
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    return Encoder(path)


#: By byte: 1 white space, 2 comma or point, 3 letter or digit, 0 other; and A-Z to a-z.
KIND = np.zeros(256, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 1
KIND[[44, 46]] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Tables:
    """Frequencies that add up to ``2 ** BITS``; every counted id has at least one."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        while len(self.ids) < 2:  # a symbol must not take the whole range
            self.ids, counts = np.append(self.ids, self.ids.max(initial=-1) + 1), np.append(counts, 1.0)
        whole = 1 << BITS
        if len(self.ids) > whole // 4:
            raise ValueError("too many symbols for the range")
        freq = 1 + np.floor(counts / counts.sum() * (whole - len(self.ids))).astype(np.int64)
        freq[np.argmax(counts)] += whole - freq.sum()
        self._index(freq)

    @classmethod
    def stored(cls, ids: np.ndarray, freq: np.ndarray) -> Tables:
        """Tables as they were written."""
        out = cls.__new__(cls)
        out.ids = ids.astype(np.int64)
        out._index(freq.astype(np.int64))
        return out

    def _index(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol_at = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
        self.symbol = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.symbol[self.ids] = np.arange(len(self.ids))
        self.checksum = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())


def encode_block(tables: Tables, start: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: documents with their lengths, and their ids one after the other."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    symbols = tables.symbol[ids]
    if n and symbols.min() < 0:
        raise ValueError("an id has no frequency")
    grid = np.concatenate([symbols, np.zeros(steps * lanes - n, np.int64)]).reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    saved = {}
    shift, half = np.uint64(64 - BITS), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        f, c = tables.freq[grid[t]], tables.start[grid[t]]
        full = (x >> shift) >= f
        if full.any():
            words[t] = x[full].astype(np.uint32)
            x[full] >>= half
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + c
        if t % CHECKPOINT == 0:
            saved[t] = x.copy()
    if not steps:
        saved[0] = x
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("<i8")
    marks = b"".join(before[t:t + 1].tobytes() + saved[t].astype("<u8").tobytes() for t in sorted(saved))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    body = known + nulls + sizes.astype("<i8").tobytes() + marks + b"".join(w.astype("<u4").tobytes() for w in words)
    return HEAD.pack(MAGIC, BITS, lanes, CHECKPOINT, tables.checksum, start, len(doc_ids), n, steps, int(before[-1]), zlib.crc32(body)) + body


class Block:
    """A block that was read: its documents, and the stretches that decode independently."""

    def __init__(self, tables: Tables, data: bytes):
        magic, bits, self.lanes, self.every, checksum, self.start, docs, self.n, self.steps, n_words, crc = HEAD.unpack_from(data)
        if magic != MAGIC or bits != BITS or checksum != tables.checksum:
            raise ValueError("not a block of this file")
        if zlib.crc32(memoryview(data)[HEAD.size:]) != crc:
            raise ValueError("a block is damaged")
        self.tables, at = tables, HEAD.size
        known = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(known, nulls, strict=True)]
        self.sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        self.points = []
        for _ in range(max(1, -(-self.steps // self.every))):
            self.points.append((int(np.frombuffer(data, "<i8", 1, at)[0]), np.frombuffer(data, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", n_words, at)

    def stretch(self, k: int) -> np.ndarray:
        """Ids from checkpoint ``k`` to the next, without the padding at the end of the block."""
        t = self.tables
        pos, x = self.points[k]
        x = x.astype(np.uint64)
        first, last = k * self.every, min(self.steps, (k + 1) * self.every)
        out = np.empty((last - first, self.lanes), np.int64)
        mask, bits, half = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for step in range(last - first):
            slot = x & mask
            s = t.symbol_at[slot]
            out[step] = s
            x = t.freq[s] * (x >> bits) + slot - t.start[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << half) | self.words[pos:pos + len(low)]
                pos += len(low)
        expected = self.points[k + 1] if k + 1 < len(self.points) else (len(self.words), np.full(self.lanes, LOW, np.uint64))
        if pos != expected[0] or (x != expected[1]).any():
            raise ValueError("a block does not decode to its checkpoint")
        return t.ids[out.ravel()[:max(0, self.n - first * self.lanes)]].astype(np.uint32)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.stretch(k) for k in range(len(self.points))])


def _pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The low, middle and high bytes of ids apart, which compresses better than the ids."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    high = planes[:, 2:]
    return planes[:, 0].tobytes(), planes[:, 1].tobytes(), high.tobytes() if high.any() else b""


def _slices(batches, rows: int = 256):
    """The rows of batches, few at a time: an id takes ten times its packed size while it is worked on."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _unpack(low: pa.Array, mid: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and the rows' lengths."""
    lows = low.to_pylist()
    sizes = np.fromiter(map(len, lows), np.int64, len(lows))
    out = np.frombuffer(b"".join(lows), np.uint8).astype(np.uint32)
    out |= np.frombuffer(b"".join(mid.to_pylist()), np.uint8).astype(np.uint32) << np.uint32(8)
    at = np.cumsum(sizes) - sizes
    for k, h in enumerate(high.to_pylist()):
        if h:
            out[at[k]:at[k] + sizes[k]] |= np.frombuffer(h, "<u2").astype(np.uint32) << np.uint32(16)
    return out, sizes


class Parts:
    """Parts of the sequence: ids up to each bound, nulls before them, and cuts between the rows of one frequent id.

    The cuts are rows (``n, low, mid, high``, in the order of the files). Rows that equal a cut are the same
    in all that is written, so they are dealt over the parts on both of its sides.
    """

    def __init__(self, bounds: np.ndarray, cuts: dict[int | None, list[tuple]]):
        self.bounds, self.cuts = bounds, cuts
        ends = [None, *bounds.tolist()]
        sizes = [1 + len(cuts.get(e, ())) for e in ends] + [1]
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.n = int(sum(sizes))

    def of(self, doc_id: pa.Array, rows: list[tuple]) -> np.ndarray:
        """The part of each row, given its id and ``n, low, mid, high``."""
        null = doc_id.is_null().to_numpy(zero_copy_only=False)
        ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.where(null, 0, np.searchsorted(self.bounds, ids, "left") + 1)
        part = self.first[place]
        for value, cuts in self.cuts.items():
            for k in np.flatnonzero(null if value is None else ~null & (ids == value)).tolist():
                a, b = bisect_left(cuts, rows[k]), bisect_right(cuts, rows[k])
                part[k] += a + k % (b - a + 1)
        return part


def _encoded(tokenizer: str, end_id: int):
    """A function of batches of ``doc_id, text``: ids column, and each row's ``n, low, mid, high``, for few rows at a time."""
    def run(batches):
        encoder = encoder_of(tokenizer)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                c = b.slice(a, 2000)
                text = c.column("text").cast(pa.binary())
                offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
                flat, at = encoder.encode(np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets)
                yield c.column("doc_id"), [(q - p + 1, *_pack(np.append(flat[p:q], np.uint32(end_id)))) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return run


def plan_parts(docs: DataFrame, n_parts: int, encoded) -> Parts:
    """Bounds at quantiles of ``doc_id``, read without texts; an id (or null) of more than a part's rows is cut by its rows.

    The cuts come from about ``CUT_ROWS`` rows of such ids. They only balance the parts.
    """
    known = docs.select("doc_id")
    shares = [k / n_parts for k in range(1, n_parts)] or [0.5]
    n, n_known, quantiles = known.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 10 * n_parts))).first()
    bounds, times = np.unique(np.array(quantiles or [], np.int64), return_counts=True)
    wanted = {b: t + 1 for b, t in zip(bounds.tolist(), times.tolist(), strict=True) if t > 1}
    if (nulls := round((n - n_known) / max(n, 1) * n_parts)) > 1:
        wanted[None] = nulls
    if not wanted:
        return Parts(bounds, {})
    named = F.col("doc_id").isin([b for b in wanted if b is not None])
    frequent = docs.where(named | F.col("doc_id").isNull() if None in wanted else named)
    share = min(1.0, CUT_ROWS / max(1.0, n * sum(wanted.values()) / n_parts))

    def some(batches):
        for ids, rows in encoded(batches):
            cut = [r if r[0] <= CUT_IDS else (r[0], b"", b"", b"") for r in rows]
            yield pa.record_batch([ids, pa.array([r[0] for r in cut], pa.int64()), *(pa.array([r[k] for r in cut], pa.binary()) for k in (1, 2, 3))],
                                  ["doc_id", "n", "low", "mid", "high"])

    found: dict[int | None, list[tuple]] = {}
    for r in frequent.where(F.rand(11) < share).mapInArrow(some, "doc_id long, n long, low binary, mid binary, high binary").toLocalIterator():
        found.setdefault(r[0], []).append((r[1], *map(bytes, r[2:])))
    cuts = {value: [sorted(got)[k * len(got) // m] for k in range(1, m)] for value, m in wanted.items() if (got := found.get(value))}
    return Parts(bounds, cuts)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``part, doc_id, n, low, mid, high, offset``: every document's ids with the end id, in ascending order.

    Parts follow each other in the order of ``doc_id`` (nulls first), then of the ids, and are sorted inside;
    ``offset`` is the number of ids of a part before a document.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = _encoded(tokenizer, end_id)
    parts = plan_parts(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), encoded)

    def run(batches):
        for ids, packed in encoded(batches):
            planes = [pa.array([r[k] for r in packed], pa.binary()) for k in (1, 2, 3)]
            yield pa.record_batch([pa.array(parts.of(ids, packed).astype(np.int32)), ids, pa.array([r[0] for r in packed], pa.int64()), *planes],
                                  ["part", "doc_id", "n", "low", "mid", "high"])

    dealt = rows.mapInArrow(run, "part int, doc_id long, n long, low binary, mid binary, high binary").repartitionById(parts.n, "part")
    order = W.partitionBy("part").orderBy("doc_id", "n", "low", "mid", "high")
    return dealt.withColumn("offset", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def count_ids(tokens: DataFrame) -> Tables:
    """The shared table, from the counts of all ids; no more rows reach the driver than the vocabulary has."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in _slices(batches):
            n = np.bincount(_unpack(*b.columns)[0])
            if len(n) > len(total):
                n, total = total, n
            total[:len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    got = tokens.select("low", "mid", "high").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Tables(got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> Tables:
    """Encode all documents and write the blocks to ``path`` (``blocks`` and ``tables`` below it)."""
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, tokenizer, end_id), "tokens")
    release(spark)
    tables = count_ids(tokens)
    sums = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(sums):
        starts[part], at = at, at + sums[part]
    shared = spark.sparkContext.broadcast((tables, starts))

    def run(batches):
        table, first = shared.value
        held: list = []
        at, end = "", -1

        def flush():
            data = encode_block(table, held[0][0], [d for h in held for d in h[1]], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            nonlocal at, end
            if end != held[0][0]:
                at = f"{held[0][0]:018d}"
            end = held[0][0] + sum(len(h[3]) for h in held)
            row = pa.record_batch([pa.array([at]), pa.array([held[0][0]], pa.int64()), pa.array([data], pa.binary())], ["at", "start", "block"])
            held.clear()
            return row

        for b in _slices(batches):
            ids, sizes = _unpack(b.column("low"), b.column("mid"), b.column("high"))
            ends = np.cumsum(sizes)
            begin = np.array([first[p] for p in b.column("part").to_pylist()], np.int64) + b.column("offset").to_numpy()
            doc, a = b.column("doc_id").to_pylist(), 0
            while a < len(doc):
                # Documents up to the block size, as long as each begins where the one before it ended.
                room = BLOCK - sum(len(h[3]) for h in held)
                base = ends[a] - sizes[a]
                stop = max(a + 1, int(np.searchsorted(ends, base + max(room, 1), "right")))
                breaks = np.flatnonzero(begin[a + 1:stop] != begin[a:stop - 1] + sizes[a:stop - 1])
                stop = a + 1 + int(breaks[0]) if len(breaks) else stop
                if held and held[-1][0] + len(held[-1][3]) != begin[a]:
                    yield flush()
                    continue
                held.append((int(begin[a]), doc[a:stop], sizes[a:stop], ids[base:ends[stop - 1]]))
                a = stop
                if sum(len(h[3]) for h in held) >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    blocks = tokens.select("part", "doc_id", "low", "mid", "high", "offset").mapInArrow(run, "at string, start long, block binary")
    blocks.sortWithinPartitions("at", "start").write.partitionBy("at").option("compression", "none").parquet(f"{path}/blocks")
    kept = spark.createDataFrame([(bytearray(tables.ids.astype("<i8").tobytes()), bytearray(tables.freq.astype("<u8").tobytes()))], "ids binary, freq binary")
    kept.write.parquet(f"{path}/tables")
    discard(tokens)
    return tables


def read_tables(spark: SparkSession, path: str) -> Tables:
    row = spark.read.parquet(f"{path}/tables").first()
    return Tables.stored(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["freq"], "<u8"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``, blocks decoded in parallel."""
    shared = spark.sparkContext.broadcast(read_tables(spark, path))

    def run(batches):
        for b in batches:
            for data in b.column("block"):
                block = Block(shared.value, data.as_py())
                ids, ends = block.ids().astype("<u4"), np.cumsum(block.sizes)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), block.sizes.tolist(), strict=True)]
                yield pa.record_batch([pa.array(block.doc_ids, pa.int64()), pa.array(block.start + ends - block.sizes),
                                       pa.array(block.sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema("start long, block binary").parquet(f"{path}/blocks").select("block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Null text counts as empty, and an empty text is the end id alone. Rows of one ``doc_id`` stand in the
    order of their ids, null ``doc_id`` first. An empty table gives files without blocks.
    """
    path = path or new_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
