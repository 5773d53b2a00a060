"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of order 0 to ``ORDER``. Under frozen counts a byte that was
seen after a context costs ``-log2(n / (T + D))`` bits, ``T`` being the context's total and ``D`` its
distinct bytes; an unseen byte costs the escape ``-log2(D / (T + D))`` and is coded in the next shorter
context, down to eight bits flat. A text is given to the language with the shortest code.

The trees of all languages share one set of nodes: a context of order two or more is a node if it occurs
``MIN_NODE`` times, so depth varies; any other context is served by its longest suffix that is a node.
Costs are then constants by node and byte, which makes scoring two table lookups for each byte.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import fresh

ORDER, MIN_NODE = 3, 16
#: The classifier is fitted on about this many labelled documents of each language, chosen by a hash of their id.
MAX_DOCS = 4000
START, SLICE = 10, 1 << 20
#: Bits by which a text's code must exceed a code that knows no language before the text counts as in none; a few odd words do not reach it.
MARGIN = 64.0
UNKNOWN = "und"


def grams(values: list[bytes]) -> np.ndarray:
    """For each byte, the byte with its ``ORDER`` predecessors as one number; a text starts after newlines."""
    pad = bytes([START]) * ORDER
    data = np.frombuffer(b"".join(pad + v for v in values), np.uint8)
    code = np.zeros(len(data), np.uint32)
    for back in range(ORDER, -1, -1):
        code <<= np.uint32(8)
        code[back:] |= data[:len(data) - back]
    sizes = np.fromiter((len(v) + ORDER for v in values), np.int64, len(values))
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[np.cumsum(sizes) - sizes + k] = False
    return code[real]


def count_grams(train: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``train``, pre-aggregated for each batch."""

    def run(batches):
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                values = [texts[i].encode() for i in np.flatnonzero(langs == lang) if texts[i]]
                if values:
                    code, n = np.unique(grams(values), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)),
                                           pa.array(n)], ["lang", "gram", "n"])

    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


class Model:
    """Frozen costs: ``node_of`` gives the node of a context, ``cost[node, byte]`` the bits for each language."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        L = len(self.langs)
        if not L:
            return
        l_ix = np.searchsorted(self.langs, lang).astype(np.int64)
        shifts = [8 * k for k in range(ORDER, -1, -1)]
        seen = np.unique(np.concatenate([[START], *((gram >> s) & 255 for s in shifts)])).astype(int)
        self.symbol = np.zeros(256, np.uint8)  # 0: a byte that no language has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = A = len(seen) + 1
        parts = [self.symbol[(gram >> s) & 255].astype(np.int64) for s in shifts]
        sym = parts[-1]
        cost = [np.full((1, A, L), 8.0)]
        base, node_of = 0, np.zeros(1, np.int64)
        for k in range(ORDER + 1):
            # Counts of order k are those of the longest order, summed over the bytes further back.
            ctx = np.zeros(len(gram), np.int64)
            for p in parts[ORDER - k:ORDER]:
                ctx = ctx * A + p
            key, at = np.unique((ctx * A + sym) * L + l_ix, return_inverse=True)
            count = np.bincount(at, n, len(key))
            k_l, k_ctx, k_sym = key % L, key // L // A, key // L % A
            nodes, where = np.unique(k_ctx, return_inverse=True)
            if k > 1:
                big = np.bincount(where, count, len(nodes)) >= MIN_NODE
                kept = big[where]
                nodes, where = nodes[big], (np.cumsum(big) - 1)[where]
                k_l, k_sym, count, where = k_l[kept], k_sym[kept], count[kept], where[kept]
            shorter = node_of[nodes % max(1, A ** (k - 1))] if k else np.zeros(len(nodes), np.int64)
            total, distinct = np.zeros((len(nodes), L)), np.zeros((len(nodes), L))
            np.add.at(total, (where, k_l), count)
            np.add.at(distinct, (where, k_l), 1)
            previous = np.concatenate(cost)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = previous[shorter] + escape[:, None, :]
                own[where, k_sym, k_l] = -np.log2(count / (total + distinct)[where, k_l])
            base = len(previous)
            cost.append(own)
            longer = np.tile(node_of, A) if k else node_of.copy()
            longer[nodes] = base + np.arange(len(nodes))
            node_of = longer
        self.node_of = node_of.astype(np.int32)
        self.cost = np.concatenate(cost).astype(np.float32).reshape(-1, L)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text ``data[offsets[i]:offsets[i + 1]]`` under each language, in bits."""
        A, start = self.width, self.symbol[START]
        first, last = int(offsets[0]), int(offsets[-1])
        s = self.symbol[data[first:last]]
        ends = offsets - first
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        heads = ends[:-1]
        for a in range(0, len(s), SLICE):
            b = min(len(s), a + SLICE)
            context = np.zeros(b - a, np.int32)
            for back in range(ORDER, 0, -1):
                p = np.full(b - a, start, np.int32)
                src = s[max(0, a - back):max(0, b - back)]
                p[b - a - len(src):] = src
                for k in range(back):  # the first bytes of a text have no predecessors
                    near = heads[(heads + k >= a) & (heads + k < b)] + k - a
                    p[near] = start
                context = context * A + p
            each = self.cost[self.node_of[context].astype(np.int64) * A + s[a:b]]
            inside = np.flatnonzero((ends[:-1] < b) & (ends[1:] > a) & (ends[1:] > ends[:-1]))
            out[inside] += np.add.reduceat(each, np.maximum(ends[:-1][inside], a) - a, axis=0, dtype=np.float64)
        return out


    def plain_bits(self, data: np.ndarray) -> float:
        """Length of a text's shortest code without a language: single bytes by a language's counts, or eight bits flat."""
        single = self.cost.reshape(-1, self.width, len(self.langs))[1].astype(np.float64)
        seen = sum((np.bincount(self.symbol[data[a:a + SLICE]], minlength=self.width) for a in range(0, len(data), SLICE)), np.zeros(self.width))
        return float(min((seen @ single).min(), 8.0 * len(data)))

    def foreign(self, data: np.ndarray, offsets: np.ndarray, bits: np.ndarray, margin: float = MARGIN) -> np.ndarray:
        """Whether no language codes a text as short as a code without languages does, by ``margin`` bits.

        Then its bytes do not follow each other as in any of them: another language, code, or noise. A short
        text has too few bits to tell.
        """
        best = bits.min(axis=1)
        least = self.cost.reshape(-1, self.width, len(self.langs))[1].min()
        out = best > least * np.diff(offsets) + margin  # the code of single bytes can be no shorter
        for k in np.flatnonzero(out).tolist():
            out[k] = best[k] > self.plain_bits(data[offsets[k]:offsets[k + 1]]) + margin
        return out


def train(rows: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on rows with ``doc_id, text`` and a non-null ``lang``; of each language, about ``max_docs`` by hash."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    some = [(lang, min(1.0, max_docs / n)) for lang, n in sorted(counts.items())]
    if not some:
        return Model(np.array([], object), np.array([], np.int64), np.array([], np.int64))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in some for x in pair]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = count_grams(chosen).toPandas().sort_values(["lang", "gram"])
    return Model(got["lang"].to_numpy(object), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def _judge(batch: pa.RecordBatch, model: Model, has_letters: str = "letters", margin: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language and score of each row by its text, and with ``margin`` whether it is ``foreign`` to all of them."""
    n = batch.num_rows
    names, score, foreign = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
    letters = batch.column(has_letters).to_numpy(zero_copy_only=False).astype(bool)
    if n and model.langs:
        text = batch.column("text").fill_null("").cast(pa.binary())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + n + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        bits = model.bits(data, offsets)
        if margin is not None:
            foreign = model.foreign(data, offsets, bits, margin)
        names[letters] = np.array(model.langs, object)[bits.argmin(axis=1)][letters]
        score[letters] = (1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1))[letters]
    return names, score, foreign


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no language was
    learned. The score is the winner's posterior under equal priors; ties go to the smaller name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, score, _ = _judge(b, shared.value)
            yield pa.record_batch([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", has_letter().alias("letters")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def held_out(folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def language_id(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; only ``doc_id, text, lang`` are read.

    The model learns from rows that are not held out, have an id and a language. Repeated rows are
    scored each for itself; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), max_docs)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, languages: Sequence[str] | None = None, min_score: float = 0.0, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` in an identified language, with all their columns, in one pass and no shuffle.

    Rejected are texts without a letter, texts that are foreign to every learned language (see
    ``Model.foreign``), and, where they are given, texts in none of ``languages`` or below ``min_score``. Where no
    language is learned, only texts without a letter are rejected, for there is nothing to judge by. Null
    ids and repeated rows are judged like any other, each by its text.
    """
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    if not model.langs:
        return docs.where(has_letter())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, mark = docs.columns, fresh(docs, "letters")
    wanted = None if languages is None else set(languages)

    def run(batches):
        for b in batches:
            lang, score, foreign = _judge(b, shared.value, mark, margin)
            kept = (lang != UNKNOWN) & (score >= min_score) & ~foreign
            if wanted is not None:
                kept &= np.array([x in wanted for x in lang], bool)
            yield b.select(names).filter(pa.array(kept))

    return docs.withColumn(mark, has_letter()).mapInArrow(run, docs.schema)
