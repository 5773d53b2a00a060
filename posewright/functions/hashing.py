"""32-bit hashes of word streams and byte streams as Column expressions and Arrow kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF
# Constants of FNV-1a (32 bit) and Murmur3 (x86, 32 bit).
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 16777619
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


#: Bytes, about, of texts that are hashed together.
SLICE = 16 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever number of times the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _and(x: Column, mask: int = MASK) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def u32(x: Column) -> Column:
    """An integer modulo 2**32; negative numbers wrap."""
    return _and(x.cast("long"))


def mul32(x: Column, by: int) -> Column:
    """Product modulo 2**32 of an unsigned 32-bit value and a constant, without overflowing 64 bits."""
    low = _and(x, 0xFFFF) * F.lit(by).cast("long")
    high = F.shiftleft(_and(F.shiftright(x, 16) * F.lit(by).cast("long"), 0xFFFF), 16)
    return _and(low + high)


def rotl32(x: Column, by: int) -> Column:
    return _and(F.shiftleft(x, by)).bitwiseOR(F.shiftright(x, 32 - by))


def fnv1a_words(words: Column) -> Column:
    """FNV-1a over the little-endian bytes of an array of unsigned 32-bit words."""
    def step(h, w):
        for shift in (0, 8, 16, 24):
            h = _and(h.bitwiseXOR(_and(F.shiftright(w, shift), 0xFF)) * F.lit(FNV_PRIME).cast("long"))
        return h

    return F.aggregate(words, F.lit(FNV_BASIS).cast("long"), step)


def murmur3_words(words: Column, seed: int = 0) -> Column:
    """Murmur3 (x86, 32 bit) over the little-endian bytes of an array of unsigned 32-bit words."""
    k = F.transform(words, lambda w: mul32(w, C1))
    k = F.transform(k, lambda w: rotl32(w, 15))
    k = F.transform(k, lambda w: mul32(w, C2))

    def step(h, w):
        turned = rotl32(h.bitwiseXOR(w), 13)
        return _and(turned * F.lit(5).cast("long") + F.lit(ADD).cast("long"))

    h = F.aggregate(k, F.lit(seed).cast("long"), step).bitwiseXOR(F.size(words).cast("long") * 4)
    h = let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))
    h = let(h, lambda x: mul32(x, MIX1))
    h = let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 13)))
    h = let(h, lambda x: mul32(x, MIX2))
    return let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def combined_key(fnv: Column, murmur: Column) -> Column:
    """Both hashes as 16 upper-case hex digits."""
    return F.concat(F.lpad(F.hex(fnv), 8, "0"), F.lpad(F.hex(murmur), 8, "0"))


def fnv1a_batch(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each byte string, all strings advanced together byte by byte, longest first."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    sizes = sizes[order]
    start = np.cumsum(sizes) - sizes
    h = np.full(len(values), FNV_BASIS, np.uint64)
    live, i = int((sizes > 0).sum()), 0
    while live > 32:
        h[:live] = ((h[:live] ^ data[start[:live] + i]) * np.uint64(FNV_PRIME)) & np.uint64(MASK)
        i += 1
        live = int(np.searchsorted(-sizes, -i, "left"))
    for k in range(live):
        x = int(h[k])
        for b in data[start[k] + i:start[k] + sizes[k]].tobytes():
            x = ((x ^ b) * FNV_PRIME) & MASK
        h[k] = x
    out = np.empty(len(values), np.int64)
    out[order] = h.astype(np.int64)
    return out


@F.pandas_udf(T.LongType())
def fnv1a_text(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes of a text; null counts as empty."""
    values = [("" if t is None else t).encode() for t in text]
    part = np.cumsum([len(v) for v in values]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(values)]
    return pd.Series(np.concatenate([fnv1a_batch(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]))
