"""Hashes, rotations, parsing and vectors against independent versions."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from posewright.constants import BONES, MIRROR_PAIRS, PARENTS
from posewright.functions import geometry, hashing, text, vectors
from posewright.sources.files import parse_quoted
from pyspark.sql import functions as F


def fnv(data):
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def murmur(data, seed=0):
    rot = lambda x, r: (x << r | x >> 32 - r) % 2**32
    h = seed
    for (k,) in struct.iter_unpack("<I", data):
        h = (rot(h ^ rot(k * 0xCC9E2D51 % 2**32, 15) * 0x1B873593 % 2**32, 13) * 5 + 0xE6546B64) % 2**32
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by % 2**32
    return h ^ h >> 16


def test_word_hashes(spark):
    rng = random.Random(1)
    streams = [[], [0], [2**32 - 1] * 5] + [[rng.randrange(2**32) for _ in range(rng.randint(1, 300))] for _ in range(40)]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(streams)], "k int, w array<bigint>")
    got = rows.select("k", hashing.fnv1a_words(F.col("w")).alias("f"), hashing.murmur3_words(F.col("w")).alias("m")).withColumn(
        "key", hashing.combined_key(F.col("f"), F.col("m"))).orderBy("k").collect()
    for r, s in zip(got, streams, strict=True):
        data = struct.pack(f"<{len(s)}I", *s)
        assert (r.f, r.m, r.key) == (fnv(data), murmur(data), f"{fnv(data):08X}{murmur(data):08X}")


def test_byte_hashes(spark):
    values = ["", "a", "é漢", "x" * 5000, *("t" * (k % 7) for k in range(80))]
    assert hashing.fnv1a_batch([v.encode() for v in values]).tolist() == [fnv(v.encode()) for v in values]
    got = spark.createDataFrame([(None,), ("é",)], "t string").select(hashing.fnv1a_text("t").alias("h")).collect()
    assert [r.h for r in got] == [fnv(b""), fnv("é".encode())]


def test_byte_hashes_in_slices(monkeypatch):
    monkeypatch.setattr(hashing, "SLICE", 64)
    values = pd.Series([None, "", *("é" * (k % 50) for k in range(90)), "x" * 300, None])
    assert hashing.fnv1a_text.func(values).tolist() == [fnv((v or "").encode()) for v in values]
    assert hashing.fnv1a_text.func(pd.Series([], dtype=object)).tolist() == []


def test_quantize_and_wrap(spark):
    rows = spark.createDataFrame([(x,) for x in (-0.015, -0.005, 0.0, 0.005, 1.0, 0.015)], "x double")
    got = rows.select(vectors.quantize(F.col("x"), 0.01).alias("q"), hashing.u32(vectors.quantize(F.col("x"), 0.01)).alias("w")).collect()
    assert [r.q for r in got] == [math.floor(x / 0.01 + 0.5) for x in (-0.015, -0.005, 0.0, 0.005, 1.0, 0.015)]
    assert all(r.w == r.q % 2**32 for r in got)


def rotation(axis, angle):
    axis = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def test_rotations(spark):
    cases = [((1, 0, 0), 0.0), ((1, 0, 0), math.pi), ((0, 1, 0), math.pi), ((0, 0, 1), math.pi), ((1, 2, 3), 1.1), ((-1, 2, 0.5), 2.9), ((1, -1, 1), 3.1)]
    rows = spark.createDataFrame([(k, *map(float, rotation(a, t).ravel())) for k, (a, t) in enumerate(cases)],
                                 "k int, " + ", ".join(f"m{r}{c} double" for r in range(3) for c in range(3)))
    m = [[F.col(f"m{r}{c}") for c in range(3)] for r in range(3)]
    q = rows.select("*", *(c.alias(n) for c, n in zip(geometry.quaternion(m), "xyzw", strict=True)))
    cols = [F.col(n) for n in "xyzw"]
    back = geometry.matrix(*cols)
    v = geometry.rotation_vector(*geometry.align(cols, [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]))
    out = q.select("k", *cols, F.array(*(x for row in back for x in row)).alias("b"), F.array(*v).alias("v")).orderBy("k").collect()
    for r, (axis, angle) in zip(out, cases, strict=True):
        assert abs(r.x**2 + r.y**2 + r.z**2 + r.w**2 - 1) < 1e-12
        assert np.allclose(np.array(r.b).reshape(3, 3), rotation(axis, angle), atol=1e-9)
        want = np.array(axis) / np.linalg.norm(axis) * angle
        assert np.allclose(r.v, want, atol=1e-6) or (abs(angle - math.pi) < 1e-9 and np.allclose(r.v, -want, atol=1e-6))
    zero = spark.range(1).select(F.array(*(x for row in geometry.matrix(*[F.lit(0.0)] * 4) for x in row)).alias("b")).first().b
    assert zero == np.eye(3).ravel().tolist()


def test_relative_transform(spark):
    a, b, p, q = rotation((1, 2, 0), 0.7), rotation((0, 1, 1), 1.9), np.array([1.0, 2, 3]), np.array([-1.0, 0.5, 2])
    lit = lambda x: [[F.lit(float(v)) for v in row] for row in x]
    r, t = geometry.relative(lit(a), lit([p])[0], lit(b), lit([q])[0])
    got = spark.range(1).select(F.array(*(x for row in r for x in row)).alias("r"), F.array(*t).alias("t")).first()
    assert np.allclose(np.array(got.r).reshape(3, 3), a.T @ b) and np.allclose(got.t, a.T @ (q - p))


def test_paths_urls_numbers(spark):
    paths = ["a/12-34.rbxm", "001x12-34.rbxm", "d\\5-6.rbxm", "x.rbxm", "1-2.rbxm\n", "7-8.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    anim, clip = text.clip_ids(F.col("p"))
    assert [tuple(r) for r in rows.select(anim, clip).collect()] == [("12", "34"), ("12", "34"), ("5", "6"), (None, None), (None, None), (None, None)]
    urls = ["h?id=5", "h?x=1&id=6", "h/7", "h/id/8/x", "h?v=9", "h?id=1/2", "none", "h/99999999999999999999"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(text.asset_id(F.col("u")).alias("i")).collect()
    assert [r.i for r in got] == [5, 6, 7, 8, 9, 1, None, None]
    numbers = ["1.5", "nan", "-nan(ind)", "inf", "-inf", "", None, " 2 ", "x"]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select(text.safe_double(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [1.5, 0, 0, 0, 0, 0, 0, 2, 0]


def test_clip_order(spark):
    names = ["10-1", "9-2", "9-10", "x-1", "9"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.clip_sort_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["9-2", "9-10", "10-1", "9", "x-1"]


def test_mirror_is_its_own_inverse(spark):
    pairs = vectors.parse_pairs(MIRROR_PAIRS)
    swap = vectors.swap_index(15, pairs)
    frame = [float(k) for k in range(1, 91)]
    for axis in "xyz":
        once = vectors.mirror(F.array(*map(F.lit, frame)), swap, axis)
        got = spark.range(1).select(once.alias("m")).select("m", vectors.mirror(F.col("m"), swap, axis).alias("mm")).first()
        assert got.mm == frame and got.m != frame
    x = spark.range(1).select(vectors.mirror(F.array(*map(F.lit, frame)), swap, "x").alias("m")).first().m
    assert x[:6] == [-1.0, 2.0, 3.0, 4.0, -5.0, -6.0] and x[18:20] == [-37.0, 38.0]
    assert vectors.swap_index(3, [(0, 9)]) == [0, 1, 2]
    with pytest.raises(ValueError):
        vectors.swap_index(3, [(0, 9)], strict=True)
    e = spark.range(1).select(vectors.mirror_energy(F.array(*map(F.lit, map(float, range(15)))), swap).alias("e")).first().e
    assert e == [float(k) for k in swap]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(vectors.unit(a).alias("u"), vectors.cosine(a, b).alias("c"), vectors.dot(a, b).alias("d"), vectors.pad(a, 4).alias("p"), vectors.pad(a, 1).alias("q"),
                      vectors.relu(F.transform(a, lambda x: x - 3.5)).alias("r"), vectors.linear(a, [[1, 2], [0, 1], [1, 0]], [1, 0, 0]).alias("l"),
                      vectors.standardize(a, b, F.array(F.lit(2.0), F.lit(4.0))).alias("s")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[0].c == pytest.approx(0.96) and got[0].d == 24
    assert got[0].p == [3, 4, 0, 0] and got[0].q == [3] and got[0].r == [0, 0.5] and got[0].l == [12, 4, 3] and got[0].s == [-0.5, 0.25]
    assert got[1].u == [0, 0] and got[1].c == 0


def test_skeleton():
    assert len(BONES) == 15 and set(PARENTS) == set(BONES) and all(p in BONES or p == "HumanoidRootPart" for p in PARENTS.values())


@pytest.mark.parametrize(("text_", "rows"), [
    ("id,x\r\n1,\"a,b\"\n2,\"say \"\"hi\"\"\"\n", [["id", "x"], ["1", "a,b"], ["2", 'say "hi"']]),
    ("3,ab\"c\"d\n\n4,\"x\ny\"", [["3", "abcd"], [""], ["4", "x\ny"]]), ("5,\"open\n6,7", [["5", "open\n6,7"]]), ("", []), ("a,", [["a", ""]]), ("\r", [[""]])])
def test_quoted_rows(text_, rows):
    assert parse_quoted(text_) == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n ', max_size=6), min_size=1, max_size=4), max_size=5))
def test_quoted_rows_round_trip(rows):
    text_ = "".join(",".join('"' + f.replace('"', '""') + '"' for f in r) + "\n" for r in rows)
    assert parse_quoted(text_) == rows
