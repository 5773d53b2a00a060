"""The whole flows against NumPy, the registered queries against DuckDB, and the driver contract."""

import importlib
import sys

import duckdb
import numpy as np
import pytest
from posewright.operators import encode, tracks
from posewright.plans import flows, registry
from posewright.plans.series import event_series

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.mark.parametrize("derivative", [False, True])
def test_near_duplicates_equal_numpy(spark, derivative):
    frames = event_series(spark, DATA)
    layers = encode.Layers.formula((120, 32, 16))
    got = {r.user_id: r.component for r in flows.near_duplicates(frames, "user_id", ["value", "k"], 60, layers, 0.9, derivative).collect()}
    clips = {}
    for r in frames.orderBy("user_id", "frame_ix").collect():
        clips.setdefault(r.user_id, []).append((r.value, r.k))
    ids = sorted(clips)
    x = []
    for i in ids:
        c = np.array(clips[i])
        at = np.linspace(0, len(c) - 1, 60).astype(np.int64) if len(c) > 60 else np.minimum(np.arange(60), len(c) - 1)
        c = c[at]
        if derivative:
            c = np.concatenate([np.diff(c, axis=0)[:1], np.diff(c, axis=0)])
        x.append(c.ravel())
    x = np.array(x)
    z = layers.forward((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    label = list(range(len(ids)))
    for i, j in zip(*np.nonzero(z @ z.T >= 0.9), strict=True):
        a, b = label[i], label[j]
        label = [min(a, b) if v in (a, b) else v for v in label]
    assert got == {i: ids[label[k]] for k, i in enumerate(ids)}


def test_exact_duplicates_of_poses(spark):
    rows = [(c, b, t, float(c % 2), 0.0, float(t), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for c in range(4) for b in range(2) for t in range(3)]
    names = ["clip", "bone_ix", "frame_ix", "px", "py", "pz", *(f"m{r}{c}" for r in range(3) for c in range(3))]
    out = flows.exact_duplicates(spark.createDataFrame(rows, names), ["clip"], "clip")
    for k in ("by_fnv", "by_murmur", "by_key"):
        assert sorted(r.ids for r in out[k].collect()) == ["0,2", "1,3"]


def test_tracks(spark):
    folders = spark.createDataFrame([(1, "a", 1, 1, 0), (1, "a", 2, 2, 1), (1, "a", None, 3, 2), (1, "b", 1, None, 0)], "clip int, name string, position int, rotation int, ix int")
    assert [tuple(r) for r in tracks.tracks_of(folders, ["clip"]).collect()] == [(1, "a", 2, 2)]
    assert tracks.track_order(["x"]) == ["x"] and len(tracks.track_order()) == 16


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry_without_the_llm_folders(spark, monkeypatch):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("posewright.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "posewright.llm", None)
    bare = importlib.reload(entry)
    try:
        assert set(bare.queries()) == set(registry.QUERIES) and set(bare.oracle_sql()) == set(registry.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
