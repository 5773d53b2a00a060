"""Series, groups, similarity, encoder, training, files and streaming: invariants and edge cases."""

import math

import duckdb
import numpy as np
import pytest
from posewright.operators import analysis, components, encode, fingerprint, groups, joins, series, similarity, train
from posewright.plans import embeddings, registry
from posewright.sources import files, sinks
from posewright.streaming import duplicates
from pyspark.sql import functions as F

KEY, V = ["clip"], ["x"]


def clips(spark, sizes):
    rows = [(c, t, float(10 * c + t * t)) for c, n in enumerate(sizes) for t in range(n)]
    return spark.createDataFrame(rows, "clip int, frame_ix int, x double")


def by_clip(df):
    out = {}
    for r in df.orderBy("clip", "frame_ix").collect():
        out.setdefault(r.clip, []).append(r.x)
    return out


def picked(values, t, spread=True):
    n = len(values)
    if n <= t:
        return values + [values[-1]] * (t - n)
    at = np.linspace(0, n - 1, t).astype(np.int64) if spread else np.arange(t)
    return [values[k] for k in at]


def test_pad_or_sample(spark):
    sizes = [1, 5, 6, 7, 18, 100]
    s = clips(spark, sizes)
    values = by_clip(s)
    for spread in (True, False):
        got = by_clip(series.pad_or_sample(s, KEY, V, 6, spread, clips=spark.createDataFrame([(c,) for c in range(7)], "clip int")))
        assert got == {c: picked(values[c], 6, spread) for c in range(6)} | {6: [0.0] * 6}
    for t in (30, 60, 64, 90, 91, 100, 120):
        n = spark.range(1, 700).select(F.col("id").cast("int").alias("n"))
        got = n.select("n", F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda k: series.gather_index(k, F.col("n"), F.lit(t))).alias("k")).collect()
        assert all(r.k == picked(list(range(r.n)), t) for r in got)


def test_shifts_are_undone(spark):
    s = clips(spark, [1, 4, 9])
    assert by_clip(series.roll(series.roll(s, KEY, F.lit(3)), KEY, F.lit(-3))) == by_clip(s)
    assert by_clip(series.reverse(series.reverse(s, KEY), KEY)) == by_clip(s)
    v = by_clip(s)
    for by in (2, -2, 20):
        want = {c: [x[min(len(x) - 1, max(0, i - by))] for i in range(len(x))] for c, x in v.items()}
        assert by_clip(series.shift(s, KEY, V, by)) == want


def test_differences(spark):
    s = clips(spark, [1, 2, 5])
    v = by_clip(s)
    got = by_clip(series.derivative(s, KEY, V))
    for c, x in v.items():
        d = np.diff(x).tolist()
        assert got[c] == ([0.0] if len(x) == 1 else [d[0], *d])
    energy = {r.clip: r.energy for r in series.energy(s, KEY, ["x"], ["x"]).collect()}
    assert energy == {c: pytest.approx(2 * sum(abs(a - b) for a, b in zip(x, x[1:], strict=False))) for c, x in v.items()}


def test_grids(spark):
    c = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.26), (3, -1.0)], "clip int, duration double")
    g = series.uniform_grid(c, 60)
    assert g.groupBy("clip").count().where("count = 60").count() == 4
    ends = {r.clip: (r.a, r.b) for r in g.groupBy("clip").agg(F.min("source_t").alias("a"), F.max("source_t").alias("b")).collect()}
    assert ends[1] == (0, pytest.approx(1)) and ends[3] == (pytest.approx(-1), 0)
    n = {r.clip: r.n for r in series.uniform_grid(c, 10, normalize=False).groupBy("clip").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 1, 1: 10, 2: 3, 3: 1}
    m = {r.clip: (r.n, r.t) for r in series.mid_frame_grid(c).groupBy("clip").agg(F.count("*").alias("n"), F.max("source_t").alias("t")).collect()}
    assert m[1][0] == 30 and m[2] == (8, pytest.approx(7.5 / 30)) and m[0] == (1, -1e-6)


def test_fingerprint_ignores_row_order_and_time_scale(spark):
    rows = [(c, b, t, math.sin(t + b) + (0.5 if c == 2 else 0)) for c in (1, 2, 3) for b in (0, 1) for t in range(6)]
    schema = "clip int, bone int, frame_ix int, x double"
    f = lambda r: {x.clip: (x.hash_fnv, x.hash_murmur) for x in fingerprint.fingerprints(
        fingerprint.stream(spark.createDataFrame(r, schema), KEY, V, bone="bone")).collect()}
    a, b = f(rows), f(rows[::-1])
    assert a == b and a[1] == a[3] != a[2]


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([(1, "10"), (1, "9"), (1, "9"), (2, "5"), (3, "x"), (3, "4")], "h int, id string")
    got = [tuple(r) for r in fingerprint.duplicate_groups(rows, "h", F.col("id")).orderBy("first_id").collect()]
    assert got == [(3, 2, 0, "x,4"), (1, 3, 9, "9,9,10")]


def forest(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "LARGE", limit)
    rng = np.random.default_rng(3)
    for n, edges in ((6, [(k, k + 1) for k in range(5)]), (7, [(0, 1), (1, 2), (2, 0), (4, 5), (5, 6), (6, 4), (3, 3)]),
                     (60, rng.integers(0, 60, (45, 2)).tolist()), (40, [(0, k) for k in range(1, 40)])):
        df = spark.createDataFrame([(int(a), int(b)) if k % 2 else (int(b), int(a)) for k, (a, b) in enumerate(edges)] * 2 + [(None, 1), (1, None)], "i long, j long")
        got = {r.node: r.component for r in components.connected_components(df).collect()}
        label = forest(n, edges)
        assert got == {k: label[k] for k in {x for e in edges for x in e}}
    assert components.connected_components(spark.createDataFrame([], "i long, j long")).collect() == []


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.999])
def test_similarity_equals_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "PIVOT_ROWS", 20)
    monkeypatch.setattr(similarity, "STRIP", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    v = base[rng.integers(0, 12, 180)] + 0.15 * rng.normal(size=(180, 8))
    v[10], v[11], v[12] = v[3], v[3], 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, e array<double>")
    units, members = similarity.classes(df, "id", "e")
    got = similarity.similar_pairs(units, threshold, block_rows=9).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    reps = sorted({r.rep for r in members.collect()})
    want = {(i, j) for i in reps for j in reps if i < j and u[i] @ u[j] >= threshold}
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    label = forest(180, [(i, j) for i in range(180) for j in range(i) if u[i] @ u[j] >= threshold])
    found = {r.id: (r.component, r.group_id) for r in groups.similarity_groups(df, threshold, "id", "e").collect()}
    ranks = {c: k for k, c in enumerate(sorted(set(label)))}
    assert found == {k: (label[k], ranks[label[k]]) for k in range(180)}


def test_similarity_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, e array<double>")
    assert groups.similarity_groups(empty, 0.9, "id", "e").collect() == []
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, e array<double>")
    assert sorted(r.component for r in groups.similarity_groups(zeros, 0.9, "id", "e").collect()) == [1, 2]


def test_group_files(spark):
    g = spark.createDataFrame([(0, 0, "10", "1", "u0"), (1, 1, "7", "1", "u1"), (2, 0, "9", "2", "u2")], "row_ix int, group_id long, anim_id string, clip_id string, url string")
    assert [r.line for r in groups.group_lines(g).orderBy("group_id").collect()] == ["10 9", "7"]
    assert [tuple(r) for r in groups.shared_group_lines(g).collect()] == [(0, 2, "9,10,")]
    assert [r.line for r in groups.catalog_lines(g, "url").collect()] == ["# group 1 (2 clips)\nu0\nu2"]


def test_encoder(spark, tmp_path):
    layers = encode.Layers.formula((6, 5, 3))
    x = np.random.default_rng(0).normal(size=(4, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9, None), (10, [1.0])], "id int, feat array<double>")
    encode.save_layers(spark, layers, str(tmp_path / "w"))
    got = {r.id: r.emb for r in encode.embed(df, encode.load_layers(spark, str(tmp_path / "w"))).collect()}
    assert got[9] is None and got[10] is None
    for k in range(4):
        assert np.allclose(got[k], layers.forward(x[k]), rtol=1e-12)
    padded = {r.id: r.emb for r in encode.embed(df, layers, size=6, mean=np.ones(6), std=np.full(6, 2.0)).collect()}
    assert np.allclose(padded[10], layers.forward((np.array([1.0, 0, 0, 0, 0, 0]) - 1) / 2))


def test_training_gradients_and_losses():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    loss, da, db = train.contrast(a, b, 0.3)
    for m, d in ((a, da), (b, db)):
        for k in ((0, 1), (4, 3)):
            m[k] += 1e-6
            up = train.contrast(a, b, 0.3)[0]
            m[k] -= 2e-6
            down = train.contrast(a, b, 0.3)[0]
            m[k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(d[k], abs=1e-5)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 12))
    s = train.Settings(hidden=(16,), latent=4, epochs=12, batch=16, rate=3e-3)
    train.train(x, x[:, :2], s)
    assert s.history[-1]["reconstruction"] < 0.7 * s.history[0]["reconstruction"] and not math.isnan(s.history[-1]["validation"])
    again = train.Settings(hidden=(16,), latent=4, epochs=12, batch=16, rate=3e-3)
    train.train(x, x[:, :2], again)
    assert again.history == s.history
    assert train.learning_rate(s, 0) == 3e-3 and train.learning_rate(s, 45) == pytest.approx(3e-3 / 4)
    step = train.Settings(schedule="step", rate=1.0)
    assert [train.learning_rate(step, e) for e in (24, 25, 50)] == [1.0, 0.5, 0.25]
    grads = train.clip_norm([np.array([3.0]), np.array([4.0])], 1.0)
    assert [g[0] for g in grads] == pytest.approx([0.6, 0.8])
    tr, va = train.split(100, 0.2)
    assert len(va) == 20 and sorted([*tr, *va]) == list(range(100))


def test_training_keeps_32_bits_and_its_losses():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 12))
    s = train.Settings(hidden=(16,), latent=4, epochs=3, batch=16, rate=3e-3)
    nets = train.train(x, x[:, :2], s)
    assert {p.dtype for n in nets for p in (*n.weights, *n.biases)} == {np.dtype(np.float32)}
    # Losses of the trainer that had 64 bits.
    assert [h["loss"] for h in s.history] == pytest.approx([2.403852564939753, 2.2664832403483817, 2.147726091144723], rel=1e-4)
    assert [h["validation"] for h in s.history] == pytest.approx([1.623770819780882, 1.5414392050304697, 1.4502129218757869], rel=1e-4)


def test_training_of_views():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 12))
    swap, sign = np.array([2, 1, 0]), np.array([1, 1, -1])
    a, b = train.two_views(x[:9], np.random.default_rng(5), 4, 4, None, None)
    draws = np.random.default_rng(5)
    for view in (a, b):
        assert np.array_equal(view, [np.roll(c.reshape(4, 3), k, axis=0).ravel() for c, k in zip(x, draws.integers(-4, 5, 9))])
    s = train.Settings(hidden=(16,), latent=4, epochs=3, batch=16, rate=3e-3, clip=0.0, projection=4, weight=0.2, views=lambda x, r: train.two_views(x, r, 4, 4, swap, sign))
    nets = train.train(x, None, s)
    assert {p.dtype for n in nets for p in (*n.weights, *n.biases)} == {np.dtype(np.float32)}
    # Losses of the trainer that had 64 bits.
    assert [h["loss"] for h in s.history] == pytest.approx([3.0467514372782687, 3.033573323037846, 3.013949945766886], rel=1e-4)


@pytest.mark.parametrize("name", ["training_losses", "training_losses_of_views"])
def test_training_takes_every_row(spark, tmp_path, monkeypatch, name):
    n, seen = 200_100, []
    spark.range(n).selectExpr(f"{n} - id AS vec_id", "array(CAST(id AS FLOAT), 0.5F, -1F, 2F) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(train, "train", lambda x, energy, s: (seen.append((x, energy)), s.history.append(dict.fromkeys(("loss", "reconstruction", "contrastive", "validation"), 0.0) | {"epoch": 0})))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 1
    (x, energy), = seen
    assert x.dtype == np.float32 and x.shape == (n, 4) and np.array_equal(x[:, 0], np.arange(n)[::-1])  # in order of vec_id
    assert energy is None or np.array_equal(energy, np.abs(x))


def test_training_refuses_nulls_and_other_lengths(spark, tmp_path):
    for k, v in enumerate(("array(1F, NULL)", "IF(id = 1, NULL, array(1F, 2F))", "IF(id = 1, array(1F), array(1F, 2F))")):
        spark.range(3).selectExpr("id AS vec_id", f"{v} AS embedding").write.parquet(str(tmp_path / f"{k}" / "embeddings.parquet"))
        with pytest.raises(ValueError, match="one length and no nulls"):
            registry.QUERIES["training_losses"](spark, str(tmp_path / f"{k}"))


def test_means_of_a_gradient_that_stays_zero_end():
    adam = train.Adam(np.zeros(3, np.float32))
    for k in range(640):
        adam.step(np.array([k == 0, k == 0, 1], np.float32), 1e-3)
    assert adam.m[:2].tolist() == [0, 0] and adam.m[2] > 1 and adam.parameters[2] == pytest.approx(-0.64, rel=1e-3)


def test_losses_agree(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    rows = [(0, k, v, x[k].tolist()) for v, x in enumerate((a, b)) for k in range(6)]
    got = encode.contrastive_loss(spark.createDataFrame(rows, "batch long, pair int, view int, z array<double>"), "batch", "pair", "z", 0.3).first().loss
    assert got == pytest.approx(train.contrast(a, b, 0.3)[0], rel=1e-6)


def test_cluster_choice_covers_the_range(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(analysis, "cluster_choice", lambda rows, vector, ks, seed=42, restarts=5: asked.append((list(ks), restarts)))
    for n in (90, 200, 420):
        spark.range(n).selectExpr("id AS vec_id", "array(0.5D, CAST(id AS DOUBLE)) AS embedding").write.parquet(str(tmp_path / f"{n}" / "embeddings.parquet"))
        embeddings.cluster_choice(spark, str(tmp_path / f"{n}"))
    assert asked == [([], 5), (list(range(4, 10)), 5), (list(range(4, 21)), 5)]


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_silhouette_equals_the_definition(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 2)), 1)  # with rows that are equal
    labels = [rng.integers(0, 3, n), np.zeros(n, int), np.minimum(np.arange(n), 1)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for label, got in zip(labels, analysis.silhouette(x, labels), strict=True):
        each = []
        for i in range(n):
            inside = [d[i, j] for j in range(n) if j != i and label[j] == label[i]]
            outside = [d[i, label == c].mean() for c in set(label.tolist()) - {label[i]}]
            if not outside:
                break
            a, b = np.mean(inside) if inside else 0.0, min(outside)
            each.append((b - a) / max(a, b) if inside and max(a, b) > 0 else 0.0)
        assert got is None if not each else got == pytest.approx(np.mean(each), abs=1e-6)


def test_greatest_similarity_may_be_low(spark, tmp_path):
    for k, (vectors, best) in enumerate([([[1.0, 0.0], [0.2, 1.0]], 0.196116), ([[1.0, 0.0], [-1.0, 0.0]], -1.0), ([[1.0, 0.0]], None)]):
        spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / f"{k}" / "embeddings.parquet"))
        assert [r.max_sim for r in embeddings.max_similarity(spark, str(tmp_path / f"{k}")).collect()] == [best]


def test_analysis(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) * [5, 1, 0.1] + 7
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>")
    rows, share = analysis.principal_components(df, "e", 2)
    pc = np.array([r.pc for r in rows.orderBy("id").collect()])
    assert np.allclose(pc.mean(axis=0), 0, atol=1e-9) and share[0] > 0.9 and pc[:, 0].std() > 4
    labels = analysis.cluster(df, "e", 3, restarts=2).select("cluster").distinct().count()
    assert labels == 3
    assert analysis.cluster_choice(df, "e", [2, 3], restarts=1).count() == 2
    h = {r.bin: r.n for r in analysis.histogram(spark.createDataFrame([(float(k),) for k in range(81)], "v double"), "v").collect()}
    assert sum(h.values()) == 81 and max(h) == 79 and h[79] == 2
    assert analysis.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect() == [(0, 2)]
    assert analysis.sample_rows(df, 10, "id").count() == 10
    pairs = analysis.random_pairs(spark, 50, 500).collect()
    assert len(pairs) > 400 and all(0 <= r.i < 50 and 0 <= r.j < 50 and r.i != r.j for r in pairs)


def test_rig(spark):
    tracks = spark.createDataFrame([(1, "Head", 2.0), (1, "Other", 9.0), (2, "Other", 1.0)], "clip int, bone string, px double")
    got = {(r.clip, r.bone): r.px for r in joins.poses_of_bones(tracks, KEY, ("Head", "LeftHand"), {"px": 0.5}).collect()}
    assert got == {(1, "Head"): 2.0, (1, "LeftHand"): 0.5, (2, "Head"): 0.5, (2, "LeftHand"): 0.5}
    poses = spark.createDataFrame([(1, "Head", 2.0), (1, "UpperTorso", 3.0)], "clip int, bone string, px double")
    assert {(r.bone, r.px_parent) for r in joins.with_parent(poses, KEY, ["px"]).collect()} == {("Head", 3.0), ("UpperTorso", None)}


def test_pose_files(spark, tmp_path):
    head = sinks.pose_header()
    row = ",".join(["0"] + ["1.5"] * 88 + ["-nan(ind)", "inf"])
    (tmp_path / "1-2.csv").write_text(f"{head}\n{row}\n1,2,3\n{row},77\n")
    (tmp_path / "manifest.csv").write_text("animId,clipId,duration,numFrames\n1,2,1.5,45\n3,4,nan,-2\n5,6\n7,8,x,y\n")
    (tmp_path / "a-b-c.csv").write_text(f"{head}\n")
    poses = files.read_poses(spark, str(tmp_path / "1-2.csv")).collect()
    assert [len(p.feat) for p in poses] == [90, 90] and poses[0].feat[:1] + poses[0].feat[-2:] == [1.5, 0.0, 0.0]
    assert files.positions(files.read_poses(spark, str(tmp_path / "1-2.csv"))).count() == 30
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "manifest.csv")).collect()] == [("1", "2", 1.5, 45), ("3", "4", 0.0, 0), ("7", "8", 0.0, 0)]
    assert [(r.anim_id, r.clip_id, r.duration) for r in files.clips_without_manifest(spark, str(tmp_path)).collect()] == [("1", "2", 0.0)]
    (tmp_path / "12-34.rbxm").write_bytes(b"x")
    assert [(r.anim_id, r.clip_id) for r in files.list_clips(spark, str(tmp_path)).collect()] == [("12", "34")]
    frames = spark.createDataFrame([(1, 0, [0.5, -0.25])], "clip int, frame_ix int, feat array<double>")
    assert sinks.pose_lines(frames, KEY).first().line == "0,0.50000000,-0.25000000"


def test_embedding_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("animId,clipId,duration,emb1,emb2\n1,2,0.5,0.25,-1\n3,4,1\n5,6,x,nan,2\n")
    clean = files.read_embeddings(spark, str(tmp_path / "e.csv"), clean=True, components=2).collect()
    assert [(r.anim_id, r.duration, r.emb) for r in clean] == [("1", 0.5, [0.25, -1.0]), ("5", 0.0, [0.0, 2.0])]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_embeddings(spark, str(tmp_path / "e.csv")).collect()
    rows = spark.createDataFrame([(2, "b", "1", 1.0, [0.5]), (1, "a", "1", 2.0, [0.25])], "row_ix int, anim_id string, clip_id string, duration double, emb array<double>")
    sinks.write_lines(sinks.embedding_lines(rows, "row_ix"), str(tmp_path / "out"), ["row_ix"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a,1,2.000000,0.25000000", "b,1,1.000000,0.50000000"]
    (tmp_path / "c.csv").write_text('AssetId,Name\n12,"a,b"\n"13","x\ny"\nzz,1\n')
    assert [r.id for r in files.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == [12, 13]
    rows.write.parquet(str(tmp_path / "packed"))
    assert [r.row_ix for r in files.read_packed(spark, str(tmp_path / "packed"), 1).collect()] == [1]


def test_decimals_are_those_of_the_exact_value(spark):
    values = [53 / 512, 55 / 512, -53 / 512, 1.5e-8, 2.5e-9, -0.0, 1e22, None, float("nan"), float("-inf")]
    rows = [(k, str(k), "c", x, [x, 0.5]) for k, x in enumerate(values)] + [(99, "99", "c", 1 / 128, None)]
    e = spark.createDataFrame(rows, "row_ix int, anim_id string, clip_id string, duration double, emb array<double>")
    got = {r.row_ix: r.line.split(",")[2:] for r in sinks.embedding_lines(e, "row_ix").collect()}
    assert [got[k][1] for k in range(7)] == ["0.10351562", "0.10742188", "-0.10351562", "0.00000001", "0.00000000", "-0.00000000", "10000000000000000000000.00000000"]
    assert [got[k][1] for k in (7, 8, 9)] == ["null", "NaN", "-Infinity"] and got[0][2] == "0.50000000" and got[99] == ["0.007812"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(k, f"t{k % 3}") for k in range(50)], "id int, kind string")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = {r.key: r.n for r in duplicates.count_folder(spark, str(tmp_path / "in"), events.schema, F.col("kind"), "test").collect()}
    assert got == {r.key: r.n for r in duplicates.running_counts(events, F.col("kind")).collect()}


def test_copies_lose_no_link(spark, tmp_path):
    base = [[1.0, 0.0, 0.2], [0.9, 0.1, 0.2], [0.0, 1.0, 0.0], [1.0, 0.0, 0.2], [2.0, 0.0, 0.4], [0.0, 1.0, 0.0], [1.0, 0.0, 0.2], [-1.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(base)), "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    u = np.array(base) / np.linalg.norm(base, axis=1, keepdims=True)
    want = {(i, j) for i in range(8) for j in range(i + 1, 8) if u[i] @ u[j] >= embeddings.T}
    first = {k: min(j for j in range(8) if base[j] == base[k]) for k in range(8)}

    def rebuilt(links):
        near = {(i, j) for i, j in links if first[i] != first[j]}
        assert all(first[i] == i and first[j] == j for i, j in near) and all(first[j] == i for i, j in links if first[i] == first[j])
        return {(i, j) for i in range(8) for j in range(i + 1, 8) if tuple(sorted((first[i], first[j]))) in near or first[i] == first[j]}

    got = embeddings.similar_pairs(spark, str(tmp_path)).collect()
    assert rebuilt([(r.i, r.j) for r in got]) == want and all(abs(r.sim - u[r.i] @ u[r.j]) < 1e-5 for r in got)
    both = {(r.i, r.j) for r in embeddings.symmetric_edges(spark, str(tmp_path)).collect()}
    assert both == {(a, b) for r in got for a, b in ((r.i, r.j), (r.j, r.i))}
    assert [r.max_sim for r in embeddings.max_similarity(spark, str(tmp_path)).collect()] == [1.0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(registry.ORACLES["similar_pairs"]).fetchall()) == sorted(map(tuple, got))
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, e array<double>")
    assert similarity.similar_rows(zeros, 0.5, "id", "e").collect() == []


def test_curves_between_keys(spark):
    rng = np.random.default_rng(6)
    keys = [(c, float(t), float(rng.normal()), float(rng.normal())) for c in range(5) for t in sorted(rng.choice(20, c, replace=False))] + [(7, 1.0, 5.0, 6.0), (7, 1.0, 7.0, 8.0)]
    grid = [(c, k, k * 0.7 - 1) for c in (*range(5), 7, 8) for k in range(35)] + [(2, 99, None)]
    got = series.sample_curves(spark.createDataFrame(grid, "clip int, frame_ix int, source_t double"), spark.createDataFrame(keys, "clip int, key_time double, x double, y double"), KEY, ["x", "y"]).collect()
    mine = {c: [k for k in keys if k[0] == c] for c in range(9)}
    assert len(got) == sum(bool(mine[c]) and t is not None for c, _, t in grid)
    for r in got:
        if r.clip == 7:
            assert (r.x, r.y) == ((5.0, 6.0) if r.source_t < 1 else (7.0, 8.0))
            continue
        times = [k[1] for k in mine[r.clip]]
        for name, at in (("x", 2), ("y", 3)):
            assert r[name] == pytest.approx(np.interp(r.source_t, times, [k[at] for k in mine[r.clip]]), abs=1e-12)


def test_rotations_take_the_short_way(spark):
    q = lambda a, s=1.0: (0.0, 0.0, s * math.sin(a / 2), s * math.cos(a / 2))
    keys = [(1, 0.0, *q(0.2)), (1, 1.0, *q(0.6, -1.0)), (1, 2.0, *q(0.8)), (2, 0.0, 0.0, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(keys, "clip int, key_time double, qx double, qy double, qz double, qw double")
    grid = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (2, 0, 0.0), (3, 0, 1.0)], "clip int, frame_ix int, source_t double")
    got = {(r.clip, r.frame_ix): r for r in series.sample_track(grid, rows.limit(0).withColumns({c: F.lit(1.0) for c in ("px", "py", "pz")}), rows, KEY).collect()}
    for at, angle in (((1, 0), 0.4), ((1, 1), 0.7)):
        assert abs(2 * math.atan2(got[at].qz, got[at].qw)) % (2 * math.pi) == pytest.approx(angle, abs=1e-3) or 2 * math.pi - abs(2 * math.atan2(got[at].qz, got[at].qw)) == pytest.approx(angle, abs=1e-3)
    assert got[2, 0].qw == 1.0 and (got[3, 0].qw, got[3, 0].qx, got[3, 0].px) == (1.0, 0.0, 0.0)


def test_split_is_whole_and_repeatable(spark):
    rows = spark.createDataFrame([(k * 7,) for k in range(101)], "id long")
    a, b = ({(r.id, r.is_validation) for r in joins.split_rows(x, "id", 0.2).collect()} for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 101 and sum(v for _, v in a) == 20
    assert joins.split_rows(rows.limit(0), "id", 0.2).collect() == []


def test_bad_lines_are_put_aside(spark):
    lines = spark.createDataFrame([("animId,clipId,duration,emb1,emb2",), ("1,2,0.5,0.25,-1",), ("3,4,1",), ("5,6,x,1,2",), ("7,8,1,nan,2",), ("",), ("9,9,2,1,2,3",)], "value string")
    rows, rejects = files.rows_and_rejects(lines)
    assert sorted((r.anim_id, len(r.emb)) for r in rows.collect()) == [("1", 2), ("9", 3)]
    assert sorted((r.line, r.reason) for r in rejects.collect()) == [("", "too few fields"), ("3,4,1", "too few fields"), ("5,6,x,1,2", "bad number"), ("7,8,1,nan,2", "bad number")]
    assert sorted((r.anim_id, len(r.emb)) for r in files.rows_and_rejects(lines, 2)[0].collect()) == [("1", 2), ("9", 2)]
