"""Queries of time series: sampling, differences, shifts, energy, statistics, mirrored frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EDGES
from ..functions import geometry, vectors
from ..operators import joins, series
from ..sources import sinks
from .clips import EVENTS
from .registry import query, table

V = ["value", "k"]
KEY = ["user_id"]
T_MAX = 60


def event_series(spark, d):
    """``user_id, frame_ix, value, k``: the events of a user as a clip of two features."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return series.frames(e, KEY, ["ts", "event_id"], V)


def _rounded(df, names, places=6):
    return df.select(*[c for c in df.columns if c not in names], *(F.round(c, places).alias(c) for c in names))


@query("first_differences", f"""WITH {EVENTS} SELECT user_id, frame_ix, round(value - lag(value) OVER w, 6) AS value, round(k - lag(k) OVER w, 6) AS k
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame_ix)""")
def first_differences(spark, d):
    return _rounded(series.difference(event_series(spark, d), KEY, V), V)


@query("derivative_frames", f"""WITH {EVENTS} SELECT user_id, frame_ix, round(coalesce(value - lag(value) OVER w, lead(value) OVER w - value, 0.0), 6) AS value,
round(coalesce(k - lag(k) OVER w, lead(k) OVER w - k, 0.0), 6) AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame_ix)""")
def derivative_frames(spark, d):
    return _rounded(series.derivative(event_series(spark, d), KEY, V), V)


@query("cyclic_shift", f"""WITH {EVENTS} SELECT user_id, CAST((frame_ix + 5) % (count(*) OVER (PARTITION BY user_id)) AS INT) AS frame_ix, value, k FROM ev""")
def cyclic_shift(spark, d):
    return series.roll(event_series(spark, d), KEY, F.lit(5))


@query("edge_shift_forward", f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS t FROM ev)
SELECT a.user_id, CAST(a.frame_ix AS INT) AS frame_ix, b.value, b.k FROM n a JOIN n b ON a.user_id = b.user_id AND b.frame_ix = greatest(0, a.frame_ix - 4)""")
def edge_shift_forward(spark, d):
    return series.shift(event_series(spark, d), KEY, V, 4)


@query("edge_shift_backward", f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS t FROM ev)
SELECT a.user_id, CAST(a.frame_ix AS INT) AS frame_ix, b.value, b.k FROM n a JOIN n b ON a.user_id = b.user_id AND b.frame_ix = least(a.t - 1, a.frame_ix + 3)""")
def edge_shift_backward(spark, d):
    return series.shift(event_series(spark, d), KEY, V, -3)


@query("reversed_frames", f"WITH {EVENTS} SELECT user_id, CAST(max(frame_ix) OVER (PARTITION BY user_id) - frame_ix AS INT) AS frame_ix, value, k FROM ev")
def reversed_frames(spark, d):
    return series.reverse(event_series(spark, d), KEY)


@query("repeated_frames", f"""WITH {EVENTS} SELECT user_id, frame_ix, last_value(CASE WHEN frame_ix = 0 OR frame_ix % 3 <> 1 THEN value END IGNORE NULLS) OVER w AS value,
last_value(CASE WHEN frame_ix = 0 OR frame_ix % 3 <> 1 THEN k END IGNORE NULLS) OVER w AS k FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY frame_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def repeated_frames(spark, d):
    return series.repeat_previous(event_series(spark, d), KEY, V, F.col("frame_ix") % 3 == 1)


GATHER = """CASE WHEN {n} <= {t} THEN least({k}, {n} - 1) WHEN {t} = 1 THEN 0 WHEN {k} = {t} - 1 THEN {n} - 1
ELSE CAST(floor(CAST({k} AS DOUBLE) * ((CAST({n} AS DOUBLE) - 1) / ({t} - 1))) AS BIGINT) END"""


@query("spliced_clips", f"""WITH {EVENTS}, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS t FROM ev), b AS (SELECT user_id - 1 AS user_id, frame_ix, value, k, t FROM a)
SELECT user_id, frame_ix, value, k FROM a WHERE frame_ix < t // 2
UNION ALL SELECT a.user_id, a.frame_ix, b.value, b.k FROM a JOIN b ON a.user_id = b.user_id AND a.frame_ix >= a.t // 2 AND b.frame_ix = {GATHER.format(k='(a.frame_ix - a.t // 2)', n='b.t', t='(a.t - a.t // 2)')}""")
def spliced_clips(spark, d):
    s = event_series(spark, d)
    return series.splice(s, s.withColumn("user_id", F.col("user_id") - 1), KEY, V)


@query("hemisphere_anchor", f"WITH {EVENTS} SELECT user_id, frame_ix, value, first_value(value) OVER (PARTITION BY user_id ORDER BY frame_ix) AS value_ref FROM ev")
def hemisphere_anchor(spark, d):
    return series.anchor(event_series(spark, d).drop("k"), KEY, ["frame_ix"], ["value"])


@query("padded_or_sampled", f"""WITH {EVENTS}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id), g AS (SELECT user_id, n, unnest(range({T_MAX})) AS kk FROM n)
SELECT g.user_id, CAST(g.kk AS INT) AS frame_ix, value, k FROM g JOIN ev ON ev.user_id = g.user_id AND ev.frame_ix = {GATHER.format(k='g.kk', n='g.n', t=T_MAX)}""")
def padded_or_sampled(spark, d):
    return series.pad_or_sample(event_series(spark, d), KEY, V, T_MAX)


@query("padded_or_cut", f"""WITH {EVENTS}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id), g AS (SELECT user_id, n, unnest(range({T_MAX})) AS kk FROM n)
SELECT g.user_id, CAST(g.kk AS INT) AS frame_ix, value FROM g JOIN ev ON ev.user_id = g.user_id AND ev.frame_ix = least(g.kk, g.n - 1)
UNION ALL SELECT c.c_custkey, CAST(kk AS INT), 0.0 FROM customer c, (SELECT unnest(range({T_MAX})) AS kk) WHERE c.c_custkey NOT IN (SELECT user_id FROM events)""")
def padded_or_cut(spark, d):
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return series.pad_or_sample(event_series(spark, d), KEY, ["value"], T_MAX, spread=False, clips=clips.join(
        table(spark, d, "events").select("user_id").distinct(), "user_id", "left_anti").unionByName(table(spark, d, "events").select("user_id").distinct()))


@query("flattened_clips", f"""WITH {EVENTS}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id), g AS (SELECT user_id, n, unnest(range({T_MAX})) AS kk FROM n),
s AS (SELECT g.user_id, g.kk, value, k FROM g JOIN ev ON ev.user_id = g.user_id AND ev.frame_ix = {GATHER.format(k='g.kk', n='g.n', t=T_MAX)})
SELECT user_id, count(*) * 2 AS size, round(sum(value * (2 * kk + 1) + k * (2 * kk + 2)), 3) AS weighted FROM s GROUP BY user_id""")
def flattened_clips(spark, d):
    flat = series.flatten_frames(series.pad_or_sample(event_series(spark, d), KEY, V, T_MAX), KEY, V)
    weighted = F.aggregate(F.transform("feat", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return flat.select("user_id", F.size("feat").cast("long").alias("size"), F.round(weighted, 3).alias("weighted"))


@query("padded_vectors", """SELECT vec_id, 100 AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total, 0.0 AS last FROM embeddings""")
def padded_vectors(spark, d):
    p = vectors.pad(F.transform("embedding", lambda x: x.cast("double")), 100)
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", F.size("p").alias("size"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.get("p", F.lit(99)).alias("last"))


@query("clip_lengths", "SELECT o_custkey AS clip, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), -1.0) AS duration FROM orders GROUP BY o_custkey")
def clip_lengths(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_totalprice").alias("key_time"), (F.col("o_orderstatus") == "F").alias("is_float"))
    return series.clip_length(o, ["clip"])


def _clips(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_totalprice") / 100000).alias("duration"))


@query("normalized_grid", """SELECT o_orderkey AS clip, CAST(i AS INT) AS frame_ix, i * (1.0::DOUBLE / 59) AS t, i * (1.0::DOUBLE / 59) * (o_totalprice / 100000) AS source_t
FROM orders, (SELECT unnest(range(60)) AS i)""")
def normalized_grid(spark, d):
    return series.uniform_grid(_clips(spark, d)).select("clip", "frame_ix", "t", "source_t")


@query("preserved_grid", """WITH c AS (SELECT o_orderkey AS clip, o_totalprice / 100000 AS duration, CAST(greatest(1, floor(o_totalprice / 100000 * 12 + 0.5)) AS BIGINT) AS n FROM orders),
g AS (SELECT *, unnest(range(n)) AS i FROM c) SELECT clip, CAST(i AS INT) AS frame_ix, i * (duration / greatest(1, n - 1)) AS source_t FROM g""")
def preserved_grid(spark, d):
    return series.uniform_grid(_clips(spark, d), 12, normalize=False).select("clip", "frame_ix", "source_t")


@query("mid_frame_grid", """WITH c AS (SELECT o_orderkey AS clip, o_totalprice / 100000 AS duration, CAST(greatest(1, ceil(o_totalprice / 100000 * 30)) AS BIGINT) AS n FROM orders),
g AS (SELECT *, unnest(range(n)) AS i FROM c) SELECT clip, CAST(i AS INT) AS frame_ix, (i + 0.5::DOUBLE) / 30 AS t, least((i + 0.5::DOUBLE) / 30, duration - 1e-6) AS source_t FROM g""")
def mid_frame_grid(spark, d):
    return series.mid_frame_grid(_clips(spark, d)).select("clip", "frame_ix", "t", "source_t")


CURVES = """keys AS (SELECT l_orderkey AS clip, l_linenumber::DOUBLE AS key_time, l_quantity AS v FROM lineitem), grid AS (SELECT DISTINCT l_orderkey AS clip, i AS frame_ix, i * 0.75 AS source_t FROM lineitem, (SELECT unnest(range(10)) AS i))"""


def _curves(spark, d):
    items = table(spark, d, "lineitem")
    keys = items.select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("double").alias("key_time"), F.col("l_quantity").alias("v"))
    keys = keys.groupBy("clip", "key_time").agg(F.max("v").alias("v"))
    clips = items.select(F.col("l_orderkey").alias("clip")).distinct()
    grid = clips.select("clip", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame_ix")).withColumn("source_t", F.col("frame_ix") * 0.75)
    return keys, grid


@query("linear_curves", f"""WITH {CURVES}, one AS (SELECT clip, key_time, max(v) AS v FROM keys GROUP BY ALL),
seg AS (SELECT *, lead(key_time) OVER w AS t1, lead(v) OVER w AS v1, row_number() OVER w AS n FROM one WINDOW w AS (PARTITION BY clip ORDER BY key_time))
SELECT g.clip, CAST(g.frame_ix AS INT) AS frame_ix, round(CASE WHEN g.source_t < s.key_time OR s.t1 IS NULL THEN s.v ELSE s.v + (g.source_t - s.key_time) / (s.t1 - s.key_time) * (s.v1 - s.v) END, 6) AS v
FROM grid g JOIN seg s ON s.clip = g.clip AND (g.source_t >= s.key_time OR s.n = 1) AND (g.source_t < s.t1 OR s.t1 IS NULL)""")
def linear_curves(spark, d):
    keys, grid = _curves(spark, d)
    return _rounded(series.sample_linear(grid, keys, ["clip"], "v").select("clip", "frame_ix", "v"), ["v"])


@query("marker_curves", f"""WITH {CURVES}, one AS (SELECT clip, key_time, max(v) AS v FROM keys GROUP BY ALL)
SELECT g.clip, CAST(g.frame_ix AS INT) AS frame_ix, (SELECT max_by(o.v, o.key_time) FROM one o WHERE o.clip = g.clip AND o.key_time <= g.source_t) AS v FROM grid g""")
def marker_curves(spark, d):
    keys, grid = _curves(spark, d)
    return series.sample_marker(grid, keys, ["clip"], "v").select("clip", "frame_ix", "v")


@query("clip_energy", f"""WITH {EVENTS}, s AS (SELECT user_id, abs(value - lag(value) OVER w) + abs(k - lag(k) OVER w) AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame_ix))
SELECT user_id, round(coalesce(sum(step), 0.0), 6) AS energy FROM s GROUP BY user_id""")
def clip_energy(spark, d):
    return _rounded(series.energy(event_series(spark, d), KEY, ["value"], ["k"]), ["energy"])


@query("frame_statistics", f"""WITH {EVENTS} SELECT CAST(frame_ix AS INT) AS frame_ix, round(avg(value), 6) AS value_mean, round(stddev_pop(value) + 1e-6, 6) AS value_std,
round(avg(k), 6) AS k_mean, round(stddev_pop(k) + 1e-6, 6) AS k_std FROM ev GROUP BY frame_ix""")
def frame_statistics(spark, d):
    return _rounded(series.statistics(event_series(spark, d), ["frame_ix"], V), ["value_mean", "value_std", "k_mean", "k_std"])


@query("normalized_frames", f"""WITH {EVENTS} SELECT user_id, CAST(frame_ix AS INT) AS frame_ix, round((value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-6), 4) AS value
FROM ev WINDOW p AS (PARTITION BY frame_ix)""")
def normalized_frames(spark, d):
    s = event_series(spark, d)
    stats = series.statistics(s, ["frame_ix"], ["value"])
    return _rounded(series.normalize(s.drop("k"), stats, ["frame_ix"], ["value"]).select("user_id", "frame_ix", "value"), ["value"], 4)


@query("clip_limits", f"""WITH {EVENTS}, b AS (SELECT user_id, min(value) AS a, max(value) AS b, min(k) AS c, max(k) AS d FROM ev GROUP BY user_id),
h AS (SELECT *, greatest(b - a, d - c, 6.0) / 2 AS half FROM b)
SELECT user_id, round((a + b) / 2 - half, 6) AS value_low, round((a + b) / 2 + half, 6) AS value_high, round((c + d) / 2 - half, 6) AS k_low, round((c + d) / 2 + half, 6) AS k_high FROM h""")
def clip_limits(spark, d):
    return _rounded(series.limits(event_series(spark, d), V, KEY), ["value_low", "value_high", "k_low", "k_high"])


@query("all_limits", """SELECT round((min(l_quantity) + max(l_quantity)) / 2 - h.half, 6) AS x_low, round((min(l_quantity) + max(l_quantity)) / 2 + h.half, 6) AS x_high,
round((min(l_tax) + max(l_tax)) / 2 - h.half, 6) AS y_low, round((min(l_tax) + max(l_tax)) / 2 + h.half, 6) AS y_high, round((min(l_discount) + max(l_discount)) / 2 - h.half, 6) AS z_low,
round((min(l_discount) + max(l_discount)) / 2 + h.half, 6) AS z_high
FROM lineitem, (SELECT greatest(max(l_quantity) - min(l_quantity), max(l_tax) - min(l_tax), max(l_discount) - min(l_discount), 6.0) / 2 AS half FROM lineitem) h GROUP BY h.half""")
def all_limits(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"))
    return _rounded(series.limits(p, ["x", "y", "z"]), ["x_low", "x_high", "y_low", "y_high", "z_low", "z_high"])


EDGE_LIST = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(EDGES))


@query("skeleton_segments", f"""WITH e(edge, a, b) AS (VALUES {EDGE_LIST})
SELECT vec_id, edge, round(embedding[3 * a + 1]::DOUBLE, 6) AS x0, round(embedding[3 * a + 2]::DOUBLE, 6) AS y0, round(embedding[3 * b + 1]::DOUBLE, 6) AS x1, round(embedding[3 * b + 2]::DOUBLE, 6) AS y1,
round(-embedding[3 * a + 3]::DOUBLE, 6) AS side0, round(-embedding[3 * b + 3]::DOUBLE, 6) AS side1 FROM embeddings, e""")
def skeleton_segments(spark, d):
    edges = F.array(*(F.struct(F.lit(k).alias("edge"), F.lit(3 * a).alias("a"), F.lit(3 * b).alias("b")) for k, (a, b) in enumerate(EDGES)))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.inline(edges))
    at = lambda end, k: F.round(F.get("embedding", F.col(end) + k).cast("double"), 6)
    return rows.select("vec_id", "edge", at("a", 0).alias("x0"), at("a", 1).alias("y0"), at("b", 0).alias("x1"), at("b", 1).alias("y1"),
                       (-at("a", 2)).alias("side0"), (-at("b", 2)).alias("side1"))


SWAP = [0, 1, 2, 6, 7, 8, 3, 4, 5, 9]


@query("mirrored_frames", """WITH s(k, b) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 6), (4, 7), (5, 8), (6, 3), (7, 4), (8, 5), (9, 9))
SELECT vec_id, round(sum(-embedding[6 * b + 1]::DOUBLE * (6 * k + 1) + embedding[6 * b + 2]::DOUBLE * (6 * k + 2) + embedding[6 * b + 3]::DOUBLE * (6 * k + 3)
 + embedding[6 * b + 4]::DOUBLE * (6 * k + 4) - embedding[6 * b + 5]::DOUBLE * (6 * k + 5) - embedding[6 * b + 6]::DOUBLE * (6 * k + 6)), 5) AS weighted, 60 AS size FROM embeddings, s GROUP BY vec_id""")
def mirrored_frames(spark, d):
    swap = vectors.swap_index(10, vectors.parse_pairs("3:6, 4:7,5:8,9:12"))
    m = vectors.mirror(F.transform("embedding", lambda x: x.cast("double")), swap, "x")
    weighted = F.aggregate(F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.round(weighted, 5).alias("weighted"), F.size("m").alias("size"))


@query("mirrored_union", "SELECT vec_id, 0 AS is_mirror, label FROM embeddings UNION ALL SELECT vec_id, 1, 9 - label FROM embeddings")
def mirrored_union(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return joins.mirrored_union(e, e.withColumn("label", 9 - F.col("label"))).select("vec_id", "is_mirror", "label")


@query("pose_file_lines", f"""WITH {EVENTS} SELECT user_id, CAST(frame_ix AS INT) AS frame_ix, concat_ws(',', CAST(frame_ix AS VARCHAR), printf('%.8f', value), printf('%.8f', k)) AS line FROM ev""")
def pose_file_lines(spark, d):
    return sinks.pose_lines(event_series(spark, d).select("user_id", "frame_ix", F.array("value", "k").alias("feat")), ["user_id"])


ANGLE = "l_orderkey % 360 * pi() / 180"


def _rotations(spark, d):
    a = F.col("l_orderkey") % 360 * F.lit(3.141592653589793) / 180
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("px"), F.col("l_discount").alias("py"), F.col("l_quantity").alias("pz"), (F.col("l_linenumber") % 3).alias("axis"), F.cos(a).alias("c"), F.sin(a).alias("s"))
    c, s, one, zero = F.col("c"), F.col("s"), F.lit(1.0), F.lit(0.0)
    by_axis = {0: [[one, zero, zero], [zero, c, -s], [zero, s, c]], 1: [[c, zero, s], [zero, one, zero], [-s, zero, c]], 2: [[c, -s, zero], [s, c, zero], [zero, zero, one]]}
    pick = lambda r, k: F.when(F.col("axis") == 0, by_axis[0][r][k]).when(F.col("axis") == 1, by_axis[1][r][k]).otherwise(by_axis[2][r][k])
    return rows.select("l_orderkey", "l_linenumber", "px", "py", "pz", "axis", *(pick(r, k).alias(f"m{r}{k}") for r in range(3) for k in range(3)))




def _matrix_columns():
    return [[F.col(f"m{r}{k}") for k in range(3)] for r in range(3)]


HALF = f"""h AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS axis, ({ANGLE}) / 2 AS a, l_orderkey % 360 AS deg FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, axis, deg, CASE WHEN axis = 0 THEN sin(a) ELSE 0 END AS x, CASE WHEN axis = 1 THEN sin(a) ELSE 0 END AS y, CASE WHEN axis = 2 THEN sin(a) ELSE 0 END AS z, cos(a) AS w FROM h)"""


@query("rotation_quaternions", f"""WITH {HALF} SELECT l_orderkey, l_linenumber, round(abs(x), 5) AS x, round(abs(y), 5) AS y, round(abs(z), 5) AS z, round(abs(w), 5) AS w,
CAST(round((x + y + z) * w * 1000) AS BIGINT) AS product FROM q""")
def rotation_quaternions(spark, d):
    rows = _rotations(spark, d)
    x, y, z, w = geometry.quaternion(_matrix_columns())
    q = rows.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))
    product = ((F.col("x") + F.col("y") + F.col("z")) * F.col("w"))
    return q.select("l_orderkey", "l_linenumber", *(F.round(F.abs(F.col(c)), 5).alias(c) for c in "xyzw"),
                    F.round(product * 1000).cast("long").alias("product"))


@query("rotation_vectors", f"""WITH {HALF} SELECT l_orderkey, l_linenumber, round(CASE WHEN axis = 0 THEN r ELSE 0 END, 4) AS lx, round(CASE WHEN axis = 1 THEN r ELSE 0 END, 4) AS ly,
round(CASE WHEN axis = 2 THEN r ELSE 0 END, 4) AS lz FROM (SELECT *, abs(CASE WHEN deg > 180 THEN deg - 360 ELSE deg END * pi() / 180) AS r FROM q)""")
def rotation_vectors(spark, d):
    rows = _rotations(spark, d)
    q = geometry.align(geometry.quaternion(_matrix_columns()), [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    named = rows.select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(q, "xyzw", strict=True)))
    v = geometry.rotation_vector(*(F.col(c) for c in "xyzw"))
    return named.select("l_orderkey", "l_linenumber", *(F.round(F.abs(c), 4).alias(n) for c, n in zip(v, ("lx", "ly", "lz"), strict=True)))


@query("matrix_round_trip", "SELECT count(*) AS n, 0 AS differ FROM lineitem")
def matrix_round_trip(spark, d):
    rows = _rotations(spark, d)
    q = geometry.quaternion(_matrix_columns())
    named = rows.select("*", *(c.alias(n) for c, n in zip(q, "xyzw", strict=True)))
    back = geometry.matrix(*(F.col(c) for c in "xyzw"))
    worst = F.greatest(*(F.abs(back[r][k] - F.col(f"m{r}{k}")) for r in range(3) for k in range(3)))
    return named.select((worst > 1e-9).cast("int").alias("bad")).agg(F.count("*").alias("n"), F.sum("bad").cast("int").alias("differ"))


@query("local_transforms", f"""WITH r AS (SELECT l_orderkey, l_linenumber, {ANGLE} AS a, l_linenumber % 3 AS axis, l_tax AS px, l_discount AS py, l_quantity AS pz FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN axis = 0 THEN px WHEN axis = 1 THEN cos(a) * px - sin(a) * pz ELSE cos(a) * px + sin(a) * py END, 5) AS x,
round(CASE WHEN axis = 0 THEN cos(a) * py + sin(a) * pz WHEN axis = 1 THEN py ELSE -sin(a) * px + cos(a) * py END, 5) AS y,
round(CASE WHEN axis = 0 THEN -sin(a) * py + cos(a) * pz WHEN axis = 1 THEN sin(a) * px + cos(a) * pz ELSE pz END, 5) AS z, 3.0 AS trace FROM r""")
def local_transforms(spark, d):
    rows = _rotations(spark, d)
    m = _matrix_columns()
    rotation, position = geometry.relative(m, [F.lit(0.0)] * 3, m, [F.col("px"), F.col("py"), F.col("pz")])
    return rows.select("l_orderkey", "l_linenumber", *((F.round(p, 5) + 0.0).alias(n) for p, n in zip(position, "xyz", strict=True)),
                       F.round(rotation[0][0] + rotation[1][1] + rotation[2][2], 6).alias("trace"))
