"""Time series of clips: sampling grids, resampling, differences, shifts, energy, statistics.

A series table has one row per frame: key columns, ``frame_ix`` (0-based) and value columns. Windows are
partitioned by the key, so a plan shuffles once by clip whatever number of operators follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def frames(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Number the rows of each key in order: ``key, frame_ix, values``."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.select(*key, (F.row_number().over(w) - 1).alias("frame_ix"), *values)


def _over(key: Sequence[str]):
    return W.partitionBy(*key).orderBy("frame_ix")


def clip_length(keys: DataFrame, key: Sequence[str], time: str = "key_time", is_float: str = "is_float") -> DataFrame:
    """``key, duration``: the latest key time of float curves, -1 for a clip that has none."""
    return keys.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col(is_float), F.col(time))), F.lit(-1.0)).alias("duration"))


def difference(series: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First differences; the first frame of a clip has none and is null."""
    w = _over(key)
    return series.select(*key, "frame_ix", *((F.col(v) - F.lag(v).over(w)).alias(v) for v in values))


def derivative(series: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First differences, with the first frame repeating the second; zero for a single frame."""
    w = _over(key)
    return series.select(*key, "frame_ix", *(
        F.coalesce(F.col(v) - F.lag(v).over(w), F.lead(v).over(w) - F.col(v), F.lit(0.0)).alias(v) for v in values))


def roll(series: DataFrame, key: Sequence[str], by: Column) -> DataFrame:
    """Cyclic shift: frame ``i`` becomes ``(i + by) mod T``."""
    size = F.count("*").over(W.partitionBy(*key))
    return series.withColumn("frame_ix", F.pmod(F.col("frame_ix") + by, size).cast("int"))


def shift(series: DataFrame, key: Sequence[str], values: Sequence[str], by: int) -> DataFrame:
    """Shift without wrap-around; the first or last frame fills the gap."""
    w = _over(key)
    move = F.lag if by >= 0 else F.lead
    edge = (F.first if by >= 0 else F.last)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return series.select(*key, "frame_ix", *(
        F.when(move(F.lit(1), abs(by)).over(w).isNotNull(), move(v, abs(by)).over(w)).otherwise(edge(v).over(whole)).alias(v) for v in values))


def reverse(series: DataFrame, key: Sequence[str]) -> DataFrame:
    last = F.max("frame_ix").over(W.partitionBy(*key))
    return series.withColumn("frame_ix", last - F.col("frame_ix"))


def repeat_previous(series: DataFrame, key: Sequence[str], values: Sequence[str], dropped: Column) -> DataFrame:
    """Replace dropped frames by the last one kept before them; a first frame is never dropped."""
    keep = ~dropped | (F.col("frame_ix") == 0)
    w = _over(key).rowsBetween(W.unboundedPreceding, 0)
    return series.select(*key, "frame_ix", *(
        F.last(F.when(keep, F.struct(v)), ignorenulls=True).over(w).getField(v).alias(v) for v in values))


def splice(series: DataFrame, other: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The second half of each clip replaced by the clip of the same key in ``other``, resampled to fit it."""
    def sized(df):
        return df.withColumn("size", F.count("*").over(W.partitionBy(*key)))

    a, b = sized(series), sized(other)
    half = F.floor(F.col("size") / 2)
    head = a.where(F.col("frame_ix") < half).select(*key, "frame_ix", *values)
    room = a.where(F.col("frame_ix") >= half).select(*key, "frame_ix", (F.col("frame_ix") - half).alias("ahead"), (F.col("size") - half).alias("room"))
    source = b.select(*key, F.col("frame_ix").alias("source_ix"), F.col("size").alias("source_size"), *values)
    sizes = source.groupBy(*key).agg(F.max("source_size").alias("source_n"))
    wanted = room.join(sizes, list(key)).withColumn("source_ix", gather_index(F.col("ahead"), F.col("source_n"), F.col("room")))
    return head.unionByName(wanted.join(source, [*key, "source_ix"]).select(*key, "frame_ix", *values))


def anchor(series: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``<value>_ref``: the values of a clip's first row, the reference of its hemisphere."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return series.select("*", *(F.first(v).over(w).alias(f"{v}_ref") for v in values))


def uniform_grid(clips: DataFrame, fps: int = 60, normalize: bool = True) -> DataFrame:
    """Sampling times with both ends included: ``frame_ix, t, source_t`` for each clip with a ``duration``.

    Normalised, every clip has ``fps`` frames over one second and is read along its own duration; else it
    keeps its length.
    """
    d = F.col("duration")
    n = F.lit(max(1, fps)) if normalize else F.greatest(F.lit(1), F.floor(d * fps + 0.5)).cast("int")
    span = F.lit(1.0) if normalize else d
    rows = clips.withColumn("n_frames", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_ix"))
    t = F.col("frame_ix") * (span / F.greatest(F.lit(1), F.col("n_frames") - 1))
    return rows.withColumn("t", t).withColumn("source_t", t * d if normalize else t)


def mid_frame_grid(clips: DataFrame, fps: int = 30) -> DataFrame:
    """Sampling in the middle of frames: ``ceil(duration * fps)`` of them, read just before the end at the latest."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") * fps)).cast("int")
    rows = clips.withColumn("n_frames", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_ix"))
    t = (F.col("frame_ix") + 0.5) / fps
    return rows.withColumn("t", t).withColumn("source_t", F.least(t, F.col("duration") - 1e-6))


def sample_curves(grid: DataFrame, keys: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of curves at each ``source_t``: linear between the keys around it, the end keys outside.

    Each key carries its successor, and one sort of keys and grid points by time gives a point the last key
    at or before it. Points of a clip without keys, and without a time, are left out; of keys at one time, the
    last by their values stands.
    """
    after = W.partitionBy(*key).orderBy("key_time", *values)
    known = F.struct(F.col("key_time").alias("t0"), F.lead("key_time").over(after).alias("t1"),
                     *(F.col(v).cast("double").alias(f"a{k}") for k, v in enumerate(values)), *(F.lead(v).over(after).cast("double").alias(f"b{k}") for k, v in enumerate(values)))
    steps = keys.select(*key, known.alias("seg")).select(*key, F.col("seg.t0").alias("at"), F.lit(0).alias("is_point"), "seg")
    point = F.struct(*(F.col(c) for c in grid.columns if c not in key))
    points = grid.where(F.col("source_t").isNotNull()).select(*key, F.col("source_t").alias("at"), F.lit(1).alias("is_point"), point.alias("point"))
    both = points.unionByName(steps, allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy("at", "is_point", F.col("seg.t1").isNull(), "seg.t1")
    seen = F.last("seg", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.first("seg", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    near = both.withColumn("seen", seen).withColumn("first", first).where("is_point = 1 AND first IS NOT NULL")
    share = (F.col("at") - F.col("seen.t0")) / (F.col("seen.t1") - F.col("seen.t0"))
    value = lambda k: F.when(F.col("seen").isNull(), F.col(f"first.a{k}")).when(F.col("seen.t1").isNull(), F.col(f"seen.a{k}")).otherwise(
        F.col(f"seen.a{k}") + share * (F.col(f"seen.b{k}") - F.col(f"seen.a{k}")))
    return near.select(*(F.col(c) if c in key else F.col(f"point.{c}").alias(c) for c in grid.columns), *(value(k).alias(v) for k, v in enumerate(values)))


def sample_linear(grid: DataFrame, keys: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``sample_curves`` of one value."""
    return sample_curves(grid, keys, key, [value])


QUATERNION = ("qx", "qy", "qz", "qw")


def sample_rotation(grid: DataFrame, keys: DataFrame, key: Sequence[str], values: Sequence[str] = QUATERNION) -> DataFrame:
    """Unit quaternions at each ``source_t``: linear between the keys around it, the later one turned to the hemisphere
    of the earlier, then normalised; a zero quaternion becomes the identity."""
    order = W.partitionBy(*key).orderBy("key_time", *values)
    dot = sum((F.col(v) * F.lag(v).over(order) for v in values[1:]), F.col(values[0]) * F.lag(values[0]).over(order))
    flips = F.sum(F.when(F.col("turn") < 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    turned = keys.withColumn("turn", dot).withColumn("flips", flips)
    smooth = turned.select(*key, "key_time", *(F.when(F.col("flips") % 2 == 1, -F.col(v)).otherwise(F.col(v)).alias(v) for v in values))
    out = sample_curves(grid, smooth, key, values)
    size = F.sqrt(sum((F.col(v) * F.col(v) for v in values[1:]), F.col(values[0]) * F.col(values[0])))
    still = dict(zip(values, (0.0, 0.0, 0.0, 1.0), strict=True))
    return out.withColumns({v: F.when(size > 0, F.col(v) / size).otherwise(still[v]) for v in values})


def sample_track(grid: DataFrame, positions: DataFrame, rotations: DataFrame, key: Sequence[str], position: Sequence[str] = ("px", "py", "pz"),
                 rotation: Sequence[str] = QUATERNION) -> DataFrame:
    """Position and rotation of a track at each ``source_t``, each from its own keys; a track without them stays at the identity."""
    at = [*key, "frame_ix"]
    moved = sample_curves(grid, positions, key, position).select(*at, *position)
    turned = sample_rotation(grid, rotations, key, rotation).select(*at, *rotation)
    still = {**dict.fromkeys(position, 0.0), **dict.fromkeys(rotation, 0.0), rotation[-1]: 1.0}
    out = grid.join(moved, at, "left").join(turned, at, "left")
    return out.select(*grid.columns, *(F.coalesce(F.col(c), F.lit(still[c])).alias(c) for c in (*position, *rotation)))


def sample_marker(grid: DataFrame, markers: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Value of the latest marker at or before each ``source_t``, else null: one sort of both by time."""
    points = grid.select(*key, "frame_ix", F.col("source_t").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast(dict(markers.dtypes)[value]).alias(value))
    marks = markers.select(*key, F.lit(None).cast("int").alias("frame_ix"), F.col("key_time").alias("at"), F.lit(0).alias("is_point"), value)
    w = W.partitionBy(*key).orderBy("at", "is_point").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("is_point") == 0, F.struct(value)), ignorenulls=True).over(w).getField(value)
    return points.unionByName(marks).withColumn("seen", seen).where("is_point = 1").select(*key, "frame_ix", F.col("at").alias("source_t"), F.col("seen").alias(value))


def gather_index(k: Column, size: Column, target: Column, spread: bool = True) -> Column:
    """Which of ``size`` frames is frame ``k`` of ``target``: the last repeats if short; spread evenly or cut if long."""
    even = F.when(k == target - 1, size - 1).otherwise(F.floor(k.cast("double") * ((size - 1) / (target - 1)))) if spread else k
    return F.when(size <= target, F.least(k, size - 1)).otherwise(F.when(target == 1, F.lit(0)).otherwise(even)).cast("int")


def pad_or_sample(series: DataFrame, key: Sequence[str], values: Sequence[str], frames_out: int, spread: bool = True,
                  clips: DataFrame | None = None) -> DataFrame:
    """Every clip with ``frames_out`` frames; clips of ``clips`` without frames are zeros.

    Each frame computes which output frames it becomes, so there is no join: a short clip's last frame
    fills the rest, and a long clip's frames are picked evenly (or its head is kept).
    """
    size = F.count("*").over(W.partitionBy(*key))
    rows = series.withColumn("size", size)
    all_k = F.sequence(F.lit(0), F.lit(frames_out - 1))
    mine = F.filter(all_k, lambda k: gather_index(k, F.col("size"), F.lit(frames_out), spread) == F.col("frame_ix"))
    out = rows.select(*key, F.explode(mine).alias("frame_ix"), *values)
    if clips is None:
        return out
    empty = clips.select(*key).join(series.select(*key).distinct(), list(key), "left_anti")
    return out.unionByName(empty.select(*key, F.explode(all_k).alias("frame_ix"), *(F.lit(0.0).alias(v) for v in values)))


def flatten_frames(series: DataFrame, key: Sequence[str], values: Sequence[str], name: str = "feat") -> DataFrame:
    """One row per clip with all values of its frames in order as one array; bounded by the resampled length."""
    packed = F.array_sort(F.collect_list(F.struct("frame_ix", F.array(*(F.col(v).cast("double") for v in values)).alias("v"))))
    return series.groupBy(*key).agg(F.flatten(F.transform(packed, lambda s: s["v"])).alias(name))


def energy(series: DataFrame, key: Sequence[str], position: Sequence[str], rotation: Sequence[str]) -> DataFrame:
    """``key, energy``: summed lengths of the steps in position and in rotation; zero below two frames."""
    w = _over(key)

    def step(columns):
        moves = [F.col(c) - F.lag(c).over(w) for c in columns]
        return F.sqrt(sum((m * m for m in moves[1:]), moves[0] * moves[0]))

    moved = series.select(*key, (step(position) + step(rotation)).alias("step"))
    return moved.groupBy(*key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("energy"))


def statistics(series: DataFrame, at: Sequence[str], values: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation plus ``floor`` of each value by position."""
    return series.groupBy(*at).agg(*(a for v in values for a in (
        F.avg(v).alias(f"{v}_mean"), (F.stddev_pop(v) + F.lit(floor)).alias(f"{v}_std"))))


def normalize(series: DataFrame, stats: DataFrame, at: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values less their mean over their deviation; ``stats`` has one row per position and is joined by it."""
    rest = [c for c in series.columns if c not in values]
    return series.join(stats, list(at)).select(*rest, *(((F.col(v) - F.col(f"{v}_mean")) / F.col(f"{v}_std")).alias(v) for v in values))


def limits(points: DataFrame, axes: Sequence[str], key: Sequence[str] = (), least: float = 6.0) -> DataFrame:
    """Equal-sided box around all points: ``<axis>_low``, ``<axis>_high``, with a least size."""
    ends = points.groupBy(*key).agg(*(a for c in axes for a in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))))
    half = F.greatest(*(F.col(f"{c}_b") - F.col(f"{c}_a") for c in axes), F.lit(least)) / 2
    return ends.select(*key, *(a for c in axes for a in (((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2 - half).alias(f"{c}_low"),
                                                         ((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2 + half).alias(f"{c}_high"))))
