"""The two whole flows: exact duplicates by fingerprint, and near duplicates by embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import encode, fingerprint, groups, series, tracks
from ..staging import stage
from .clips import FMIX, fnv_words, murmur_words
from .registry import query, table
from .series import _matrix_columns, _rotations, event_series


def exact_duplicates(poses: DataFrame, key: Sequence[str], ids: str) -> dict[str, DataFrame]:
    """``fingerprints`` of clips, and duplicate groups ``by_fnv``, ``by_murmur``, ``by_key``.

    ``poses`` has ``bone_ix, frame_ix``, a position ``px, py, pz`` and a rotation ``m00 .. m22``. Two shuffles:
    by clip for the streams, by hash for the groups.
    """
    quaternion = [q.alias(n) for q, n in zip(geometry.quaternion(_matrix_columns()), ("qx", "qy", "qz", "qw"), strict=True)]
    rows = poses.select(*key, "bone_ix", "frame_ix", "px", "py", "pz", *quaternion)
    hashed = stage(fingerprint.fingerprints(fingerprint.stream(rows, key, ["px", "py", "pz", "qx", "qy", "qz", "qw"], bone="bone_ix")), "flow-hashes")
    return {"fingerprints": hashed} | {f"by_{n}": fingerprint.duplicate_groups(hashed, f"hash_{n}", F.col(ids)) for n in ("fnv", "murmur", "key")}


def near_duplicates(frames: DataFrame, key: str, values: Sequence[str], size: int, layers: encode.Layers, threshold: float,
                    derivative: bool = False) -> DataFrame:
    """``key, component, group_id``: clips resampled, standardised by position, embedded and grouped by cosine.

    With ``derivative`` the resampled frames are replaced by their differences, as the second encoder expects.

    The statistics are one row for each of the ``size`` frames, so their arrays fit any task.
    """
    even = series.pad_or_sample(frames, [key], values, size)
    even = stage(series.derivative(even, [key], values) if derivative else even, "flow-frames")
    stats = {r["frame_ix"]: r for r in series.statistics(even, ["frame_ix"], values).collect()}
    mean = np.array([stats[k][f"{v}_mean"] for k in sorted(stats) for v in values])
    std = np.array([stats[k][f"{v}_std"] for k in sorted(stats) for v in values])
    embedded = stage(encode.embed(series.flatten_frames(even, [key], values), layers, mean=mean, std=std).select(key, "emb"), "flow-embeddings")
    return groups.similarity_groups(embedded, threshold, key, "emb")


def _quantized(x: str) -> str:
    return f"((CAST(floor(({x}) / 0.01 + 0.5) AS BIGINT) % 4294967296 + 4294967296) % 4294967296)::UBIGINT"


#: Half the angle is at most 180 degrees, so its sine is positive; the sign is that of the larger term's case.
DOUBLED = f"""h AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS axis, l_orderkey % 360 * pi() / 180 AS a, l_tax, l_discount, l_quantity FROM lineitem),
q AS (SELECT *, CASE WHEN 1 + 2 * cos(a) > 0 AND cos(a / 2) < 0 THEN -1 ELSE 1 END AS s FROM h),
f AS (SELECT l_orderkey AS clip, l_linenumber % 3 AS bone, l_linenumber // 3 AS frame, [{', '.join(_quantized(x) for x in (
    'l_tax', 'l_discount', 'l_quantity', *(f'CASE WHEN axis = {k} THEN s * sin(a / 2) ELSE 0 END' for k in range(3)), 's * cos(a / 2)'))}] AS w FROM q WHERE l_orderkey % 15 > 0),
b AS (SELECT clip, bone, list_prepend(count(*)::UBIGINT, flatten(list(w ORDER BY frame, w))) AS w FROM f GROUP BY clip, bone),
c AS (SELECT clip, flatten(list(w ORDER BY bone)) AS words FROM b GROUP BY clip),
k AS (SELECT clip, words, CAST({fnv_words('words')} AS BIGINT) AS hash_fnv, {murmur_words('words')} AS h, len(words) AS n FROM c),
g AS (SELECT clip, printf('%08X%08X', hash_fnv, CAST({FMIX.format(h='k.h', n='k.n')} AS BIGINT)) AS hash_key FROM k),
two AS (SELECT hash_key, clip FROM g UNION ALL SELECT hash_key, clip + 100000000 FROM g)"""


@query("exact_duplicate_flow", f"""WITH {DOUBLED} SELECT hash_key, count(*) AS n, min(clip) AS first_id, string_agg(CAST(clip AS VARCHAR), ',' ORDER BY clip) AS ids FROM two GROUP BY hash_key""")
def exact_duplicate_flow(spark, d):
    """Every clip twice, with whole poses; angles at which a rotation's quaternion is on the edge of a case are left to the tests of that function."""
    rows = _rotations(spark, d).where("l_orderkey % 15 > 0")
    poses = rows.select(F.col("l_orderkey").alias("anim_id"), (F.col("l_linenumber") % 3).alias("bone_ix"), (F.col("l_linenumber") / 3).cast("int").alias("frame_ix"),
                        "px", "py", "pz", *(F.col(f"m{r}{c}") for r in range(3) for c in range(3)))
    both = poses.unionByName(poses.withColumn("anim_id", F.col("anim_id") + 100_000_000))
    return exact_duplicates(both, ["anim_id"], "anim_id")["by_key"]


@query("near_duplicate_flow")
def near_duplicate_flow(spark, d):
    return near_duplicates(event_series(spark, d), "user_id", ["value", "k"], 60, encode.Layers.formula((120, 32, 16)), 0.95)


@query("curve_tracks", """WITH f AS (SELECT l_orderkey AS clip, l_shipmode AS name, l_quantity AS position, CASE WHEN l_tax > 0.02 THEN l_tax END AS rotation, l_linenumber AS ix, l_extendedprice AS tie FROM
(SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_linestatus = 'O'), w AS (SELECT *, row_number() OVER (PARTITION BY clip, name ORDER BY ix DESC, tie DESC) AS n FROM f WHERE rotation IS NOT NULL)
SELECT clip, name, position, rotation FROM w WHERE n = 1""")
def curve_tracks(spark, d):
    items = table(spark, d, "lineitem").withColumn("class", F.when(F.col("l_linestatus") == "O", tracks.CURVE_CLASS).otherwise("Other"))
    folders = tracks.curve_clips(items).select(F.col("l_orderkey").alias("clip"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("position"),
                                               F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("rotation"), F.struct("l_linenumber", "l_extendedprice").alias("ix"))
    return tracks.tracks_of(folders, ["clip"])
