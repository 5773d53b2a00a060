"""Join-like flows: resume, clips of a manifest, bones of a rig, parents of bones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import BONES, PARENTS
from ..staging import stage
from .analysis import draw


def bone_table(spark, bones: Sequence[str] = BONES) -> DataFrame:
    """``bone_ix, bone, parent``: a constant table of a rig's bones."""
    return spark.createDataFrame([(k, b, PARENTS.get(b)) for k, b in enumerate(bones)], "bone_ix int, bone string, parent string")


def still_to_do(wanted: DataFrame, assets: DataFrame, clips: DataFrame, asset: str, clip: str) -> DataFrame:
    """Rows to fetch, with ``step``: assets that are absent in full, and clips that are absent.

    A row whose asset exists is passed over whole, even if its clip is absent; of the others, those whose
    clip exists need the asset alone.
    """
    rest = wanted.join(assets.select(asset).distinct(), asset, "left_anti")
    have = clips.select(clip, F.lit(True).alias("have")).distinct()
    return rest.join(have, clip, "left").withColumn("step", F.when(F.col("have"), "asset").otherwise("asset and clip")).drop("have")


def clips_of_manifest(manifest: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows that have a clip, with the clip's columns."""
    return manifest.join(clips, list(keys), "inner")


def poses_of_bones(tracks: DataFrame, key: Sequence[str], bones: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """One row for each clip and bone of the rig; a bone without a track has the default values.

    A clip's rows are looked up by bone in one grouped pass: the rig is a constant array, so there is no
    product of clips and bones to join with. Of repeated tracks of a bone, the one with the greatest values stays.
    """
    names = F.array(*map(F.lit, bones))
    values = list(defaults)
    found = (tracks.where(F.col("bone").isin(*bones)).groupBy(*key, "bone").agg(F.max(F.struct(*values)).alias("v"))
             .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bone", "v"))).alias("m")))
    clips = tracks.select(*key).distinct().join(found, list(key), "left")
    each = clips.select(*key, "m", F.posexplode(names).alias("bone_ix", "bone"))
    return each.select(*key, "bone_ix", "bone", *(
        F.coalesce(F.try_element_at("m", F.col("bone"))[v], F.lit(defaults[v])).alias(v) for v in values))


def with_parent(poses: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``<value>_parent`` to each bone's row from its parent's, null for a bone without a parent row."""
    bones = bone_table(poses.sparkSession).select("bone", "parent")
    up = poses.select(*key, F.col("bone").alias("parent"), *(F.col(v).alias(f"{v}_parent") for v in values))
    return poses.join(F.broadcast(bones), "bone", "left").join(up, [*key, "parent"], "left")


def mirrored_union(clips: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Clips and their mirror images, told apart by ``is_mirror``."""
    return clips.withColumn("is_mirror", F.lit(0)).unionByName(mirrored.withColumn("is_mirror", F.lit(1)))


def stack_views(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("view", F.lit(0)).unionByName(second.withColumn("view", F.lit(1)))


def split_rows(rows: DataFrame, row: str, share: float, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: the first ``share`` of the rows (rounded down) in a seeded order of their whole-number ids.

    The order is that of ``analysis.draw``. Its ranks come from a range partition, so neither the driver
    nor a task sees all rows; rows of equal id are ordered arbitrarily.
    """
    order = stage(rows.withColumn("drawn", draw(F.col(row), seed)).repartitionByRange("drawn", row).withColumn("part", F.spark_partition_id()), "split-rows")
    sizes = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}
    held, before, offsets = int(sum(sizes.values()) * share), 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    first = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    rank = F.row_number().over(W.partitionBy("part").orderBy("drawn", row))
    ranked = order.withColumn("rank", rank).join(F.broadcast(first), "part")  # a row for each partition
    return ranked.withColumn("is_validation", F.col("rank") + F.col("before") <= held).select(*rows.columns, "is_validation")
