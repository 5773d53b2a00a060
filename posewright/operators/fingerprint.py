"""Exact duplicates by fingerprints of canonical word streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import combined_key, fnv1a_words, murmur3_words, u32
from ..functions.vectors import quantize
from ..staging import stage

STEP = 0.01


def stream(frames: DataFrame, key: Sequence[str], values: Sequence[str], step: float = STEP, bone: str | None = None) -> DataFrame:
    """``key, words``: for each bone in order its frame count, then the quantized values of its frames.

    Values wrap to unsigned 32-bit words. A clip's frames are gathered in one array, which the sampling
    grid bounds. Without ``bone`` a clip is one track.
    """
    track = F.col(bone) if bone else F.lit(0)
    words = F.array(*(u32(quantize(F.col(v), step)) for v in values))
    tracks = frames.select(*key, track.alias("track"), "frame_ix", words.alias("w")).groupBy(*key, "track").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("frame_ix", "w"))).alias("f"))
    each = F.concat(F.array(u32(F.col("n"))), F.flatten(F.transform("f", lambda x: x["w"])))
    joined = tracks.select(*key, "track", each.alias("w")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("track", "w"))).alias("t"))
    return joined.select(*key, F.flatten(F.transform("t", lambda x: x["w"])).alias("words"))


def fingerprints(streams: DataFrame, words: str = "words") -> DataFrame:
    """Add ``hash_fnv``, ``hash_murmur`` and the 16-digit key of both."""
    hashed = streams.withColumn("hash_fnv", fnv1a_words(F.col(words))).withColumn("hash_murmur", murmur3_words(F.col(words)))
    return hashed.withColumn("hash_key", combined_key(F.col("hash_fnv"), F.col("hash_murmur"))).drop(words)


def duplicate_groups(rows: DataFrame, by: str, ids: Column) -> DataFrame:
    """``by, n, first_id, ids``: groups of more than one row, ids in numeric order (others count as 0).

    Hashes are computed once and written; groups are counted before ids are gathered, so that the many
    singletons are dropped early. A group's ids are one line of the duplicate file.
    """
    found = rows.select(F.col(by), ids.cast("string").alias("id"), F.coalesce(ids.cast("string").try_cast("long"), F.lit(0)).alias("number"))
    found = stage(found, "fingerprint-ids")
    counts = found.groupBy(by).agg(F.count("*").alias("n")).where("n > 1")
    groups = found.join(counts, by).groupBy(by, "n").agg(F.array_sort(F.collect_list(F.struct("number", "id"))).alias("g"))
    return groups.select(by, "n", F.col("g")[0]["number"].alias("first_id"), F.array_join(F.transform("g", lambda x: x["id"]), ",").alias("ids"))


def group_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hash, groups``: how many groups of more than one row each fingerprint makes."""
    out = None
    for k in keys:
        one = rows.groupBy(k).count().agg(F.count_if(F.col("count") > 1).alias("groups")).select(F.lit(k).alias("hash"), "groups")
        out = one if out is None else out.unionByName(one)
    return out


def to_clip(rows: DataFrame, status: Column) -> DataFrame:
    """``status, n``: counters of processed, skipped and failed rows."""
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
