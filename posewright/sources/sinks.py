"""Lines and files that the pipeline writes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import POSE_COLUMNS


def _texts(values: list, places: int) -> list[str]:
    """Decimals of the exact values, ties to the even digit, as C's printf gives them; Java's formatter rounds up digits of a rounded text."""
    form, names = f"%.{places}f", {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}
    return ["null" if v is None else form % v if math.isfinite(v) else names[str(v)] for v in values]


def fixed(x: Column, places: int) -> Column:
    """A number with a fixed count of decimals; a negative zero keeps its sign."""
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(_texts(column.to_pylist(), places), pa.string())

    return text(x.cast("double"))


def fixed_list(x: Column, places: int) -> Column:
    """An array's numbers as ``fixed`` gives them, with commas between; null for a null array."""
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else ",".join(_texts(v, places)) for v in column.to_pylist()], pa.string())

    return text(x.cast("array<double>"))


# Header lines of the files; embeddings have one more name for each component.
HASH_HEADER = "animId,clipId,duration,hashFnv1a,hashMurmur"
MANIFEST_HEADER = "animId,clipId,duration,numFrames"
EMBEDDING_HEADER = "animId,clipId,duration"
GROUP_HEADER = "animId,clipId,duration,groupId"


def embedding_header(components: int) -> str:
    return ",".join([EMBEDDING_HEADER, *(f"emb{k}" for k in range(1, components + 1))])


def hash_lines(rows: DataFrame) -> DataFrame:
    """``line`` of the fingerprint file: ids, duration, both hashes."""
    return rows.select(F.concat_ws(",", "anim_id", "clip_id", fixed(F.col("duration"), 6), F.col("hash_fnv").cast("string"),
                                   F.col("hash_murmur").cast("string")).alias("line"))


def manifest_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", "anim_id", "clip_id", fixed(F.col("duration"), 6), F.col("num_frames").cast("string")).alias("line"))


def pose_lines(frames: DataFrame, key: Sequence[str], feat: str = "feat") -> DataFrame:
    """``key, frame_ix, line``: the frame's number and its values with eight decimals."""
    return frames.select(*key, "frame_ix", F.concat_ws(",", F.col("frame_ix").cast("string"), fixed_list(F.col(feat), 8)).alias("line"))


def pose_header() -> str:
    return ",".join(["frame", *POSE_COLUMNS])


def embedding_lines(rows: DataFrame, order: str) -> DataFrame:
    return rows.select(order, F.concat_ws(",", "anim_id", "clip_id", fixed(F.col("duration"), 6), fixed_list(F.col("emb"), 8)).alias("line"))


def group_file_lines(rows: DataFrame, order: str) -> DataFrame:
    """``order, line`` of the groups file: every clip with its group's number."""
    return rows.select(order, F.concat_ws(",", "anim_id", "clip_id", fixed(F.col("duration"), 6), F.col("group_id").cast("string")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = (), header: str | None = None) -> None:
    """One line for each row, in order over the files if columns to order by are given; a header is the first line of the first file."""
    rows = lines.select(F.lit(1).alias("body"), *order, "line")
    if header is not None:
        rows = rows.unionByName(lines.sparkSession.createDataFrame([(0, header)], "body int, line string"), allowMissingColumns=True)
    rows = rows.orderBy("body", *order) if order or header is not None else rows
    rows.select("line").write.text(path)


def write_packed(clips: DataFrame, path: str) -> None:
    clips.write.parquet(path)
