"""Readers of the pipeline's files, with explicit schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BONES
from ..functions.text import clip_ids, safe_double

FIELDS = ("px", "py", "pz", "lx", "ly", "lz")
POSE_COLUMNS = [f"{b}_{f}" for b in BONES for f in FIELDS]


def parse_quoted(text: str, separator: str = ",", quote: str = '"') -> list[list[str]]:
    """Rows of a delimited text in which a quote anywhere switches quoting on or off.

    Inside quotes a doubled quote is one quote, and separators and line ends are text. Line ends of any kind
    count as one. A blank line is a row of one empty field; the last line ends with the text, and is a row
    if it holds anything.
    """
    rows: list[list[str]] = []
    row: list[str] = []
    held: list[str] = []
    inside, text, k = False, text.replace("\r\n", "\n").replace("\r", "\n"), 0
    while k < len(text):
        c = text[k]
        if c == quote:
            if inside and text[k + 1:k + 2] == quote:
                held.append(quote)
                k += 1
            else:
                inside = not inside
        elif inside or c not in (separator, "\n"):
            held.append(c)
        else:
            row.append("".join(held))
            held = []
            if c == "\n":
                rows.append(row)
                row = []
        k += 1
    if held or row:
        rows.append([*row, "".join(held)])
    return rows


def quoted_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row_ix, fields`` of every row in every text; a text is one file, which must fit one task."""
    def run(frames):
        for f in frames:
            out = [(k, i, r) for k, t in zip(f["key"], f["text"], strict=True) for i, r in enumerate(parse_quoted(t or ""))]
            yield pd.DataFrame(out, columns=["key", "row_ix", "fields"])

    got = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, row_ix int, fields array<string>")
    return got.withColumnRenamed("key", key)


def catalog_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids of catalog rows; a header, and any other row without a number, falls out."""
    return rows.select(F.col(column).try_cast("long").alias("id")).where("id IS NOT NULL")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a catalog file: the first column of a delimited file with quotes, by the rules of ``parse_quoted``."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return catalog_ids(quoted_rows(texts, "file", "value").select(F.get("fields", F.lit(0)).alias("first")), "first")


def list_clips(spark: SparkSession, folder: str, pattern: str = "*.rbxm") -> DataFrame:
    """``path, anim_id, clip_id`` of clip files directly in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    anim, clip = clip_ids(F.col("path"))
    return files.select("path", anim.alias("anim_id"), clip.alias("clip_id"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``anim_id, clip_id, duration, num_frames``; short rows are dropped, bad numbers are zero."""
    lines = spark.read.csv(path, header=True, schema="anim_id string, clip_id string, duration string, num_frames string")
    return manifest_rows(lines)


def manifest_rows(lines: DataFrame) -> DataFrame:
    full = lines.where(F.col("num_frames").isNotNull())
    return full.select("anim_id", "clip_id", safe_double(F.col("duration")).alias("duration"),
                       F.greatest(F.lit(0), safe_double(F.col("num_frames")).cast("int")).alias("num_frames"))


def clips_without_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, anim_id, clip_id, duration`` of pose files named ``<anim>-<clip>.csv``, in order of path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/\\]*)\.csv\z", 1)
    parts = F.split(name, "-")
    named = files.select("path", parts.alias("p")).where((F.size("p") == 2) & (name != "manifest"))
    return named.select("path", F.col("p")[0].alias("anim_id"), F.col("p")[1].alias("clip_id"), F.lit(0.0).alias("duration")).orderBy("path")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``path, frame, feat`` of pose files: 90 numbers a frame, bad ones zero; short rows dropped, long ones cut."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("f"))
    return pose_rows(lines)


def pose_rows(lines: DataFrame) -> DataFrame:
    """Frames of split lines ``path, f``; the header is the line whose first field is no number."""
    n = len(POSE_COLUMNS)
    body = lines.where((F.size("f") > n) & F.col("f")[0].try_cast("int").isNotNull())
    return body.select("path", F.col("f")[0].cast("int").alias("frame"), F.transform(F.slice("f", 2, n), safe_double).alias("feat"))


def positions(poses: DataFrame) -> DataFrame:
    """``path, frame, bone_ix, px, py, pz`` of pose frames."""
    each = poses.select("path", "frame", "feat", F.explode(F.sequence(F.lit(0), F.lit(len(BONES) - 1))).alias("bone_ix"))
    return each.select("path", "frame", "bone_ix", *(F.get("feat", F.col("bone_ix") * 6 + k).alias(c) for k, c in enumerate(FIELDS[:3])))


def rows_and_rejects(lines: DataFrame, components: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of an embeddings file, and ``line, reason`` of the lines that give none, so that a bad one does not end the job.

    Lines ``value`` of too few fields, and lines with a number that cannot be read or is not finite, are
    rejects; the header is neither.
    """
    split = lines.select(F.col("value").alias("line"), F.split("value", ",").alias("f")).where(F.col("f")[0] != "animId")
    rest = F.slice("f", 4, components) if components else F.expr("slice(f, 4, size(f))")
    number = lambda x: x.try_cast("double")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    least = components + 3 if components else 4
    read = split.select("line", F.size("f").alias("n"), F.col("f")[0].alias("anim_id"), F.get("f", F.lit(1)).alias("clip_id"), number(F.get("f", F.lit(2))).alias("duration"),
                        F.when(F.size("f") >= least, F.transform(rest, number)).alias("emb"))
    reason = F.when(F.col("n") < least, "too few fields").when(bad(F.col("duration")) | F.exists("emb", bad), "bad number")
    judged = read.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("anim_id", "clip_id", "duration", "emb"), judged.where("reason IS NOT NULL").select("line", "reason")


def read_embeddings(spark: SparkSession, path: str, clean: bool = False, components: int | None = None) -> DataFrame:
    """``anim_id, clip_id, duration, emb`` of an embeddings file.

    Rows of fewer than four fields (or than ``components`` and three) are dropped. ``clean`` turns bad
    numbers into zero; without it they raise.
    """
    return embedding_rows(spark.read.text(path).select(F.split("value", ",").alias("f")), clean, components)


def embedding_rows(lines: DataFrame, clean: bool = False, components: int | None = None) -> DataFrame:
    number = safe_double if clean else (lambda x: x.cast("double"))
    rest = F.slice("f", 4, components) if components else F.expr("slice(f, 4, size(f))")
    body = lines.where((F.size("f") >= (components + 3 if components else 4)) & (F.col("f")[0] != "animId"))
    return body.select(F.col("f")[0].alias("anim_id"), F.col("f")[1].alias("clip_id"), number(F.col("f")[2]).alias("duration"),
                       F.transform(rest, number).alias("emb"))


def read_packed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Packed clips in order of ``row_ix``; with ``limit``, the first of them."""
    clips = spark.read.parquet(path)
    return clips if limit is None else first_rows(clips, "row_ix", limit)


def first_rows(clips: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in order."""
    return clips.orderBy(order).limit(limit)
