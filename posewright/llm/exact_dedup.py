"""Exact deduplication by distributed MSD radix partitioning.

A level splits every unresolved group by the next digit, a run of successive bytes of the text. A group
that is left with one row is a singleton and drops out; a row whose bytes are used up has ended, and its
group (same bytes, same end) is a class of equal texts. Equality is decided on the bytes alone.

Digits start short, since most texts differ early, and grow fourfold to ``MAX_DIGIT``. A level
pre-aggregates its digit counts before the shuffle, so a hot group costs one row for each map task; the
counts of groups with two or more rows are written, then joined back: by broadcast while they are few,
else by a shuffle join, where a hot group's rows can be split over tasks. Only the unread rest of the texts in such groups moves to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage
from .rows import take_out

FIRST_DIGIT, GROWTH, MAX_DIGIT = 32, 4, 1 << 20
#: A level's counted groups are broadcast up to this size (digits and 64 bytes a row), else joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _level(active: DataFrame, width: int, n: int, held_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Split the groups of ``active`` by one digit; the counted groups and the rows that stay in them.

    A digit carries an end mark: a rest that is exactly used up differs from one that goes on.
    """
    size = F.octet_length("rest")
    dealt = active.select(
        "gid", "doc_id", "text_sha256",
        F.substring("rest", 1, width).alias("digit"),
        (size <= width).alias("ended"), F.greatest(size - width, F.lit(0)).alias("left"),
        F.when(size > width, F.expr(f"substring(rest, {width + 1})")).alias("rest"))
    groups = stage(
        dealt.groupBy("gid", "digit", "ended")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
        .where("n > 1")
        .withColumn("next", F.monotonically_increasing_id()), "radix-groups", rows=n)
    held = groups.agg(F.coalesce(F.sum(F.octet_length("digit") + 64), F.lit(0))).first()[0]
    near = F.broadcast(groups) if held <= BROADCAST_BYTES else groups
    rows = dealt.join(near, ["gid", "digit", "ended"]).select(
        F.col("next").alias("gid"), "doc_id", "text_sha256", "rest", "left", "ended", "n", "keep_id")
    return groups, stage(rows, "radix-rows", rows=n if width > FIRST_DIGIT else None, size=held_bytes)


def classes(docs: DataFrame) -> DataFrame | None:
    """``(doc_id, text_sha256, keep_id, group_size)`` of the rows whose text occurs more than once."""
    active = docs.select(F.lit(0).cast("long").alias("gid"), "doc_id",
                         F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                         F.col("text").cast("binary").alias("rest"))
    width, found, n, held = FIRST_DIGIT, [], docs.count(), 0
    while True:
        groups, rows = _level(active, width, n, held)
        going = rows.where(~F.col("ended"))
        found.append(rows.where("ended").select("doc_id", "text_sha256", "keep_id", F.col("n").alias("group_size")))
        discard(groups)
        n, held = going.agg(F.count("*"), F.coalesce(F.sum("left"), F.lit(0))).first()
        if not n:
            break
        active = going.select("gid", "doc_id", "text_sha256", "rest")
        width = min(width * GROWTH, MAX_DIGIT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; texts are compared byte by byte, with no normalisation. The row with the
    largest ``doc_id`` of a class stays; rows that repeat both id and text are all marked as kept, and
    count. Null ids never win over a number; a class of null ids keeps all its rows. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The digest only tells rows apart that share a doc_id; the class itself comes from the radix levels.
    repeated = classes(base).groupBy("doc_id", "text_sha256").agg(
        F.first("keep_id").alias("top"), F.first("group_size").alias("n"))
    rows = base.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    r = repeated.select(F.col("doc_id").alias("r_id"), F.col("text_sha256").alias("r_sha"), "top", "n")
    joined = rows.join(r, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha")), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text, one stays."""
    found = exact_dedup(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return take_out(docs, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), found)


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
