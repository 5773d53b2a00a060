"""Taking chosen rows out of a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Keys of rows to take out (an id and a digest, about 100 bytes) are broadcast up to this many, else joined by shuffle.
BROADCAST_KEYS = 500_000


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _match(docs: DataFrame, digest: Column, keys: DataFrame, how: str) -> DataFrame:
    name = fresh(docs, "key")
    keys = keys.select(F.col("doc_id").alias(fresh(docs, "judged_id")), F.col("key").alias(fresh(docs, "judged_key")))
    near = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    marked = docs.withColumn(name, digest)
    judged_id, judged_key = (near[c] for c in near.columns)
    return marked.join(near, marked["doc_id"].eqNullSafe(judged_id) & marked[name].eqNullSafe(judged_key), how).drop(name)


def take_out(docs: DataFrame, digest: Column, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``verdicts`` (``doc_id, key, kept``) does not keep, with all their columns.

    ``digest`` computes a row's ``key``; rows equal in id and key have one verdict, and of such rows that are
    kept one stays. Rows without a verdict stay.
    """
    judged = stage(verdicts.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    again = judged.where("kept AND n > 1")
    rest = _match(docs, digest, judged.where("NOT kept OR n > 1"), "left_anti")
    if again.isEmpty():
        return rest
    name = fresh(docs, "key")
    once = _match(docs.withColumn(name, digest), digest, again, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return rest.unionByName(once)
