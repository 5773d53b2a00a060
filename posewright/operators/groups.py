"""Group labels of similar rows, and the group files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clip_sort_key
from ..staging import stage
from .components import connected_components
from .similarity import classes, similar_pairs


def symmetric(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Each edge in both directions."""
    return edges.select(i, j).union(edges.select(F.col(j).alias(i), F.col(i).alias(j)))


def number_components(rows: DataFrame, component: str = "component") -> DataFrame:
    """Add ``group_id``: components numbered from zero in the order of their smallest row.

    A component is named by its smallest row, so its number is the count of smaller names. The names are
    ranked by range partition: ranks inside the parts plus the sizes of the parts before.
    """
    names = rows.select(F.col(component).alias("name")).distinct()
    ranged = stage(names.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "component-names")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    ranks = ranged.select("name", (F.row_number().over(W.partitionBy("part").orderBy("name")) - 1 + offset).cast("long").alias("group_id"))
    return rows.join(ranks, rows[component] == ranks["name"]).drop("name")


def similarity_groups(vectors: DataFrame, threshold: float, row: str, vector: str) -> DataFrame:
    """``row, component, group_id`` of every row: connected components of the thresholded cosine graph.

    Rows without a link are groups of one. Equal vectors are linked if the vector is similar to itself,
    which a zero vector is not at a positive threshold.
    """
    units, members = classes(vectors, row, vector)
    units = stage(units, "unit-vectors")
    parts = connected_components(similar_pairs(units, threshold, forest=True))
    self_linked = units.select(F.col("rep").alias("r"), (F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x) >= min(threshold, 0.5)).alias("whole"))
    named = members.join(self_linked, members["rep"] == self_linked["r"]).join(parts, F.col("rep") == F.col("node"), "left")
    rows = named.select("row", F.when(F.col("whole"), F.coalesce("component", "rep")).otherwise(F.col("row")).alias("component"))
    return number_components(stage(rows, "similarity-groups")).withColumnRenamed("row", row)


def group_lines(groups: DataFrame, ids: str = "anim_id", order: str = "row_ix") -> DataFrame:
    """``group_id, line``: every group, ids in input order with blanks between."""
    g = groups.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(order, ids))).alias("g"))
    return g.select("group_id", F.array_join(F.transform("g", lambda x: x[ids].cast("string")), " ").alias("line"))


def shared_group_lines(groups: DataFrame, ids: str = "anim_id", clip: str = "clip_id") -> DataFrame:
    """``group_id, n, line``: groups of more than one, by animation and clip number, with a comma after each id."""
    name = F.concat_ws("-", ids, clip)
    g = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(clip_sort_key(name))).alias("g")).where("n > 1")
    first = F.transform("g", lambda x: F.split(x["name"], "-", 2)[0])
    return g.select("group_id", "n", F.concat(F.array_join(first, ","), F.lit(",")).alias("line"))


def catalog_lines(groups: DataFrame, url: str, order: str = "row_ix") -> DataFrame:
    """``group_id, line``: for each group of more than one a header with its running number and size, then its urls."""
    g = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, url))).alias("g")).where("n > 1")
    g = stage(g, "catalog-groups")
    ranks = number_components(g.select(F.col("group_id").alias("component"))).select("component", (F.col("group_id") + 1).alias("seq"))
    head = F.format_string("# group %d (%d clips)", F.col("seq"), F.col("n"))
    return g.join(ranks, g["group_id"] == ranks["component"]).select(
        g["group_id"], F.concat_ws("\n", head, F.array_join(F.transform("g", lambda x: x[url]), "\n")).alias("line"))
