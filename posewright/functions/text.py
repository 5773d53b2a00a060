"""Parsing of ids, numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where an asset id stands in a URL, in the order in which the forms are tried.
ID_FORMS = (r"[?&]id=(\d+)", r"/(\d+)\z", r"/id/(\d+)", r"=(\d+)\z")


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clip_ids(path: Column) -> tuple[Column, Column]:
    """Animation and clip id of ``.../<anim>-<clip>.rbxm``, or nulls; digits that a prefix ends with count."""
    name = F.regexp_extract(path, r"(?s)([^/\\]*)\z", 1)
    form = r"(\d+)-(\d+)\.rbxm\z"
    return capture(name, form, 1), capture(name, form, 2)


def clip_ids_or_unknown(path: Column) -> tuple[Column, Column]:
    """As ``clip_ids`` on the whole path, with ``?`` for a path that has none."""
    form = r"(\d+)-(\d+)\.rbxm\z"
    return F.coalesce(capture(path, form, 1), F.lit("?")), F.coalesce(capture(path, form, 2), F.lit("?"))


def asset_id(url: Column) -> Column:
    """The number in a URL by the first form that matches, or null."""
    return F.coalesce(*(capture(url, form) for form in ID_FORMS)).try_cast("long")


def safe_double(value: Column) -> Column:
    """A number; zero for null, text, NaN and infinities."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clip_sort_key(name: Column) -> Column:
    """Sort key of ``<anim>-<clip>``: by the two numbers, and names that are none by themselves after these."""
    a, b = (F.get(F.split(name, "-", 2), F.lit(k)).try_cast("long") for k in (0, 1))
    bad = a.isNull() | b.isNull()
    return F.struct(bad.alias("odd"), F.when(~bad, a).alias("anim"), F.when(~bad, b).alias("clip"), name.alias("name"))
