"""Layout hints in the metadata of definitions: a map of step to place, among keys of others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key of the hints in the metadata, and the longest name of a step.
KEY, LONGEST = "dashboard.layoutHints", 128
HINTS = "map<string,struct<x:double,y:double>>"


def parse(metadata: Column) -> Column:
    """Step to (x, y) from JSON metadata: finite numbers only, names of 1 to LONGEST characters; else an empty map."""
    places = F.coalesce(F.from_json(F.get_json_object(metadata, f"$['{KEY}']"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    read = F.transform_values(places, lambda k, v: F.from_json(v, "x double, y double"))  # a text in place of a number is null
    return F.map_filter(read, lambda k, v: F.length(k).between(1, LONGEST) & _finite(v["x"]) & _finite(v["y"]))


def _finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def merged(old: Column, new: Column) -> Column:
    """Two maps, whose common keys have the value of the second."""
    return F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x))
