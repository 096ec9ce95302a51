"""Text into extents, filters, numbers and truth values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true, false and none.
TRUE, FALSE, NONE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0"), ("", "nan", "na")


def frame_to_extent(frame: Column) -> Column:
    """"xmin, ymin : xmax, ymax" as a struct of minx, maxx, miny, maxy; nulls where it can't be read."""
    n = F.split(frame, r"\s*[:,]\s*")
    at = lambda i: F.try_element_at(n, F.lit(i)).try_cast("double")
    return F.struct(at(1).alias("minx"), at(3).alias("maxx"), at(2).alias("miny"), at(4).alias("maxy"))


def extent_filter(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A lidar reader's filter: lower left corner, then upper right."""
    return F.concat_ws(" ", F.lit("-keep_xy"), *(c.cast("string") for c in (minx, miny, maxx, maxy)))


def bracketed_numbers(line: Column) -> Column:
    """The numbers between the first brackets of a line of a raster's description."""
    inside = F.regexp_extract(line, r"\((.*?)\)", 1)
    return F.transform(F.split(inside, ","), lambda x: F.trim(x).try_cast("double"))


def epsg_code(line: Column) -> Column:
    """The number of an EPSG entry, null without one."""
    return F.nullif(F.regexp_extract(line, r'EPSG["\s:,]*(\d+)', 1), F.lit("")).try_cast("int")


def _word(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def nice_bool(c: Column) -> Column:
    """Null for words that are neither."""
    return F.when(_word(c).isin(list(TRUE)), True).when(_word(c).isin(list(FALSE)), False)


def nice_int(c: Column) -> Column:
    return F.when(~_word(c).isin(list(NONE)), c.try_cast("int"))


def nice_float(c: Column) -> Column:
    return F.when(~_word(c).isin(list(NONE)), c.try_cast("double"))


def nice_str(c: Column) -> Column:
    return F.when(~_word(c).isin(list(NONE)), c)


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS, behind the days if there are any."""
    s = seconds.cast("bigint")
    days = F.floor(s / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(days > 0, F.format_string("%d days %s", days, clock)).otherwise(clock)
