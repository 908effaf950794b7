"""Freshness family: M25, M26."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.base import as_col, hours_between, to_measures


def parse_instant(c: Column) -> Column:
    """ISO-8601 text (``Z`` or an offset allowed) or a timestamp -> UTC TIMESTAMP_NTZ;
    empty or unparsable text, a zone by name included, is NULL. Plain arithmetic: no session time zone."""
    text = F.trim(c.cast("string"))
    zone = r"[Tt ][0-9:.]+\s*([+-])(\d\d)(?::?(\d\d))?$"
    part = lambda i: F.regexp_extract(text, zone, i)
    minutes = F.coalesce(part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0)), F.lit(0))
    east = F.when(part(1) == "-", -minutes).otherwise(minutes)
    local = F.regexp_replace(F.regexp_replace(text, r"\s*[Zz]$", ""), r"([Tt ][0-9:.]+)\s*[+-]\d\d(:?\d\d)?$", "$1")
    plain = local.rlike(r"^[0-9]+-[0-9]+-[0-9]+([Tt ][0-9:.]+)?$")  # a zone not understood is no time, rather than another one
    return F.when(plain, local.try_cast("timestamp_ntz")
                  - F.make_dt_interval(F.lit(0), F.lit(0), east, F.lit(0)))


def recent_objects(objects: DataFrame, key: str | Column, as_of: Column, mtime: str | Column = "modificationTime",
                   check: str = "recent_objects") -> DataFrame:
    """Object count and the age in hours of the newest object, in one
    aggregate; the verdict (V7) tests the count first, then the age."""
    agg = objects.groupBy(as_col(key).alias("pipeline")).agg(
        F.count(F.lit(1)).alias("n"), F.max(as_col(mtime)).alias("newest"))
    return to_measures(agg, check, value=F.col("n"), aux=hours_between(F.col("newest"), as_of),
                       observed_at=F.col("newest"))


def age_hours(df: DataFrame, key: str | Column, updated_at: str | Column, as_of: Column,
              check: str = "age_hours") -> DataFrame:
    """Hours from the newest update to ``as_of``. Text timestamps are parsed;
    a key whose updates are all empty has a NULL age (unknown)."""
    u = as_col(updated_at)
    is_text = isinstance(df.select(u).schema.fields[0].dataType, T.StringType)
    ts = parse_instant(u) if is_text else u.cast("timestamp_ntz")
    agg = df.groupBy(as_col(key).alias("pipeline")).agg(F.max(ts).alias("newest"))
    return to_measures(agg, check, value=hours_between(F.col("newest"), as_of), observed_at=F.col("newest"))
