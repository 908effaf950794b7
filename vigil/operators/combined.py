"""Several checks of one table from one scan and one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import as_col, latest
from vigil.schema import MEASURES

FIELDS = ("value", "raw", "state", "observed_at", "aux")


def measure_many(df: DataFrame, key: str | Column, checks: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """``checks`` maps a check name to aggregate columns for some of
    value / raw / state / observed_at / aux. All of them are computed in one
    ``groupBy(key).agg(...)`` (one scan, one shuffle of partial aggregates), then
    each key's row is turned into one measure row per check."""
    aggs = []
    for i, (check, fields) in enumerate(checks.items()):
        unknown = set(fields) - set(FIELDS)
        if unknown:
            raise ValueError(f"unknown measure fields {sorted(unknown)} for check {check}")
        parts = [(fields[f] if f in fields else F.lit(None)).cast(MEASURES[f].dataType).alias(f) for f in FIELDS]
        aggs.append(F.struct(*parts).alias(f"_m{i}"))
    wide = df.groupBy(as_col(key).cast("string").alias("pipeline")).agg(*aggs)
    per_check = F.array(*[
        F.struct(F.lit(check).alias("check"), *[F.col(f"_m{i}.{f}").alias(f) for f in FIELDS])
        for i, check in enumerate(checks)])
    long = wide.select("pipeline", F.inline(per_check))
    return long.select("pipeline", "check", *FIELDS, F.lit(True).alias("present"))


def newest_row(order: list[Column], **values: Column) -> Column:
    """Aggregate: the struct of ``values`` from the row with the greatest order."""
    return latest(order, *[v.alias(k) for k, v in values.items()])
