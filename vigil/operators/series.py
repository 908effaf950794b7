"""Metric-series family: M9-M15.

"Latest" (M9, M12) is ``max_by`` of a number over a fixed-width order, a hash aggregate:
each task keeps one candidate per key, so a key holding a third of all points is reduced
before the shuffle. "First" and "last" over any order and text (M13-M15) find the winning
order first and then read the winners' columns (``winners``). A NULL value of the newest row is kept
(and reads as unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.jsonpath import json_has, json_value
from vigil.operators.base import as_col, earliest, micros_between, newest_number, to_measures
from vigil.operators.winners import newest_rows

# Statistics a period can be summarised by.
STATS = ("Sum", "Average", "Minimum", "Maximum", "SampleCount")


def latest_point(points: DataFrame, key: str | Column, ts: str | Column = "ts", value: str | Column = "value",
                 tiebreak: str | Column | None = None, check: str = "latest_point") -> DataFrame:
    """M9: the newest point's value per series; a NULL value stays NULL."""
    agg = newest_number(points, key, ts, as_col(value).try_cast("double"), tiebreak)
    return to_measures(agg, check, value=F.col("v"), observed_at=F.col("t"))


def trailing_range(points: DataFrame, as_of: Column, minutes: float, ts: str | Column = "ts") -> DataFrame:
    """Only points in [as_of - minutes, as_of]; a range predicate the Parquet
    scan can use for row-group skipping."""
    t = as_col(ts)
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(minutes) * 60.0))
    return points.where((t >= start) & (t <= as_of))


def windowed_stat(points: DataFrame, key: str | Column, as_of: Column, period_seconds: int = 300,
                  stat: str = "Sum", periods: int = 2, ts: str | Column = "ts", value: str | Column = "value",
                  decimals: int | None = None, check: str = "windowed_stat") -> DataFrame:
    """The statistic of the newest non-empty period among the last ``periods``
    periods ending at ``as_of``; a period with no points has no statistic, and a
    series with none at all reads 0.0.

    One aggregate per key computes every period's statistic side by side
    (``periods`` is a small constant), so there is a single shuffle and no
    second aggregation over (key, window). ``decimals`` sums exact decimals
    (order-independent) instead of doubles."""
    if stat not in STATS:
        raise ValueError(f"stat must be one of {STATS}")
    t, v = as_col(ts), as_col(value).try_cast("double")
    age_us = micros_between(t, as_of)
    # periods are [start, start + period): a point exactly one period old opens the newest one
    bucket = (F.ceil(age_us / F.lit(period_seconds * 1_000_000)) - 1).cast("int")
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(period_seconds * periods)))
    recent = points.where((t >= start) & (t < as_of)).select(as_col(key).alias("pipeline"), bucket.alias("b"), v.alias("v"))
    vv = F.col("v") if decimals is None else F.col("v").cast(f"decimal(38,{decimals})")

    def stat_of(i: int) -> Column:
        inb = F.col("b") == F.lit(i)
        if stat == "Sum":
            return F.sum(F.when(inb, vv))
        if stat == "Average":
            return F.avg(F.when(inb, vv))
        if stat == "Minimum":
            return F.min(F.when(inb, vv))
        if stat == "Maximum":
            return F.max(F.when(inb, vv))
        return F.when(F.count_if(inb) > 0, F.count_if(inb))

    agg = recent.groupBy("pipeline").agg(*[stat_of(i).cast("double").alias(f"s{i}") for i in range(periods)],
                                         F.min("b").alias("newest"))
    # the newest period with points decides, also when it has no statistic (0.0)
    newest = F.coalesce(F.try_element_at(F.array(*[F.col(f"s{i}") for i in range(periods)]), F.col("newest") + 1), F.lit(0.0))
    return to_measures(agg, check, value=newest)


def instant_vector(points: DataFrame, key: str | Column, series: str | Column, ts: str | Column = "ts",
                   value: str | Column = "value", tiebreak: str | Column | None = None,
                   check: str = "instant_vector") -> DataFrame:
    """Of the series whose label equals the pipeline (``key``), the first in label
    order, and its newest sample: the newest per series (a hash aggregate over the
    points), then the first of a pipeline's series."""
    per_series = newest_number(points, F.struct(as_col(key).alias("key"), as_col(series).alias("series")), ts,
                               as_col(value).try_cast("double"), tiebreak)
    agg = per_series.groupBy(F.col("pipeline.key").alias("pipeline")).agg(
        earliest([F.col("pipeline.series")], F.col("v"), F.col("t")).alias("p"))
    return to_measures(agg, check, value=F.col("p.v"), observed_at=F.col("p.t"))


def first_value(frame: DataFrame, key: str | Column, value: str | Column, order: list[Column],
                check: str = "first_value") -> DataFrame:
    """First field of the first row of a result, per key, by an explicit order."""
    firsts = newest_rows(frame, as_col(key), order, [as_col(value).try_cast("double").alias("v")], first=True)
    return to_measures(firsts, check, value=F.col("v"))


def first_line_with_field(lines: DataFrame, key: str | Column, line: str | Column, field: str,
                          order: list[Column], check: str = "first_line_field") -> DataFrame:
    """The first line (by ``order``) that parses and has ``field``; its value
    is taken as is, so a non-numeric value there is unknown and no later line is
    tried. Lines that do not parse are skipped."""
    ln = as_col(line)
    has = json_has(ln, field)
    text = F.when(F.to_json(json_value(ln, field)).startswith('"'), F.variant_get(json_value(ln, field), "$", "string")) \
        .otherwise(F.to_json(json_value(ln, field)))
    return to_measures(newest_rows(lines.where(has), as_col(key), order, [text.alias("raw")], first=True), check, raw=F.col("raw"))


def last_row_value(rows: DataFrame, key: str | Column, value: str | Column, order: list[Column],
                   check: str = "last_row_value") -> DataFrame:
    """The last data row's last column. A distributed read has no row order,
    so the caller names one (e.g. table, then row number)."""
    v = as_col(value)
    lasts = newest_rows(rows, as_col(key), order, [v.cast("string").alias("raw"), v.try_cast("double").alias("v")])
    return to_measures(lasts, check, value=F.col("v"), raw=F.col("raw"))
