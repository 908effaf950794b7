"""Measure frames: one row per (pipeline, check) in the MEASURES schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schema import MEASURES, SOURCE_ERROR


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_measures(df: DataFrame, check: str, pipeline: str | Column = "pipeline", value=None, raw=None,
                state=None, observed_at=None, aux=None) -> DataFrame:
    """Project an aggregated frame onto MEASURES; ``present`` is true (a row exists)."""
    def typed(c, name):
        dtype = MEASURES[name].dataType
        return (F.lit(None) if c is None else as_col(c)).cast(dtype).alias(name)

    return df.select(
        as_col(pipeline).cast("string").alias("pipeline"),
        F.lit(check).alias("check"),
        typed(value, "value"), typed(raw, "raw"), typed(state, "state"),
        typed(observed_at, "observed_at"), typed(aux, "aux"),
        F.lit(True).alias("present"),
    )


def latest(order: list[Column], *values: Column) -> Column:
    """The values of the row with the greatest ``order`` (a struct, so the first
    field decides and later ones break ties). A partial aggregate: each partition
    sends one candidate per key through the shuffle, so a hot key is no problem."""
    return F.max_by(F.struct(*values), F.struct(*order))


def earliest(order: list[Column], *values: Column) -> Column:
    return F.min_by(F.struct(*values), F.struct(*order))


_EPOCH = "1970-01-01 00:00:00"  # as text: a datetime literal would be read in the driver's time zone


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` on UTC wall-clock timestamps
    (TIMESTAMP_NTZ); no session time zone is involved."""
    return F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def epoch_micros(ts: Column) -> Column:
    return micros_between(F.lit(_EPOCH).cast("timestamp_ntz"), ts)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end).cast("double") / F.lit(3.6e9)


def pack(df: DataFrame, order: list[Column]) -> Column | None:
    """One or two whole numbers, times or dates as one decimal: a fixed-width order, so that
    "newest" is a hash aggregate (a struct order would sort every task's rows first). A missing
    one orders below any other. None for other types, and for a long before another."""
    if len(order) > 2:
        return None
    kinds = [f.dataType for f in df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)]).schema]
    numbers = []
    for c, kind in zip(order, kinds):
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            numbers.append(F.coalesce(epoch_micros(c), F.lit(-(1 << 62))))
        elif isinstance(kind, T.IntegralType):
            numbers.append(F.coalesce(c.cast("long"), F.lit(-(1 << 63))))
        else:
            return None
    if len(numbers) == 1:
        return numbers[0].cast("decimal(38,0)")
    if isinstance(kinds[0], T.LongType):
        return None  # two longs are wider than any number
    return numbers[0].cast("decimal(19,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + numbers[1].cast("decimal(19,0)")


def packed(df: DataFrame, ts: str | Column, tiebreak: str | Column | None = None) -> Column | None:
    """``pack`` of a time and an integer tie-breaker; None for columns of other types."""
    if not isinstance(df.select(as_col(ts).alias("t")).schema[0].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return None
    return pack(df, [as_col(ts)] + ([] if tiebreak is None else [as_col(tiebreak)]))


def newest_number(df: DataFrame, key: str | Column, ts: str | Column, value: Column,
                  tiebreak: str | Column | None = None) -> DataFrame:
    """``(pipeline, v, t)``: number and time of each key's newest row; a NULL number stays NULL."""
    t, order = as_col(ts), packed(df, ts, tiebreak)
    grouped = df.groupBy(as_col(key).alias("pipeline"))
    if order is not None:
        return grouped.agg(F.max_by(value, order).alias("v"), F.max(t).alias("t"))
    by = [t] + ([as_col(tiebreak)] if tiebreak is not None else [])
    return grouped.agg(latest(by, value.alias("v"), t.alias("t")).alias("p")).select("pipeline", "p.v", "p.t")


def guarded(spark, build, check: str, specs: DataFrame | None = None) -> DataFrame:
    """V14 "source error => unknown" for one check: ``build()`` constructs the
    check's measures; if that fails while planning (missing table, path or
    column), the error is logged and each of the check's specs gets a row marked
    ``SOURCE_ERROR``, which the evaluation ranks above every profile: an
    unavailable source never reads as an empty one. Every other check still runs.
    Without ``specs`` the frame is empty, right only for profiles that read an
    empty result as unknown."""
    import logging
    try:
        return build()
    except Exception as exc:  # noqa: BLE001 - any planning error of this source
        logging.getLogger("vigil").warning("check %s: source unavailable: %s", check, str(exc).splitlines()[0])
        if specs is None:
            return spark.createDataFrame([], MEASURES)
        return to_measures(specs.where(F.col("check") == F.lit(check)).select("pipeline").distinct(), check,
                           state=F.lit(SOURCE_ERROR))
