"""Number parsing and the number text used inside messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num_text(x: Column) -> Column:
    """Text of a number for messages.

    Integral values print without a fraction (``5``), others rounded to four
    decimals with trailing zeros dropped (``2.5``, ``0.1235``); NaN and infinities
    print as ``nan``, ``inf``, ``-inf``. Fixed decimals keep the text identical
    across engines, unlike shortest-repr float printing (``1.0E16`` vs ``1e+16``).
    """
    d = x.cast("double")
    integral = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    fixed = F.round(d, 4).try_cast("decimal(38,4)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return (
        F.when(d.isNull(), F.lit("null"))
        .when(F.isnan(d), F.lit("nan"))
        .when(d == F.lit(float("inf")), F.lit("inf"))
        .when(d == F.lit(float("-inf")), F.lit("-inf"))
        .when(integral, d.try_cast("bigint").cast("string"))
        .otherwise(trimmed)
    )


def parse_double(raw: Column) -> Column:
    """Text to double the way Python ``float()`` reads it; NULL when not a number."""
    return F.trim(raw).try_cast("double")


def parse_int(raw: Column) -> Column:
    """Text to integer the way Python ``int()`` reads it ('2.7' and '1e3' are not
    integers); NULL when not an integer."""
    return F.trim(raw).try_cast("bigint").cast("double")


def truncate_int(x: Column) -> Column:
    """Python ``int(float)``: toward zero; NaN and infinities have no integer (NULL)."""
    d = x.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, d.try_cast("bigint").cast("double"))
