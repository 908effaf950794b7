"""The newest (or first) row of each key, without sorting rows.

A text cannot sit in the buffer of a hash aggregate, so "newest text per key" in one step sorts
every task's rows. Here a hash aggregate finds the winning order of each key from narrow columns
(the order packed into one number), this small table is written once, and a join on key and order
reads the wide columns of the winners only: the filter is applied where the rows are read
while the table is below ``spark.sql.autoBroadcastJoinThreshold`` (its size is that of its files),
else both sides are dealt by the key. An order of several columns is settled in rounds, each among the rows
still tied; rows tied to the end are told apart by their values, so a key has one row. Only columns that
are no whole number, time or date, and those behind them, are compared as a struct, which sorts what is tied by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.base import as_col, earliest, latest, pack
from vigil.session import scratch_path


def newest_rows(df: DataFrame, key: str | Column, order: list[Column], columns: list[str | Column], first: bool = False) -> DataFrame:
    """``(<key>, *columns)`` of each key's row with the greatest ``order`` (the least if ``first``)."""
    name = key if isinstance(key, str) else "pipeline"
    values = [as_col(c) for c in columns]
    rows = df.select(as_col(key).alias(name), *values, *[o.alias(f"_order{i}") for i, o in enumerate(order)])
    held = [c for c in rows.columns[1:] if not c.startswith("_order")]
    rows, left = rows.where(F.col(name).isNotNull()), [f"_order{i}" for i in range(len(order))]
    while left:
        size = next((n for n in (2, 1) if n <= len(left) and pack(rows, [F.col(c) for c in left[:n]]) is not None), 0)
        if not size:
            break
        numbered = rows.withColumn("_packed", pack(rows, [F.col(c) for c in left[:size]]))
        tops = numbered.groupBy(name).agg((F.min if first else F.max)("_packed").alias("_packed"))
        path = scratch_path(df.sparkSession, "winners")
        tops.write.parquet(path)
        rows = numbered.join(df.sparkSession.read.schema(tops.schema).parquet(path), [name, "_packed"]).drop("_packed")
        left = left[size:]
    pick = (earliest if first else latest)([*[F.col(c) for c in left], *[F.col(c) for c in held]], *[F.col(c) for c in held])
    return rows.groupBy(name).agg(pick.alias("_w")).select(name, "_w.*")
