"""Probe-log family: M29-M32. A probe log is (pipeline, ts, code, body); the live
HTTP / gRPC / GraphQL call that produced it is outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.jsonpath import json_number, json_truthiness, json_value
from vigil.operators.base import as_col, newest_number, to_measures
from vigil.operators.winners import newest_rows


def _newest(probes: DataFrame, key, ts, tiebreak, **cols: Column) -> DataFrame:
    """(pipeline, p): the named columns and the time ``_ts`` of each key's newest probe."""
    order = [as_col(ts)] + ([as_col(tiebreak)] if tiebreak is not None else [])
    found = newest_rows(probes, as_col(key), order, [*[c.alias(n) for n, c in cols.items()], as_col(ts).alias("_ts")])
    return found.select("pipeline", F.struct(*found.columns[1:]).alias("p"))


def json_number_measure(probes: DataFrame, key: str | Column, doc: str | Column, path: str, ts: str | Column = "ts",
                        tiebreak: str | Column | None = None, check: str = "json_number") -> DataFrame:
    """The number at a dotted path of the newest document per key; missing or
    not numeric is NULL with the JSON text kept for the message. The newest
    document is chosen on its raw text first, so only one document per key is
    ever parsed."""
    newest = _newest(probes, key, ts, tiebreak, d=as_col(doc))
    d = F.col("p.d")
    return to_measures(newest, check, value=json_number(d, path),
                       raw=F.when(json_number(d, path).isNull(), F.to_json(json_value(d, path))),
                       observed_at=F.col("p._ts"))


def json_truthy_measure(probes: DataFrame, key: str | Column, doc: str | Column, path: str, ts: str | Column = "ts",
                        tiebreak: str | Column | None = None, check: str = "json_truthy") -> DataFrame:
    """Python truthiness of the value at a path of the newest document
    (parsed once per key, after the newest document is chosen)."""
    newest = _newest(probes, key, ts, tiebreak, d=as_col(doc))
    return to_measures(newest, check, state=json_truthiness(F.col("p.d"), path), observed_at=F.col("p._ts"))


def state_code(probes: DataFrame, key: str | Column, code: str | Column = "code", ts: str | Column = "ts",
               tiebreak: str | Column | None = None, check: str = "state_code") -> DataFrame:
    """The newest health code per service (compare with ``eq``, 1 = serving)."""
    newest = newest_number(probes, key, ts, as_col(code).cast("double"), tiebreak)
    return to_measures(newest, check, value=F.col("v"), observed_at=F.col("t"))


def probe_status(probes: DataFrame, key: str | Column, code: str | Column = "code", body: str | Column = "body",
                 path: str | None = None, ts: str | Column = "ts", tiebreak: str | Column | None = None,
                 check: str = "probe_status") -> DataFrame:
    """The newest response code, and the body's truthiness at ``path`` (set
    ``params['json_path']`` on the spec to have the verdict test it). Only the
    newest body per key is parsed."""
    newest = _newest(probes, key, ts, tiebreak, c=as_col(code).cast("double"), b=as_col(body))
    truth = json_truthiness(F.col("p.b"), path) if path else F.lit(None).cast("string")
    return to_measures(newest, check, value=F.col("p.c"), state=truth, observed_at=F.col("p._ts"))
