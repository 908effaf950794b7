"""DuckDB SQL fragments for the oracle twins."""

from __future__ import annotations


def num(x: str) -> str:
    """Message text of a number: integral without fraction, else 4 decimals with
    trailing zeros dropped."""
    return (
        f"(CASE WHEN ({x}) IS NULL THEN 'null' WHEN isnan({x}) THEN 'nan' "
        f"WHEN ({x}) = CAST('inf' AS DOUBLE) THEN 'inf' WHEN ({x}) = CAST('-inf' AS DOUBLE) THEN '-inf' "
        f"WHEN ({x}) = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
        f"ELSE regexp_replace(regexp_replace(CAST(CAST(round({x}, 4) AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '\\.$', '') END)"
    )


def sql_str(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def sql_num(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST({float(x)!r} AS DOUBLE)"


def values(rows: list[tuple], names: list[str], alias: str = "s") -> str:
    """A VALUES list as a derived table ``(VALUES ...) AS alias(names)``."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return f"CAST({float(v)!r} AS DOUBLE)"
        return sql_str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"


def ge(v: str, t: str, label: str) -> tuple[str, str]:
    status = f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN isnan({v}) THEN 'critical' WHEN {v} >= {t} THEN 'ok' ELSE 'critical' END"
    msg = (f"CASE WHEN {v} IS NULL THEN '{label}: no data' WHEN NOT isnan({v}) AND {v} >= {t} "
           f"THEN '{label} ' || {num(v)} || ' meets threshold ' || {num(t)} "
           f"ELSE '{label} ' || {num(v)} || ' below threshold ' || {num(t)} END")
    return status, msg


def gt(v: str, t: str, label: str) -> tuple[str, str]:
    status = f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN isnan({v}) THEN 'critical' WHEN {v} > {t} THEN 'ok' ELSE 'critical' END"
    msg = (f"CASE WHEN {v} IS NULL THEN '{label}: no data' WHEN NOT isnan({v}) AND {v} > {t} "
           f"THEN '{label} ' || {num(v)} || ' above threshold ' || {num(t)} "
           f"ELSE '{label} ' || {num(v)} || ' not above threshold ' || {num(t)} END")
    return status, msg


def le(v: str, t: str, label: str) -> tuple[str, str]:
    status = f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN isnan({v}) THEN 'critical' WHEN {v} <= {t} THEN 'ok' ELSE 'critical' END"
    msg = (f"CASE WHEN {v} IS NULL THEN '{label}: no data' WHEN NOT isnan({v}) AND {v} <= {t} "
           f"THEN '{label} ' || {num(v)} || ' within threshold ' || {num(t)} "
           f"ELSE '{label} ' || {num(v)} || ' exceeds threshold ' || {num(t)} END")
    return status, msg


def select_out(pipeline: str, check: str, status: str, value: str, threshold: str, message: str) -> str:
    return (f"{pipeline} AS pipeline, '{check}' AS \"check\", {status} AS status, CAST({value} AS DOUBLE) AS value, "
            f"CAST({threshold} AS DOUBLE) AS threshold, {message} AS message")


def int_parse(x: str) -> str:
    """Python ``int(text)``: optional sign and digits around blanks; else NULL."""
    return f"(CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN CAST(CAST(trim({x}) AS BIGINT) AS DOUBLE) END)"
