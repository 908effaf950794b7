"""JSON documents: dotted paths, numbers and truthiness."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def json_path(dotted: str) -> str:
    """``stats.row_count`` -> ``$.stats.row_count`` (keys through objects only)."""
    keys = [k for k in dotted.split(".") if k != ""]
    if not keys:
        raise ValueError("empty JSON path")
    parts = []
    for key in keys:
        if _SAFE_KEY.match(key):
            parts.append("." + key)
        else:
            parts.append("['" + key.replace("'", "\\'") + "']")
    return "$" + "".join(parts)


def json_value(doc: Column, dotted: str) -> Column:
    """The VARIANT value at the path; SQL NULL when the path is missing or the
    document does not parse. A JSON ``null`` is a variant null, not SQL NULL."""
    return F.try_variant_get(F.try_parse_json(doc), json_path(dotted), "variant")


def json_has(doc: Column, dotted: str) -> Column:
    """The path exists (its value may be JSON null)."""
    return json_value(doc, dotted).isNotNull()


def json_number(doc: Column, dotted: str) -> Column:
    """Number at the path like Python ``float(v)``: numbers and numeric strings read,
    ``true``/``false`` are 1.0/0.0; missing, null, objects, arrays and other text are
    NULL (the check is then unknown)."""
    return variant_number(json_value(doc, dotted))


def variant_number(v: Column) -> Column:
    """``json_number`` of a VARIANT value."""
    text = F.to_json(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(text == F.lit("true"), F.lit(1.0))
        .when(text == F.lit("false"), F.lit(0.0))
        .otherwise(F.try_variant_get(v, "$", "double"))
    )


# JSON texts that are falsy under Python truthiness.
FALSY_JSON = ("null", "false", "0", '""', "[]", "{}")


def json_truthiness(doc: Column, dotted: str) -> Column:
    """'truthy' / 'falsy' under Python truthiness; NULL when the path is missing."""
    return truthiness_of(json_value(doc, dotted))


def truthiness_of(v: Column) -> Column:
    """``json_truthiness`` of a VARIANT value."""
    text = F.to_json(v)
    zero = F.try_variant_get(v, "$", "double") == F.lit(0.0)
    is_number = F.schema_of_variant(v).isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | F.schema_of_variant(v).startswith("DECIMAL")
    falsy = text.isin(*FALSY_JSON) | (is_number & zero)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(falsy, F.lit("falsy")).otherwise(F.lit("truthy"))
