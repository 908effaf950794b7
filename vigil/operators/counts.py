"""Count family: M1-M8, M20, M23, M24.

Every count is a partial-mergeable aggregate: each task counts its rows per key
and only one row per key per task crosses the shuffle, so a key holding a third
of the data costs no more than any other. Filters are plain predicates, so
Catalyst pushes them into the Parquet scan and prunes to the columns used.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.globs import base_name, glob_regex
from vigil.functions.jsonpath import json_path
from vigil.operators.base import as_col, earliest, to_measures
from vigil.operators.patterns import counted, glob_matches, prefix_matches, term_matches
from vigil.operators.winners import newest_rows


def row_count(df: DataFrame, key: str | Column, where: str | Column | None = None, check: str = "row_count") -> DataFrame:
    """M1: COUNT(*) per key with an optional predicate."""
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    agg = df.groupBy(as_col(key).alias("pipeline")).agg(F.count(F.lit(1)).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def _first_column(frame: DataFrame) -> tuple[Column, bool]:
    field = frame.schema.fields[0]
    numeric = isinstance(field.dataType, (T.NumericType, T.BooleanType))
    return F.col(f"`{field.name}`"), numeric


def sql_scalar(spark: SparkSession, query: str, pipeline: str, check: str = "sql_scalar") -> DataFrame:
    """M2: first column of the first row of any query. Give the query an ORDER BY
    when it can return several rows; otherwise which row is first is undefined."""
    frame = spark.sql(query).limit(1)
    first, numeric = _first_column(frame)
    if numeric:
        return to_measures(frame, check, pipeline=F.lit(pipeline), value=first.cast("double"))
    return to_measures(frame, check, pipeline=F.lit(pipeline), raw=first.cast("string"))


def keyed_scalar(frame: DataFrame, key: str | Column, value: str | Column, order: list[Column] | None = None,
                 check: str = "sql_scalar") -> DataFrame:
    """M2 / M13 for many pipelines at once: a query result with a key column; per
    key the first row by ``order`` (default: the value itself) gives the metric."""
    v = as_col(value)
    numeric = not isinstance(frame.select(v).schema.fields[0].dataType, (T.StringType,))
    ordering = order if order else [v]
    agg = frame.groupBy(as_col(key).alias("pipeline")).agg(earliest(ordering, v.alias("v")).alias("first"))
    if numeric:
        return to_measures(agg, check, value=F.col("first.v").cast("double"))
    return to_measures(agg, check, raw=F.col("first.v").cast("string"))


def doc_count(df: DataFrame, key: str | Column, doc: str | Column, equals: Mapping[str, object] | None = None,
              check: str = "doc_count") -> DataFrame:
    """M3: documents whose JSON fields equal the given values; no filter = all. Types
    count: text "5" is not the number 5, and true is not 1."""
    d = as_col(doc)
    pred = F.lit(True)
    for field, wanted in (equals or {}).items():
        found = F.to_json(F.try_variant_get(F.try_parse_json(d), json_path(field), "variant"))
        is_text = found.startswith('"')
        if isinstance(wanted, bool) or wanted is None:
            same = found == F.lit(json.dumps(wanted))
        elif isinstance(wanted, (int, float)):
            same = ~is_text & (found.try_cast("double") == F.lit(float(wanted)))
        else:
            same = is_text & (F.get_json_object(d, json_path(field)) == F.lit(str(wanted)))
        pred = pred & F.coalesce(same, F.lit(False))
    return row_count(df, key, where=pred, check=check)


def index_count(df: DataFrame, index: str | Column, patterns: Mapping[str, str], where: Column | None = None,
                check: str = "index_count") -> DataFrame:
    """M4: documents in every index matching a name or glob pattern.

    Counts are taken once per distinct index (a partial aggregate over the data);
    the patterns are then matched against that short list of index names, and
    each pattern's total is summed. No row of the data is compared with every
    pattern, and no pair of rows is formed."""
    if where is not None:
        df = df.where(where)
    per_index = df.groupBy(as_col(index).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    hits = F.array(*[F.when(F.col("idx").rlike(glob_regex(p)), F.lit(name)) for name, p in patterns.items()])
    matched = per_index.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("pipeline"), "n")
    agg = matched.groupBy("pipeline").agg(F.sum("n").alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text (split on what is no word character in Unicode)."""
    return F.split(F.lower(text), r"(?U)\W+")


def text_match_count(df: DataFrame, queries: Mapping[str, str], fields: Mapping[str, str | Column] | None = None,
                     check: str = "text_match_count") -> DataFrame:
    """M5: hits of a term query (``field:value``, a bare value in the field ``text``, ``*:*`` for all)
    per pipeline, counted in one scan for any number of queries. Each field used is tokenized once
    per document and its distinct words meet the terms by an equi-join."""
    terms: dict[str, tuple[str, str] | None] = {}
    for p, q in queries.items():
        field, colon, value = q.partition(":")
        terms[p] = None if q.strip() == "*:*" else (field, value.lower()) if colon else ("text", q.lower())
    used = sorted({t[0] for t in terms.values() if t})
    words = df.select(*[words_of(as_col(fields[f]) if fields and f in fields else F.col(f)).alias(f) for f in used]) if used else df.select()
    return counted(term_matches(words, terms), terms, check)


def paged_count(pages: DataFrame, key: str | Column, count: str | Column, check: str = "paged_count") -> DataFrame:
    """M6: total over all pages of per-page counts; a missing page count is 0."""
    agg = pages.groupBy(as_col(key).alias("pipeline")).agg(F.sum(F.coalesce(as_col(count), F.lit(0))).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def view_count(df: DataFrame, key: str | Column, emitted: Column | None = None, check: str = "view_count") -> DataFrame:
    """M7: rows a view emits (one per element of ``emitted``) when a view is given,
    else documents. The elements are counted with ``size``, not exploded, so no
    row per element is ever materialized."""
    n = F.count(F.lit(1)) if emitted is None else F.sum(F.coalesce(F.size(emitted), F.lit(0)).cast("long"))
    agg = df.groupBy(as_col(key).alias("pipeline")).agg(n.alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def kv_value(kv: DataFrame, specs: DataFrame, key: str = "key", value: str = "value", param: str = "key",
             check: str = "kv_value", order: str | Column | None = None) -> DataFrame:
    """M8: the text stored under the key each spec names in ``params[param]``. A key
    stored more than once has the value that is last by ``order`` (without one,
    the greatest text), so a spec has one result.

    An equi-join of the spec keys with the store; AQE broadcasts the smaller side
    when its measured size allows, else a sort-merge join on the key."""
    wanted = specs.where(F.col("check") == F.lit(check)).select(
        "pipeline", F.element_at("params", F.lit(param)).alias("k"))
    pairs = kv.select(as_col(key).cast("string").alias("k"), as_col(value).cast("string").alias("v"),
                      *([] if order is None else [as_col(order).alias("o")]))
    asked = pairs.join(wanted.select("k").distinct(), "k", "left_semi")  # before any sort
    if order is not None:
        asked = newest_rows(asked, "k", [F.col("o")], ["v"])
    store = asked.groupBy("k").agg(F.max("v").alias("v"))
    joined = wanted.join(store, on="k", how="inner")
    return to_measures(joined, check, raw=F.col("v"))


def queue_depth(df: DataFrame, key: str | Column, distinct: str | Column | None = None, approx: bool = False,
                check: str = "queue_depth") -> DataFrame:
    """Messages per queue; over huge logs ``approx`` counts distinct ids with
    HyperLogLog (bounded memory per key) instead of exactly."""
    if distinct is None:
        n = F.count(F.lit(1))
    elif approx:
        n = F.approx_count_distinct(as_col(distinct))
    else:
        n = F.count_distinct(as_col(distinct))
    agg = df.groupBy(as_col(key).alias("pipeline")).agg(n.alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def queue_sketches(df: DataFrame, key: str | Column, distinct: str | Column, part: str | Column, lg_k: int = 12) -> DataFrame:
    """M20 over huge logs: ``(pipeline, part, sketch)``, one mergeable HyperLogLog sketch of the distinct ids per queue and
    part (a day). Stored once per closed part, so that a check reads the newest part's rows only."""
    return df.groupBy(as_col(key).cast("string").alias("pipeline"), as_col(part).alias("part")).agg(
        F.hll_sketch_agg(as_col(distinct).cast("string"), F.lit(lg_k)).alias("sketch"))


def sketched_depth(sketches: DataFrame, check: str = "queue_depth") -> DataFrame:
    """M20 from stored sketches: distinct ids per queue over all parts given (an id in two parts counts once). With ``lg_k``
    12 the standard error is about 1.3 % (1.04 / sqrt(2^lg_k), less for few ids)."""
    agg = sketches.groupBy("pipeline").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    return to_measures(agg, check, value=F.col("n"))


def object_count(objects: DataFrame, prefixes: Mapping[str, str], path: str | Column = "path",
                 check: str = "object_count") -> DataFrame:
    """Entries whose key starts with the prefix, per pipeline, one scan."""
    return counted(prefix_matches(objects, as_col(path), prefixes), prefixes, check)


def file_count(objects: DataFrame, globs: Mapping[str, str], path: str | Column = "path", bare_names: bool = False,
               check: str = "file_count") -> DataFrame:
    """Entries matching an fnmatch glob. ``bare_names`` matches the last path
    segment (a listing of names); otherwise the full entry. An empty glob matches
    everything."""
    target = base_name(as_col(path)) if bare_names else as_col(path)
    globs = {name: g or "" for name, g in globs.items()}
    return counted(glob_matches(objects, target, globs), globs, check)
