"""Settings that differ by spec, from one scan.

Specs of one check may each name their own JSON path, period or filter. The distinct settings are a
relation: the data is reduced once for all of them (newest document per key; sums per key and
period; counts per filter value), and the specs are joined to the reduced rows. The number of
scans does not grow with the specs, and a document is parsed once for all paths read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.jsonpath import json_path, truthiness_of, variant_number
from vigil.operators.base import as_col, micros_between, newest_number, to_measures
from vigil.operators.winners import newest_rows
from vigil.schema import MISSING_SETTING


def _specs(specs: DataFrame, check: str, key_setting: str, **settings: str) -> DataFrame:
    """(pipeline, key, settings...) of the check's specs; the key is the setting, else the pipeline's name."""
    def param(name):
        value = F.element_at("params", F.lit(name))
        return F.when(value != "", value)
    return specs.where(F.col("check") == F.lit(check)).select(
        "pipeline", F.coalesce(param(key_setting), "pipeline").alias("key"), *[param(s).alias(n) for n, s in settings.items()])


def _path_of(dotted: Column) -> Column:
    """``a.b`` -> ``$['a']['b']``: keys through objects only; null for an empty path."""
    keys = F.filter(F.split(dotted, r"\."), lambda k: k != "")
    quoted = F.transform(keys, lambda k: F.concat(F.lit("['"), F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']")))
    return F.when(F.size(keys) > 0, F.concat(F.lit("$"), F.array_join(quoted, "")))


def json_by_spec(probes: DataFrame, specs: DataFrame, key: str | Column, doc: str | Column, ts: str | Column = "ts",
                 tiebreak: str | Column | None = None, check: str = "json_number", path_param: str = "json_path",
                 key_setting: str = "endpoint", truthy: bool = False) -> DataFrame:
    """M29 / M30 / M32 with a path per spec (``params[path_param]``). The newest document per key is chosen on its raw
    text, parsed once and read at every path its specs name. A spec without a path is unknown (missing setting)."""
    order = [as_col(ts)] + ([as_col(tiebreak)] if tiebreak is not None else [])
    newest = newest_rows(probes, as_col(key), order, [as_col(doc).alias("_doc"), as_col(ts).alias("_ts")])
    parsed = newest.select(F.col("pipeline").alias("key"), F.try_parse_json("_doc").alias("_v"), "_ts")
    wanted = _specs(specs, check, key_setting, dotted=path_param).withColumn("path", _path_of(F.col("dotted")))
    met = wanted.join(parsed, "key").withColumn("found", F.try_variant_get("_v", F.coalesce("path", F.lit("$")), "variant"))
    has = F.col("path").isNotNull()
    if truthy:
        value, raw, state = F.lit(None), F.lit(None), truthiness_of(F.col("found"))
    else:
        value, state = variant_number(F.col("found")), F.lit(None).cast("string")
        raw = F.when(value.isNull(), F.to_json("found"))
    return to_measures(met, check, value=F.when(has, value), raw=F.when(has, raw).otherwise(F.lit(path_param)),
                       state=F.when(has, state).otherwise(F.lit(MISSING_SETTING)), observed_at=F.col("_ts"))


def trailing_by_spec(points: DataFrame, specs: DataFrame, key: str | Column, as_of: Column, ts: str | Column = "ts",
                     value: str | Column = "value", tiebreak: str | Column | None = None, check: str = "latest_point",
                     minutes_param: str = "minutes", default_minutes: float = 60.0, key_setting: str = "series") -> DataFrame:
    """M9 / M10 with a trailing range per spec: the newest point at or before ``as_of`` is one per key
    whatever the range; a spec sees it if it lies in its own [as_of - minutes, as_of]."""
    past = points.where(as_col(ts) <= as_of)
    newest = newest_number(past, key, ts, as_col(value).try_cast("double"), tiebreak).withColumnRenamed("pipeline", "key")
    wanted = _specs(specs, check, key_setting, minutes=minutes_param)
    minutes = F.coalesce(F.col("minutes").try_cast("double"), F.lit(float(default_minutes)))
    met = wanted.join(newest, "key").where(micros_between(F.col("t"), as_of) <= minutes * 60_000_000)
    return to_measures(met, check, value=F.col("v"), observed_at=F.col("t"))


def windowed_by_spec(points: DataFrame, specs: DataFrame, key: str | Column, as_of: Column, ts: str | Column = "ts",
                     value: str | Column = "value", check: str = "windowed_stat", periods: int = 2, decimals: int = 4,
                     period_param: str = "period_seconds", stat_param: str = "stat", default_period: int = 300,
                     key_setting: str = "series") -> DataFrame:
    """M11 with period and statistic per spec. Each point goes to its period of every distinct length (a
    small array from the specs, collected: one number per length), all statistics of (key, length, period) come from
    one hash aggregate, and a spec takes the newest period with points of its length."""
    wanted = _specs(specs, check, key_setting, period=period_param, stat=stat_param).select(
        "pipeline", "key", F.coalesce(F.col("period").try_cast("int"), F.lit(default_period)).alias("period"),
        F.coalesce("stat", F.lit("Sum")).alias("stat"))
    lengths = sorted(r["period"] for r in wanted.select("period").distinct().collect() if r["period"] > 0) or [default_period]
    t, v = as_col(ts), as_col(value).try_cast("double")
    age = micros_between(t, as_of)
    recent = points.where((age > 0) & (age <= F.lit(lengths[-1] * periods * 1_000_000))).select(
        as_col(key).alias("key"), v.cast(f"decimal(38,{decimals})").alias("v"), v.alias("d"), age.alias("age"))
    placed = recent.select("key", "v", "d", F.explode(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.struct(
        n.alias("period"), (F.ceil(F.col("age") / (n.cast("long") * 1_000_000)) - 1).cast("int").alias("b")))).alias("p")).where(F.col("p.b") < periods)
    sums = placed.groupBy("key", "p.period", "p.b").agg(
        F.sum("v").cast("double").alias("Sum"), (F.sum("v").cast("double") / F.count("v")).alias("Average"), F.min("d").alias("Minimum"),
        F.max("d").alias("Maximum"), F.count(F.lit(1)).cast("double").alias("SampleCount"))
    stats = [F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in ("Sum", "Average", "Minimum", "Maximum", "SampleCount")]
    long = sums.select("key", "period", "b", F.inline(F.array(*stats)))
    newest = long.groupBy("key", "period", "stat").agg(F.min_by("v", "b").alias("v"))
    met = wanted.join(newest, ["key", "period", "stat"])
    return to_measures(met, check, value=F.coalesce("v", F.lit(0.0)))


def filtered_counts_by_spec(df: DataFrame, specs: DataFrame, key: str | Column, doc: str | Column, check: str = "doc_count",
                            field_param: str = "field", equals_param: str = "equals", key_setting: str = "collection") -> DataFrame:
    """M3 with a filter per spec: documents of the spec's collection whose field (``params[field_param]``, dotted) equals
    ``params[equals_param]``, given as JSON (``5``, ``"5"``, ``true``); a spec without a field counts all. Each document is
    parsed once, its values at the distinct fields meet the wanted (field, value) pairs by an equi-join."""
    wanted = _specs(specs, check, key_setting, field=field_param, equals=equals_param).select(
        "pipeline", "key", F.coalesce("field", F.lit("")).alias("field"),
        F.when(F.col("field").isNull(), F.lit("")).otherwise(_value_text(F.try_parse_json("equals"))).alias("equals"))
    fields = sorted(r["field"] for r in wanted.select("field").distinct().collect())
    reads = F.array(*[F.struct(F.lit(f).alias("field"), (F.lit("") if f == "" else _value_text(
        F.try_variant_get("_v", json_path(f), "variant"))).alias("equals")) for f in fields])
    parsed = df.select(as_col(key).cast("string").alias("key"), F.try_parse_json(as_col(doc)).alias("_v"))
    found = parsed.select("key", F.inline(reads)).where("equals is not null")
    pairs = wanted.select("key", "field", "equals").distinct()
    counts = found.join(pairs, ["key", "field", "equals"]).groupBy("key", "field", "equals").agg(F.count(F.lit(1)).alias("n"))
    met = wanted.join(counts, ["key", "field", "equals"], "left")
    return to_measures(met, check, value=F.coalesce("n", F.lit(0)))


def _value_text(v: Column) -> Column:
    """JSON text of a value, numbers in one form (5, 5.0 and 5e0 are one); null if there's no value."""
    text = F.to_json(v)
    number = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return F.when(number.isNotNull(), number.cast("string")).otherwise(text)
