"""Pattern index, two-phase newest rows, and settings per spec: edge rules on literal rows."""

import fnmatch
import re

import pytest
from helpers import AS_OF, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from vigil import operators as M
from vigil.functions.globs import glob_literals
from vigil.operators.patterns import rarest_pieces
from vigil.operators.settings import filtered_counts_by_spec, json_by_spec, trailing_by_spec, windowed_by_spec
from vigil.operators.winners import newest_rows
from vigil.plans.evaluate import as_of_lit
from vigil.plans.specs import specs_frame
from vigil.schema import MISSING_SETTING

SF = "/root/testdata/sf0.001"


# ---- pattern index
def test_terms_in_several_fields(spark):
    df = spark.createDataFrame([("The cat, the dog", "en"), ("", "the"), (None, None), ("dog_x dog", "EN")], "text string, lang string")
    got = rows(M.text_match_count(df, {"a": "text:THE", "b": "the", "c": "lang:the", "d": "lang:en", "e": "*:*", "f": "text:cow", "g": "text:dog"}), "value")
    assert got == {"a": (1.0,), "b": (1.0,), "c": (1.0,), "d": (2.0,), "e": (4.0,), "f": (0.0,), "g": (2.0,)}
    assert rows(M.text_match_count(df, {"all": "*:*"}), "value") == {"all": (4.0,)}


def test_prefixes(spark):
    df = spark.createDataFrame([("data/a",), ("data/b",), ("data",), ("",), (None,), ("日本/x",)], "path string")
    got = rows(M.object_count(df, {"all": "", "d": "data/", "d2": "data/", "j": "日本", "none": "x", "long": "data/abc"}), "value")
    assert got == {"all": (5.0,), "d": (2.0,), "d2": (2.0,), "j": (1.0,), "none": (0.0,), "long": (0.0,)}


PATHS = ["", "a", "report.csv", "/exports/report.csv", "/exports/report.json", "a\nb.csv", "[x]", "x]y", "日本.csv", "aaaa", "a*b", "REPORT.CSV"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab.*?[]!-/csv日", max_size=8), min_size=1, max_size=12, unique=True))
def test_every_match_has_the_glob_piece(globs):
    pieces = rarest_pieces({g: g for g in globs})
    for g in globs:
        for text in [*PATHS, "ab.csv", "acsv", "a/b"]:
            if fnmatch.fnmatchcase(text, g):
                assert pieces[g] in text and all(x in text for x in glob_literals(g)), (g, text)


def test_globs_are_fnmatch(spark):
    globs = ["*.csv", "*", "", "?", "/exports/*", "[[]x]", "*]y", "a[!b]*", "*日本*", "aa*aa", "aaa*aa", "[a-c]", "a[*]b", "*report*", "[", "a[", "r*.csv", "??????????"]
    df = spark.createDataFrame([(p,) for p in PATHS] + [(None,), ("report.csv",)], "path string")
    got = rows(M.file_count(df, {f"g{i}": g for i, g in enumerate(globs)}), "value")
    held = [*PATHS, "report.csv"]
    assert got == {f"g{i}": (float(sum(g == "" or fnmatch.fnmatchcase(p, g) for p in held)),) for i, g in enumerate(globs)}


# ---- newest rows
def test_newest_rows_by_rounds(spark):
    data = [("a", 1, 5, "x", "old"), ("a", 2, 1, "x", "b"), ("a", 2, 3, "x", "c"), ("a", 2, 3, "y", "d"), ("a", 2, 3, "y", "e"),
            ("n", None, 1, "x", "only"), ("m", None, 9, "z", "never"), ("m", -5, 0, "z", "least"), (None, 9, 9, "z", "no key")]
    df = spark.createDataFrame(data, "k string, t long, i int, s string, v string")
    order = [F.col("t"), F.col("i"), F.col("s")]
    assert {r["k"]: r["v"] for r in newest_rows(df, "k", order, ["v"]).collect()} == {"a": "e", "n": "only", "m": "least"}
    assert {r["k"]: r["v"] for r in newest_rows(df, "k", order, ["v"], first=True).collect()} == {"a": "old", "n": "only", "m": "never"}
    big = spark.createDataFrame([("a", 2**62 + 1, "low"), ("a", 2**63 - 1, "high"), ("a", -(2**63), "least")], "k string, t long, v string")
    assert newest_rows(big, "k", [F.col("t")], ["v"]).first()["v"] == "high"
    assert newest_rows(df.limit(0), "k", order, ["v"]).collect() == []


@pytest.mark.parametrize("name", ["m08_kv_value", "m13_first_value", "m14_first_line_field", "m15_last_row_value", "m29_json_number",
                                  "m30_json_truthy", "m32_probe_status", "m29_paths_by_spec"])
def test_no_sort_of_raw_rows(spark, name):
    """Whatever a sorting aggregate reads has met the winners' table first."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [(re.search(r"[A-Z]", x).start(), x) for x in plan.splitlines() if re.search(r"[A-Z]", x)]
    for i, (depth, line) in enumerate(lines):
        if "SortAggregate" in line:
            below = []
            for d, x in lines[i + 1:]:
                if d <= depth:
                    break
                below.append(x)
            until = next((j for j, x in enumerate(below) if "Scan" in x), len(below))
            assert any("Join" in x or "HashAggregate" in x for x in below[:until]), f"{name}: {line}"


@pytest.mark.parametrize("name", ["m03_filters_by_spec", "m05_many_terms", "m10_minutes_by_spec", "m11_periods_by_spec", "m23_many_prefixes", "m24_many_globs"])
def test_one_scan_for_all_specs(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet|Scan parquet", plan)) == 1 and "SortAggregate" not in plan


# ---- settings per spec
def spec(pipeline, check, **params):
    return {"pipeline": pipeline, "check": check, "params": params}


def test_paths_by_spec(spark):
    probes = spark.createDataFrame([("svc", "2024-06-01 10:00:00", '{"a": {"b": 5, "x.y": 1}, "t": "7", "z": null, "l": []}'), ("svc", "2024-06-01 09:00:00", '{"a": {"b": 1}}'),
                                    ("bad", "2024-06-01 09:00:00", "{not json")], "k string, ts string, doc string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    wanted = {"p1": "a.b", "p2": "t", "p3": "z", "p4": "a", "p5": "no.such", "p6": "l"}
    for truthy in (False, True):
        check = "json_truthy" if truthy else "json_number"
        specs = specs_frame(spark, [spec(p, check, endpoint="svc", json_path=x) for p, x in wanted.items()] + [
            spec("svc", check, json_path="a.b"), spec("q1", check, endpoint="svc"), spec("q2", check, endpoint="bad", json_path="a"), spec("q3", check, endpoint="none", json_path="a")])
        got = rows(json_by_spec(probes, specs, "k", "doc", check=check, truthy=truthy), "value", "state")
        if truthy:
            assert got == {"p1": (None, "truthy"), "p2": (None, "truthy"), "p3": (None, "falsy"), "p4": (None, "truthy"), "p5": (None, None), "p6": (None, "falsy"),
                           "svc": (None, "truthy"), "q1": (None, MISSING_SETTING), "q2": (None, None)}
        else:
            assert got == {"p1": (5.0, None), "p2": (7.0, None), "p3": (None, None), "p4": (None, None), "p5": (None, None), "p6": (None, None),
                           "svc": (5.0, None), "q1": (None, MISSING_SETTING), "q2": (None, None)}


def test_ranges_and_periods_by_spec(spark):
    points = spark.createDataFrame([("s", "2024-06-01 11:50:00", 1.0), ("s", "2024-06-01 11:00:00", 2.5), ("s", "2024-06-01 12:30:00", 99.0), ("u", "2024-06-01 10:00:00", None)],
                                   "k string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    specs = specs_frame(spark, [spec("a", "latest_point", series="s", minutes="10"), spec("b", "latest_point", series="s", minutes="9.5"), spec("s", "latest_point"),
                                spec("c", "latest_point", series="u", minutes="600"), spec("d", "latest_point", series="s", minutes="?")])
    got = rows(trailing_by_spec(points, specs, "k", as_of_lit(AS_OF)), "value")
    assert got == {"a": (1.0,), "s": (1.0,), "c": (None,), "d": (1.0,)}
    specs = specs_frame(spark, [spec("a", "windowed_stat", series="s", period_seconds="600"), spec("b", "windowed_stat", series="s", period_seconds="3600", stat="Average"),
                                spec("c", "windowed_stat", series="s", period_seconds="60"), spec("e", "windowed_stat", series="s", period_seconds="3600", stat="SampleCount"),
                                spec("f", "windowed_stat", series="u", period_seconds="7200")])
    got = rows(windowed_by_spec(points, specs, "k", as_of_lit(AS_OF)), "value")
    assert got == {"a": (1.0,), "b": (1.75,), "e": (2.0,), "f": (0.0,)}


def test_filters_by_spec(spark):
    docs = spark.createDataFrame([("c", '{"a": 5, "b": {"c": true}}'), ("c", '{"a": 5.0}'), ("c", '{"a": "5"}'), ("c", "broken"), ("d", '{"a": 5}'), ("c", '{"a": null}')], "k string, doc string")
    specs = specs_frame(spark, [spec("n", "doc_count", collection="c", field="a", equals="5"), spec("t", "doc_count", collection="c", field="a", equals='"5"'),
                                spec("b", "doc_count", collection="c", field="b.c", equals="true"), spec("c", "doc_count"), spec("z", "doc_count", collection="none"),
                                spec("u", "doc_count", collection="c", field="a", equals="null"), spec("o", "doc_count", collection="c", field="a", equals="1")])
    got = rows(filtered_counts_by_spec(docs, specs, "k", "doc"), "value")
    assert got == {"n": (2.0,), "t": (1.0,), "b": (1.0,), "c": (5.0,), "z": (0.0,), "u": (1.0,), "o": (0.0,)}
