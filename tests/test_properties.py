"""Property checks of the two translations most likely to drift: fnmatch globs to
regular expressions, and Python truthiness of JSON values through VARIANT."""

import fnmatch
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions.globs import glob_regex
from vigil.functions.jsonpath import json_truthiness

ALPHABET = "ab./*?[]!-"
NAMES = st.text(alphabet="ab./-![]", max_size=8)
PATTERNS = st.text(alphabet=ALPHABET, max_size=7)


@settings(max_examples=2000, deadline=None)
@given(PATTERNS, NAMES)
def test_glob_regex_matches_fnmatchcase(pattern, name):
    assert bool(re.match(glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_glob_regex_agrees_on_spark(spark):
    cases = [("*.csv", "a.csv"), ("*.csv", "dir/a.csv"), ("[!a]*", "b"), ("[!a]*", "a"), ("?.txt", "ab.txt"),
             ("[a-c]x", "bx"), ("[]]", "]"), ("[!]]", "a"), ("a[", "a["), ("*/en/*", "x/en/y"), ("data/*", "data/"),
             ("[?-/]", "?"), ("[!z-a]", "q"), ("[a--]", "-"), ("[&&a]", "&"), ("[\\]", "\\"), ("[^a]", "^")]
    df = spark.createDataFrame([(p, n, glob_regex(p)) for p, n in cases], "p string, n string, r string")
    got = {(r["p"], r["n"]): r["m"] for r in df.select("p", "n", F.expr("n rlike r").alias("m")).collect()}
    assert got == {(p, n): fnmatch.fnmatchcase(n, p) for p, n in cases}


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(min_value=-10**20, max_value=10**20)
    | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=6)


@settings(max_examples=1, deadline=None)
@given(st.lists(JSON, min_size=200, max_size=200))
def test_json_truthiness_matches_python(spark, values):
    docs = [(i, json.dumps({"a": {"b": v}})) for i, v in enumerate(values)]
    docs.append((len(values), json.dumps({"a": {}})))
    df = spark.createDataFrame(docs, "i int, doc string")
    got = {r["i"]: r["t"] for r in df.select("i", json_truthiness(F.col("doc"), "a.b").alias("t")).collect()}
    for i, v in enumerate(values):
        assert got[i] == ("truthy" if v else "falsy"), (v, got[i])
    assert got[len(values)] is None
