"""Pattern index: how many rows match each of any number of terms, prefixes or globs, in one scan.

No row is compared with every pattern. Patterns are a small relation keyed by something a row
has few of, and rows meet it by an equi-join: a term by the distinct words of a document, a
prefix by the row's own prefixes of the lengths that occur, a glob by one literal n-gram that
every match must contain (the one fewest other globs contain), after which the glob itself is
tested. Matches are counted per task before the shuffle. Patterns come from a configuration on
the driver, which bounds their relation; patterns that match nothing read 0.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.globs import glob_literals, glob_regex
from vigil.operators.base import to_measures

GRAM = 4  # literals are cut into pieces of at most so many characters


def relation(spark: SparkSession, rows: Iterable[Mapping], schema: str) -> DataFrame:
    """A small table from the driver, as a literal inside the plan (no worker is asked for it)."""
    literal = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(literal))


def counted(matches: DataFrame, names: Iterable[str], check: str) -> DataFrame:
    """``matches(pipeline)``, one row per match -> a measure for each pipeline of ``names``."""
    every = relation(matches.sparkSession, [{"pipeline": n} for n in names], "pipeline: string")
    counts = matches.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    full = every.join(counts, "pipeline", "left").select("pipeline", F.coalesce("n", F.lit(0)).alias("n"))
    return to_measures(full, check, value=F.col("n"))


def term_matches(words: DataFrame, terms: Mapping[str, tuple[str, str] | None]) -> DataFrame:
    """``words``: one array column of words per field. ``terms``: pipeline -> (field, word), or None for
    all rows. -> ``(pipeline)``, one row per matching row."""
    spark = words.sparkSession
    wanted = relation(spark, [{"pipeline": p, "field": t[0] if t else "", "word": t[1] if t else ""} for p, t in terms.items()],
                      "pipeline: string, field: string, word: string")

    def marked(field):
        own = F.filter(F.array_distinct(F.col(f"`{field}`")), lambda w: w != "")
        return F.coalesce(F.transform(own, lambda w: F.struct(F.lit(field).alias("field"), w.alias("word"))),
                          F.array().cast("array<struct<field:string,word:string>>"))
    whole = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("word")))  # every row has it, once
    marks = F.concat(whole, *map(marked, words.columns))
    return words.select(F.explode(marks).alias("m")).select("m.field", "m.word").join(wanted, ["field", "word"]).select("pipeline")


def prefix_matches(rows: DataFrame, text: Column, prefixes: Mapping[str, str]) -> DataFrame:
    """-> ``(pipeline)``, one row per row whose text starts with the pipeline's prefix."""
    wanted = relation(rows.sparkSession, [{"pipeline": p, "start": x} for p, x in prefixes.items()], "pipeline: string, start: string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(x) for x in prefixes.values()})])
    own = F.transform(F.filter(lengths, lambda n: n <= F.char_length("text")), lambda n: F.substr(F.col("text"), F.lit(1), n))
    starts = rows.select(text.alias("text")).where("text is not null").select(F.explode(own).alias("start"))
    return starts.join(wanted, "start").select("pipeline")


def rarest_pieces(globs: Mapping[str, str]) -> dict[str, str]:
    """Pipeline -> the piece of its glob's literals (up to GRAM characters) that fewest globs have, the
    longest of these; empty for a glob without a literal."""
    pieces = {}
    for name, glob in globs.items():
        literals = glob_literals(glob)
        pieces[name] = {x[i:i + GRAM] for x in literals for i in range(max(1, len(x) - GRAM + 1))} - {""}
    seen = Counter(x for held in pieces.values() for x in held)
    return {name: max(held, key=lambda x: (len(x), -seen[x], x), default="") for name, held in pieces.items()}


def glob_matches(rows: DataFrame, text: Column, globs: Mapping[str, str]) -> DataFrame:
    """-> ``(pipeline)``, one row per row whose text the pipeline's glob matches; an empty glob matches any."""
    pieces = rarest_pieces(globs)
    wanted = relation(rows.sparkSession, [
        {"pipeline": p, "piece": pieces[p], "regex": glob_regex(g) if g else ""} for p, g in globs.items()],
        "pipeline: string, piece: string, regex: string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(x) for x in pieces.values()})])
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)))
    own = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.when(n == 0, F.array(F.lit(1))).otherwise(starts), lambda i: F.substr(F.col("text"), i, n)))))
    grams = rows.select(text.alias("text")).where("text is not null").select("text", F.explode(own).alias("piece"))
    return grams.join(wanted, "piece").where("regex = '' OR text RLIKE regex").select("pipeline")
