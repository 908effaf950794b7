"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of distinct word shingles, in powers of two) and
sketched by the MinHash order: the ``k`` shingles with the smallest hashes, where ``k`` is
one more than a partition's items may miss, floor((1 - least) * largest size) + 1. A
document that contains at least ``least`` of an item's shingles must hold one of its sketch,
so an equi-join of the documents' shingle hashes with the sketches finds every candidate.
Only candidate texts are shingled again, and (text, item) candidates alone are verified on the
shingles themselves: shared distinct shingles over the item's distinct shingles. Words are lower-cased runs of letters and digits.

Documents are told apart by the digest of their text, so no id is needed. Column expressions, joins and aggregates only.

Edge cases: null or empty texts, and items or documents of fewer words than a shingle,
hold no shingle and match nothing. Rows that share an id are reported together; a null id
is reported as null. Items that share an id give the greater containment. Repeated rows
change nothing. Empty tables give no rows (no document is dropped). Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import free_name, materialize, normal_words


def _shingles(words: Column, width: int, make) -> Column:
    """make(list of ``width`` neighbours) at every place of the array column ``words``."""
    places = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make([F.get(words, i + F.lit(j)) for j in range(width)]))


# Words and their hashes are columns of their own: inside a lambda they would be made anew
# for every shingle. For the same reason no filter may be pushed below them: shingles are
# exploded with explode_outer (which infers none), sizes are filtered behind a written table.
def with_hashes(df: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """``df`` with the text replaced by the hashes of its word shingles."""
    df = df.withColumn("_words", F.transform(normal_words(F.col(text)), lambda w: F.xxhash64(w)))
    return df.withColumn(out, _shingles(F.col("_words"), width, lambda near: F.xxhash64(*near))).drop("_words", text)


def with_shingles(df: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """``df`` with the text replaced by its word shingles."""
    df = df.withColumn("_words", normal_words(F.col(text)))
    return df.withColumn(out, _shingles(F.col("_words"), width, lambda near: F.concat_ws(" ", *near))).drop("_words", text)


def sketches(items: DataFrame, least: float) -> DataFrame:
    """``items(key, grams, hashes, n)`` -> ``(key, h)``: each item's sketch."""
    top = F.pow(F.lit(2), F.ceil(F.log2(F.col("n"))))  # largest size of the item's partition
    k = (F.floor((1 - least) * top + 1e-9) + 1).cast("int")
    return items.select("key", F.explode(F.slice(F.array_sort(F.array_distinct("hashes")), F.lit(1), k)).alias("h"))


def contaminated_texts(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, item_col: str = "item_id",
                       text: str = "text", item_text: str = "text") -> DataFrame:
    """``(text_key, item, containment)``: which distinct texts hold which items."""
    named = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("a"), F.col(item_text).alias("b"))
    named = with_hashes(with_shingles(named, "a", width, "grams"), "b", width, "hashes")
    named = named.withColumn("grams", F.array_distinct("grams"))
    # an item is known by its shingles: ids may be null or stand for several items
    named = named.withColumn("key", F.md5(F.array_join("grams", "\n")))
    named = materialize(named.withColumn("n", F.size("grams")), "items").where("n > 0")
    known = named.select("key", "grams", "hashes", "n").dropDuplicates(["key"])
    sketch = materialize(sketches(known, least), "sketches")
    texts = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("text_key"), F.col(text).alias("body"))
    found = (with_hashes(texts, "body", width, "hs").select("text_key", F.explode_outer("hs").alias("h"))
             .join(sketch, "h").select("text_key", "key").distinct())
    found = materialize(found, "candidates")
    # verified on the shingles themselves, of the candidate pairs alone: a passage that many texts share meets
    # the items its text is a candidate for, and the pair's text spreads it over the tasks
    pairs = found.join(known.select("key", "n", F.explode("grams").alias("gram")), "key")
    again = texts.join(found.select("text_key").distinct(), "text_key", "left_semi")
    shared = (with_shingles(again, "body", width, "held").select("text_key", F.explode_outer("held").alias("gram"))
              .join(pairs, ["text_key", "gram"]).select("text_key", "key", "n", "gram").distinct())
    held = shared.groupBy("text_key", "key", "n").agg((F.count("*") / F.col("n")).alias("containment")).where(F.col("containment") >= least)
    ids = named.select("key", "item").distinct()
    return materialize(held.join(ids, "key").groupBy("text_key", "item")
                       .agg(F.max("containment").alias("containment")), "contaminated")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
                 **options) -> DataFrame:
    """``(id, item, containment)`` of every document that holds an item."""
    found = contaminated_texts(docs, items, item_col=item_col, text=text, **options)
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.md5(text).alias("text_key"))
    return keyed.join(found, "text_key").groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(
        F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    key = free_name(docs, "text_key")
    found = contaminated_texts(docs, items, text=text, **options).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, F.md5(text)).join(found, key, "left_anti").select(*docs.columns)
