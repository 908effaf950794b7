"""Cleaning a corpus: language ID, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and rereads it as the next stage's documents. All stages but
the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, langid, sentencepiece, simhash
from vigil.llm.common import discard, free_name, materialize_at, small_batches


#: Texts of so many letters need a cosine of CHANCE or more. Unrelated vectors of 1024 dimensions have cosines of
#: about 1 / 32; the shortest texts of a language are no farther from that than gibberish, so they are kept.
LETTERS, CHANCE = 200, 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter in the text, or a long text
    that is near no language learned. Without labelled documents only the letters count.
    Null and empty texts have no letter. Repeated rows share one decision."""
    small_batches(spark)
    prototypes = langid.train(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = langid.predict(docs, prototypes, out=(lang, score))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    told = F.when(F.col(score) >= CHANCE, F.lit(True)).otherwise(letters < LETTERS)
    return found.where((F.col(lang) != "und") & told).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the smallest id, of repeated rows the first
    written. Null and empty texts share fingerprint zero; an empty table stays empty."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (containment 0.8 of its five-word shingles).
    Null, empty and short texts hold none; without items nothing is dropped."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return decontaminate.drop_contaminated(docs, items, width=5, least=0.8)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every remaining document: piece counts, scores, checksums and digests of the restored texts."""
    small_batches(spark)
    import public_tokenizers
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.round_trip(docs, pieces)


STAGES = [("language_id", language_stage), ("simhash_dedup", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("sentencepiece", encoding_stage)]
ORACLE_SQL = None  # cosines, fingerprints and the lattice are not SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, stage in STAGES:
        docs, folder = materialize_at(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, *former)  # written anew by this stage, so read no more
        former = [folder]
    return docs
