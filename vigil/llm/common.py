"""Helpers the operators share: reading tables, materialising, row keys."""

from __future__ import annotations

import sys
import types
from array import array
from collections.abc import Callable

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python workers by so many rows at once, which bounds their memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table (all columns when none are named)."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it
    back: cuts the lineage, survives lost executors, and gives later joins a size
    Catalyst knows."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """``materialize`` with options of the writer; also gives the folder, for ``discard``. The shuffle files of
    the write go when it is done, not when the driver happens to collect its garbage."""
    path, conf = scratch_path(df.sparkSession, f"llm-{name}"), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that no later step reads: call it once what was derived from them is written."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def fold_of(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast of an object of a class of this subpackage as bytes (``pickle.loads`` in the
    worker): a plain broadcast names the class by its module, which workers may not have."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def worker_object(key: tuple, make: Callable):
    """An object a Python worker makes once and keeps for its later tasks (a loaded
    tokenizer, a cache); tasks get their functions by value, so module globals would not last."""
    store = sys.modules.setdefault("_vigil_worker_objects", types.ModuleType("_vigil_worker_objects")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class WordIds(dict):
    """Word -> its number, in a Python worker: a word is encoded when it is first met, and its ids are kept.
    ``words`` come with their ids, the bytes of 32-bit numbers that end at the 64-bit ``ends``; they are never forgotten."""

    def __init__(self, encode: Callable, words=(), ids: bytes = b"", ends: bytes = b""):
        super().__init__(zip(words, range(len(words))))
        self.encode, self.words = encode, words
        self.pool, self.ends = array("i", ids), array("q", bytes(8) + ends)

    def __missing__(self, word):
        self.pool.extend(self.encode(word))
        self.ends.append(len(self.pool))
        number = self[word] = len(self.ends) - 2
        return number

    def add(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words it does not hold: their ids, one after the other, and how many each has."""
        first = len(self.ends) - 1
        self.update(zip(words, range(first, first + len(words))))
        self.ends.frombytes((len(self.pool) + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.pool.frombytes(ids.astype(np.int32).tobytes())

    def trim(self, remember: int) -> bool:
        """Whether it forgot all but the first words, as it held ``remember`` others, or 16 ids for each of so many."""
        fixed = len(self.words)
        if len(self) - fixed <= remember and len(self.pool) - self.ends[fixed] <= 16 * remember:
            return False
        self.clear()
        self.update(zip(self.words, range(fixed)))
        del self.pool[self.ends[fixed]:], self.ends[fixed + 1:]
        return True

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and where each word's begin (and the last one's end)."""
        pool, ends = np.asarray(self.pool), np.asarray(self.ends)
        count = ends[numbers + 1] - ends[numbers]
        begin = np.concatenate([[0], np.cumsum(count)])
        return pool[np.repeat(ends[numbers] - begin[:-1], count) + np.arange(begin[-1])], begin


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array for null or no run."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")
