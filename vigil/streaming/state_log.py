"""Published stream state as an upsert log (R2, R3): a trigger writes the keys it changed, no others.

The stream runs in update mode. Each batch's rows go to a folder of their own and count once a
commit row for the batch is written behind them, so a reader sees whole versions only and a
replayed batch overwrites its own folder. Readers take each key's row of the newest committed batch.
``compact`` folds all batches up to the newest committed one into a base version, commits it likewise and leaves
the older folders to whoever still reads them; later readers take the base and what came
behind it, so what they list is bounded by the batches since the last compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch long, kind string, n long"


class StateLog:
    """The log under ``path``, keyed by ``keys``. ``compact_every`` batches a base is written (0: never by itself)."""

    def __init__(self, path: str, keys: list[str], compact_every: int = 0):
        self.path, self.keys, self.compact_every = path.rstrip("/"), list(keys), compact_every

    def _commit(self, spark: SparkSession, batch_id: int, kind: str, n: int) -> None:
        row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{kind}-{batch_id}")

    def commits(self, spark: SparkSession) -> list:
        """Commit rows by batch; none before the first batch."""
        from pyspark.errors import AnalysisException
        try:
            found = spark.read.schema(COMMITS).parquet(f"{self.path}/commits/*")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return []
        return sorted(found.collect(), key=lambda r: (r["batch"], r["kind"]))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function: the changed rows of one trigger."""
        spark = batch.sparkSession
        folder = f"{self.path}/delta/{batch_id}"
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(folder)
        self._commit(spark, batch_id, "delta", spark.read.parquet(folder).count())
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact(spark)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """Each key's newest committed row; None before the first commit."""
        commits = self.commits(spark)
        if not commits:
            return None
        base = max((r["batch"] for r in commits if r["kind"] == "base"), default=None)
        folders = [f"{self.path}/delta/{r['batch']}" for r in commits if r["kind"] == "delta" and (base is None or r["batch"] > base)]
        if base is not None:
            folders.append(f"{self.path}/base/{base}")
        rows = spark.read.parquet(*folders)
        values = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def compact(self, spark: SparkSession) -> None:
        """A base of all committed batches; harmless to repeat."""
        commits = [r for r in self.commits(spark) if r["kind"] == "delta"]
        if not commits:
            return
        upto, folder = commits[-1]["batch"], f"{self.path}/base/{commits[-1]['batch']}"
        if any(r["kind"] == "base" and r["batch"] >= upto for r in self.commits(spark)):
            return
        self.read(spark).write.mode("overwrite").parquet(folder)
        self._commit(spark, upto, "base", spark.read.parquet(folder).count())
