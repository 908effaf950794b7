"""File listings and text exports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.records import Records, json_records


def file_listing(spark: SparkSession, path: str, path_glob: str | None = None, recursive: bool = True) -> DataFrame:
    """S3: one row per file (path, modificationTime, length). The binary file
    source is used for its listing only: ``content`` is pruned, so no file body
    is read. Listing itself runs on executors for large directory trees."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(path).select(
        F.col("path"), F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime"), F.col("length"))


def table_files(df: DataFrame) -> DataFrame:
    """S3 for files behind a table: one row per data file the table reads
    (path, modificationTime, length) from the hidden ``_metadata`` column. Only
    the metadata columns are read; the distinct is a partial aggregate."""
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("modificationTime"),
        F.col("_metadata.file_size").alias("length")).distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, path: str = "path", length: str = "length",
                  modified: str = "modificationTime") -> DataFrame:
    """S3 over inventories kept as tables: ``(path, change, length_before, length)`` of every object of either snapshot, ``change``
    being new, vanished, changed (another length or time) or same. The listings stay distributed: no file index is held on
    the driver. A path listed twice counts as its newest entry; rows without a path are no objects."""
    def newest(listing, suffix):
        entry = F.max(F.struct(F.col(modified).alias("at"), F.col(length).alias("size"))).alias(f"e{suffix}")
        return listing.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(entry)
    both = newest(before, 0).join(newest(after, 1), "path", "full")
    change = F.when(F.col("e0").isNull(), "new").when(F.col("e1").isNull(), "vanished").when(
        F.col("e0").eqNullSafe(F.col("e1")), "same").otherwise("changed")
    return both.select("path", change.alias("change"), F.col("e0.size").alias("length_before"), F.col("e1.size").alias("length"))


def line_export(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order: (file, block, line_no). Order within a file is
    (block start, position in block); ``monotonically_increasing_id`` only
    orders rows inside one task, which reads one block in order."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    return raw


def with_row_order(df: DataFrame) -> DataFrame:
    """Adds (_file, _block, _pos): the order of rows as stored, for sources whose
    "first" / "last" row means file order. Within one task rows keep their order,
    and a task reads one block of one file."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_pos"))


def ndjson_export(spark: SparkSession, path: str, schema: str | None = None) -> Records:
    """Line-delimited JSON. Lines that do not parse are skipped, as the export's reader does, and given apart to be reported."""
    return json_records(spark, path, schema)


def parsed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """S7 on text already in a table: keeps lines that parse as JSON objects."""
    return lines.where(F.try_parse_json(F.col(line)).isNotNull())


def commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose ``#`` lines are annotations; blank lines are skipped; one
    header row names the columns."""
    reader = spark.read.option("comment", "#").option("header", "true").option("ignoreLeadingWhiteSpace", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)
