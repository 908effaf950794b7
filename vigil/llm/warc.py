"""WARC archives with a two-level capture index.

``write_archives`` writes one record per page as plain WARC text: Spark's text writer with
the record separator of the format (two empty lines) between rows, so any file system
Spark writes to will do. Of pages with equal payloads of ``least`` bytes and more, the one
with the largest id is a response and the others are revisit records that name it.

``read_archives`` reads the files back and gives each record's place. ``build_index``
sorts captures by reversed-host URL key and id, and packs them into compressed blocks; the
block table's first keys are the sparse directory. ``lookup`` finds keys by binary search:
first among the range partitions' first keys (their number is bounded by the shuffle
partitions; all that is broadcast), then in the directory of one partition, then inside
the one block it decompresses. ``fetch`` reads the found byte ranges, and only those.

Edge cases: null html is an empty payload; a null url has the key ``-``; control
characters of a url are percent-encoded in headers. Pages without id sort first, may
revisit others and are referred to by none (if no page of a group has an id, all are
responses). Repeated rows of the largest id are all responses. An empty table gives empty
archives and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialize
from vigil.session import scratch_path

SEPARATOR = "\r\n\r\n"
RECORD = "page_id long, url string, file string, offset long, length long, type string, digest string, bytes long, refers_to long"


def roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Pages with payload, digest, size and ``refers_to`` (null for responses)."""
    body = F.coalesce(F.col(html), F.lit(""))
    sized = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"),
                         F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    groups = (sized.where(F.col("bytes") >= least).groupBy("digest")
              .agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep"))
    joined = sized.join(materialize(groups, "payload-groups"), "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select("page_id", "url", "payload", "digest", "bytes", F.when(revisit, F.col("keep")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """One WARC record per row of ``roles``; payloads of revisits are not stored again."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(SEPARATOR))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Target-URI", url), F.lit(f"WARC-Date: {date}\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(SEPARATOR))
    (records.select(F.concat(head, block).alias("value")).write.option("lineSep", SEPARATOR)
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end offset) of the record that starts at ``at``."""
    split = data.index(b"\r\n\r\n", at)
    lines = data[at:split].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = split + 4 + int(headers["Content-Length"])
    return headers, data[split + 4:end], end


def capture(headers: dict, block: bytes) -> dict:
    """What a record says; a response's digest and size are taken from its payload."""
    page = re.compile(r"<urn:page:(-?\d+)>")
    ids = [int(m[1]) if (m := page.match(headers.get(k, ""))) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    else:
        digest, size = headers["WARC-Payload-Digest"].partition(":")[2], int(http.rpartition(b": ")[2])
    return {"page_id": ids[0], "url": headers.get("WARC-Target-URI"), "type": headers["WARC-Type"], "digest": digest,
            "bytes": size, "refers_to": ids[1]}


def _records(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(names, RECORD.split(", "))],
                                      names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives with its file, offset and length."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, rows = content.as_py(), 0, []
                while at < len(data):
                    headers, block, end = parse_record(data, at)
                    rows.append(capture(headers, block) | {"file": name, "offset": at, "length": end - at})
                    at = end + len(SEPARATOR)
                    if len(rows) == 1000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)
    return files.mapInArrow(run, RECORD)


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.org:80/x?q`` -> ``org,b,a)/x?q``; null -> ``-``."""
    rest = F.lower(F.regexp_replace(url, r"(?s)^[^:/?#]*://(www\.)?", ""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#:]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#:]*(?::\d*)?(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail), F.lit("-"))


def capture_key(url: Column, page_id: Column) -> Column:
    """Unique sort key of a capture: url key, blank, zero-padded id."""
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


BLOCK = "part long, block long, first_key string, n long, data binary"


def build_index(captures: DataFrame, block_rows: int = 1000) -> DataFrame:
    """Captures sorted by key and packed into compressed blocks, one directory row each."""
    from pyspark import TaskContext
    keyed = captures.withColumn("key", capture_key(F.col("url"), F.col("page_id")))
    dealt = keyed.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches):
        part, block, rows = TaskContext.get().partitionId(), 0, []

        def close(mine):
            data = zlib.compress(json.dumps(mine).encode())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([mine[0]["key"]], pa.string()),
                 pa.array([len(mine)], pa.int64()), pa.array([data], pa.binary())], names=[x.split()[0] for x in BLOCK.split(", ")])
        for batch in batches:
            rows += batch.to_pylist()
            while len(rows) >= block_rows:
                yield close(rows[:block_rows])
                rows, block = rows[block_rows:], block + 1
        if rows:
            yield close(rows)
    return materialize(dealt.mapInArrow(run, BLOCK), "capture-index")


def captures_of(index: DataFrame) -> DataFrame:
    """All captures of the index, in key order within a block."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield _records(json.loads(zlib.decompress(data.as_py())))
    return index.select("data").mapInArrow(run, RECORD)


def lookup(index: DataFrame, keys: DataFrame, group: int = 10_000) -> DataFrame:
    """``keys(key)`` -> the captures with exactly these keys. Keys of one partition are
    dealt to groups of about ``group``, each with that partition's blocks."""
    spark = index.sparkSession
    bounds = sorted((r["first_key"], r["part"]) for r in index.where("block = 0").select("first_key", "part").collect())
    first = spark.sparkContext.broadcast(bounds)

    def route(batches):
        keys_, parts = [b[0] for b in first.value], [b[1] for b in first.value]
        for batch in batches:
            # a key equal to a partition's first key may also end the one before
            rows = [(k, parts[i]) for k in batch.column(0).to_pylist()
                    for i in range(max(0, bisect.bisect_left(keys_, k) - 1), bisect.bisect_right(keys_, k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                                             names=["key", "part"])
    routed = keys.select("key").where("key is not null").distinct().mapInArrow(route, "key string, part long")
    sizes = routed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(group)).cast("long").alias("groups"))
    asked = routed.join(sizes, "part").select("part", F.pmod(F.xxhash64("key"), F.col("groups")).alias("g"), "key")
    blocks = index.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"),
                                              "block", "first_key", "data")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("block")
        directory, data = right.column("first_key").to_pylist(), right.column("data")
        rows, opened = [], {}
        for key in left.column("key").to_pylist():
            for i in range(max(0, bisect.bisect_left(directory, key) - 1), bisect.bisect_right(directory, key)):
                if i not in opened:
                    opened[i] = json.loads(zlib.decompress(data[i].as_py()))
                at = bisect.bisect_left(opened[i], key, key=lambda r: r["key"])
                while at < len(opened[i]) and opened[i][at]["key"] == key:
                    rows.append(opened[i][at])
                    at += 1
        return pa.Table.from_batches([_records(rows)])
    return asked.groupBy("part", "g").cogroup(blocks.groupBy("part", "g")).applyInArrow(search, RECORD)


def fetch(found: DataFrame) -> DataFrame:
    """Reads the byte range of each located record, and takes the capture from the record."""
    def run(batches):
        from pyarrow import fs
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["file"], r["offset"]))
            out, name, source = [], None, None
            for r in rows:
                if r["file"] != name:
                    name = r["file"]
                    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                    source = system.open_input_file(place)
                headers, block, _ = parse_record(source.read_at(r["length"], r["offset"]))
                out.append(r | capture(headers, block))
            yield _records(out)
    return found.mapInArrow(run, RECORD)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Writes the archives and their index, then reads every page's record back; a
    revisit's response is found through the index and read by its byte range."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_archives(roles(pages, id_col, url, html, least), path)
    index = build_index(read_archives(spark, path))
    captures = captures_of(index)
    responses = captures.where("type = 'response'").select("page_id", "url", "digest")
    wanted = captures.where("type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    # the url under which a revisit's response was captured gives its key
    keys = responses.join(wanted, ["page_id", "digest"]).select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    read = fetch(lookup(index, keys)).where("type = 'response'").select(
        F.col("page_id").alias("response"), F.col("digest").alias("found")).distinct()
    return captures.join(materialize(read, "responses"), (F.col("digest") == F.col("found")) & (F.col("refers_to") == F.col("response")),
                         "left").select(
        F.col("page_id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("response").alias("refers_to"))
