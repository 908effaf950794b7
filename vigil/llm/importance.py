"""Target-distribution importance resampling over hashed word runs.

The features of a text are its runs of ``n_min`` to ``n_max`` consecutive words, joined by one
space, repeats counted; a feature's bucket is its CRC-32 modulo ``buckets``. Two Spark
aggregates count the buckets of the source and of the target texts (one row per bucket and task
crosses the shuffle); a bucket's gain is the smoothed log ratio in thousandths. A document's
weight is the floored mean gain of its features, its score the weight plus Gumbel noise drawn
from its id, and the highest scores are a sample without replacement.

The CRC of all features of a batch comes from a position table. The register is linear over
bits, so a byte gives a fixed contribution by its value and its distance from the feature's
end: contributions are looked up for all bytes, XORed over each feature's span
(``bitwise_xor.reduceat``) and completed with a constant of the length. Spans longer than
the table are cut into blocks of its depth, counted from the end, and folded block by block: a
register moves over a whole block by four more look-ups.

Scores are whole numbers in a range that does not grow with the input (a gain is a logarithm of counts),
so their histogram is small: it gives the score of the last one drawn. Only rows from it on are
sorted, by range partitions whose sizes give the ranks; no row is ranked in one task.

Edge cases: null and empty texts have no feature, weight 0. A null id counts as the empty
text in the noise and is drawn after other ids of its score. Repeated rows are scored and drawn
each. Fewer than ``least_words`` words: scored, never drawn. Empty source or target tables count
zero features; an empty source table gives no rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize

DEPTH = 64
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def position_table(depth: int = DEPTH) -> np.ndarray:
    """[distance from the end][byte] -> contribution to the register."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(POLYNOMIAL), row >> 1).astype(np.uint32)
    rows = [row]
    for _ in range(depth - 1):
        rows.append((rows[-1] >> 8) ^ row[rows[-1] & 0xFF])
    return np.stack(rows)


def length_constants(depth: int = DEPTH) -> np.ndarray:
    """CRC-32 of so many zero bytes: what a length adds to the XOR of contributions."""
    return np.array([zlib.crc32(bytes(n)) for n in range(depth + 1)], dtype=np.uint32)


def span_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """CRC-32 of each span (of one byte at least) of ``data``; spans may overlap."""
    depth = len(table)
    if not len(start):
        return np.zeros(0, np.uint32)
    blocks = (size + depth - 1) // depth
    first = size - (blocks - 1) * depth  # bytes of a span's first block
    owner = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # of a block in its span
    length = np.where(place == 0, first[owner], depth)
    begin = start[owner] + np.where(place == 0, 0, first[owner] + (place - 1) * depth)
    ends = np.cumsum(length)
    offset = np.arange(ends[-1]) - np.repeat(ends - length, length)
    parts = table[np.repeat(length, length) - 1 - offset, data[np.repeat(begin, length) + offset]]
    own = np.bitwise_xor.reduceat(parts, ends - length)
    head = np.cumsum(blocks) - blocks
    register = own[head] ^ ~constants[first]  # the register starts as all ones
    for step in range(1, int(blocks.max())):
        more = np.flatnonzero(blocks > step)
        r = register[more]
        moved = table[depth - 1, r & 0xFF] ^ table[depth - 2, r >> 8 & 0xFF] ^ table[depth - 3, r >> 16 & 0xFF] ^ table[depth - 4, r >> 24]
        register[more] = moved ^ own[head[more] + step]
    return ~register


#: Lower-cased byte if it belongs to a word (digits, letters, all bytes beyond ASCII), else 0.
WORD_BYTE = np.array([b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0
                      for b in range(256)], dtype=np.uint8)


def hashed_features(texts: list[bytes], n_min: int, n_max: int, buckets: int, table: np.ndarray, constants: np.ndarray,
                    word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, owner and bucket of every feature, by text)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = word_byte[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = data != 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one byte behind each word
    place = np.flatnonzero(keep)
    data, inside = data[place], inside[place]
    stop = np.flatnonzero(~inside)
    data[stop] = 32
    start = np.append(0, stop[:-1] + 1) if len(stop) else stop
    owner = np.searchsorted(ends, place[start], side="right")
    owners, hashes = [], []
    for n in range(n_min, n_max + 1):
        last = np.arange(n - 1, len(start))
        last = last[owner[last] == owner[last - n + 1]]
        begin = start[last - n + 1]
        owners.append(owner[last])
        hashes.append(span_crcs(data, begin, stop[last] - begin, table, constants) % np.uint32(buckets))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes).astype(np.int64)
    return np.bincount(owner, minlength=len(texts)), owners, hashes


def _pieces(column, most: int = 1 << 22):
    """Texts as bytes, so many bytes at a time (one text at least)."""
    held, size = [], 0
    for text in column:
        held.append((text.as_py() or "").encode("utf-8"))
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(texts: DataFrame, n_min: int = 1, n_max: int = 2, buckets: int = 10_000) -> DataFrame:
    """``texts(body)`` -> ``(bucket, c)`` of the buckets that occur."""
    def run(batches):
        tables, counts = (position_table(), length_constants(), WORD_BYTE), np.zeros(buckets, np.int64)
        for batch in batches:
            for some in _pieces(batch.column(0)):
                counts += np.bincount(hashed_features(some, n_min, n_max, buckets, *tables)[2], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "c"])
    return texts.mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket; ``buckets`` numbers on the driver."""
    spark = source.sparkSession
    totals = [df.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double")).first()[0] for df in (source, target)]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in ("s", "t"))
    ratio = (t * F.lit(totals[0] + buckets)) / (s * F.lit(totals[1] + buckets))
    joined = spark.range(buckets).withColumnRenamed("id", "bucket").join(
        source.withColumnRenamed("c", "s"), "bucket", "left").join(target.withColumnRenamed("c", "t"), "bucket", "left")
    gains = np.zeros(buckets, np.int64)
    for r in joined.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        gains[r["bucket"]] = r["gain"]
    return gains


def weighted(docs: DataFrame, gains: np.ndarray, n_min: int, n_max: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, n_features, weight)``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    zero = F.lit(0).cast("long")
    schema = rows.select("id", zero.alias("n_words"), zero.alias("n_features"), zero.alias("weight")).schema
    shared, buckets = rows.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches):
        tables = (position_table(), length_constants(), WORD_BYTE)
        for batch in batches:
            at = 0
            for some in _pieces(batch.column(1)):
                words, owner, bucket = hashed_features(some, n_min, n_max, buckets, *tables)
                n = np.bincount(owner, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, owner, shared.value[bucket])
                columns = [words, n, np.where(n > 0, total // np.maximum(n, 1), 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *[pa.array(c.astype(np.int64)) for c in columns]],
                                                 names=["id", "n_words", "n_features", "weight"])
                at += len(some)
    return rows.mapInArrow(run, schema)


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n_min: int = 1, n_max: int = 2, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every document; rank is null if it isn't drawn."""
    counts = [materialize(bucket_counts(df.select(F.col(c).alias("body")), n_min, n_max, buckets), name)
              for df, c, name in ((docs, text, "source-buckets"), (target, target_text, "target-buckets"))]
    gains = bucket_gains(*counts, buckets)
    scored = materialize(weighted(docs, gains, n_min, n_max, id_col, text).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    usable = F.col("n_words") >= least_words
    histogram = scored.where(usable).groupBy("score").agg(F.count("*").alias("n")).collect()
    to_draw = percent * sum(r["n"] for r in histogram) // 100
    least, taken = None, 0
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if taken >= to_draw:
            break
        least, taken = r["score"], taken + r["n"]
    drawable = usable & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    first = scored.where(drawable).withColumn("row", F.monotonically_increasing_id())
    # numbered within its range, so place >> 33 is the range and the rest the place in it
    ordered = materialize(first.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
                          .withColumn("place", F.monotonically_increasing_id()), "drawable")
    before, starts = 0, {}
    for r in ordered.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect():
        starts[r["range"]], before = before, before + r["n"]
    offsets = docs.sparkSession.createDataFrame([(k, v) for k, v in starts.items()], "range long, before long")
    ranked = ordered.withColumn("range", F.shiftright("place", 33)).join(offsets, "range").withColumn(
        "rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    held = ["id", "n_features", "weight", "score"]
    drawn = ranked.select(*held, F.when(F.col("rank") <= to_draw, F.col("rank")).alias("rank"))
    rest = scored.where(~F.coalesce(drawable, F.lit(False))).select(*held, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)
