"""SimHash near-duplicate detection with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its word
shingles. Fingerprints within ``radius`` bits of each other are linked and the linked
ones form components.

Two fingerprints at most ``radius`` bits apart agree on at least two of ``radius + 2``
bit blocks, so every pair of blocks gives a bucket key and each link is inside some
bucket. Each bucket is cut into shards of about ``shard_size`` fingerprints; a shard's
BK-tree (children keyed by the Hamming distance to their parent) is sent to every shard
of the same bucket and answers its radius queries, following only the edges within the
radius. A task thus holds two shards, however large a bucket is. It reports the star of
each local component instead of the links inside it.

Edge cases: null text counts as empty; a text with no word has fingerprint zero, linked
like any other; fewer words than a shingle give one shingle of all words. Repeated rows
share a fingerprint. A null id takes no part in the smallest id of its component (null
if no member has an id). An empty table gives no rows; other columns are ignored, and
kept by ``drop_near_duplicates`` whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import free_name, materialize
from vigil.llm.components import connected_components

SEED = 42


def simhash64(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = list(map(len, words))
        ends = [e + i for i, e in enumerate(accumulate(lengths))]
        hashes = np.array([digest(joined[e - w:f], SEED) for e, w, f in zip(ends, lengths, ends[shingle - 1:])],
                          dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[part:part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` plus a signed 64-bit fingerprint column."""
    schema = docs.select("*", F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text)
            fps = pa.array([simhash64(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, out])
    return docs.mapInArrow(run, schema)


class BKTree:
    """Metric tree over 64-bit values; a node's children are keyed by Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while new:
            d = (value ^ self.values[at]).bit_count()
            step = self.children[at].setdefault(d, new)
            if step == new:
                break
            at = step
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the stored values at most ``radius`` bits from ``value``."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            stack.extend(c for e, c in self.children[at].items() if d - radius <= e <= d + radius)
        return found


def shard_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Star edges of the links between two shards (inside one when ``right`` is None)."""
    values = left + (right or [])
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    tree = BKTree()
    if right is None:
        for i, v in enumerate(values):
            for j in tree.within(v & MASK, radius):
                parent[find(i)] = find(j)
            tree.add(v & MASK)
    else:
        for v in left:
            tree.add(v & MASK)
        for i, v in enumerate(right, len(left)):
            for j in tree.within(v & MASK, radius):
                parent[find(i)] = find(j)
    return [(values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i]


MASK = (1 << 64) - 1


def block_keys(fp: Column, radius: int) -> Column:
    """Array of (combo, value): one bucket key per pair of the ``radius + 2`` bit blocks."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def part(i):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    pairs = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    return F.array(*[F.struct(F.lit(c).alias("combo"),
                              F.shiftleft(part(i), edges[j + 1] - edges[j]).bitwiseOR(part(j)).alias("val"))
                     for c, (i, j) in enumerate(pairs)])


def fingerprint_links(fps: DataFrame, radius: int, shard_size: int = 512) -> DataFrame:
    """Distinct ``fps(fp)`` -> star edges ``(u, v)`` that connect exactly what the links
    of at most ``radius`` bits connect."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("k")).select("fp", "k.combo", "k.val")
    sizes = keyed.groupBy("combo", "val").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / F.lit(shard_size)).cast("int")
    members = keyed.join(sizes, ["combo", "val"]).select(
        "combo", "val", "fp", shards.alias("shards"),
        F.pmod(F.xxhash64("fp"), shards.cast("long")).cast("int").alias("mine"))
    meetings = members.select(
        "combo", "val", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "combo", "val", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "fp")
    keys = ["combo", "val", "a", "b"]
    dealt = meetings.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        key, left, right = None, [], []

        def close():
            if key is None or len(left) + len(right) < 2:
                return []
            return shard_links(left, None if key[2] == key[3] else right, radius)
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            links = []
            for combo, val, a, b, mine, fp in zip(*cols):
                if (combo, val, a, b) != key:
                    links += close()
                    key, left, right = (combo, val, a, b), [], []
                (left if mine == a else right).append(fp)
            if links:
                yield _edges(links)
        if links := close():
            yield _edges(links)

    def _edges(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components_of(rows: DataFrame, radius: int = 2, shard_size: int = 512) -> DataFrame:
    """``rows(id, fp)`` (materialised) -> ``(fp, component_id)`` for every distinct
    fingerprint; component_id is the smallest id reachable."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprints")
    links = materialize(fingerprint_links(nodes.select("fp"), radius, shard_size), "links")
    comps = connected_components(links)
    comps = comps.union(comps.select(F.col("root").alias("node"), "root").distinct())
    linked = nodes.join(comps, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(firsts, "root").select(F.col("fp").alias("node"), "component_id")
    # written, so that a later join deals both its sides anew and can split a hot fingerprint
    return materialize(nodes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                    shard_size: int = 512) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id."""
    rows = materialize(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")), "body", shingle)
                       .select("id", "fp"), "simhash")
    comps = components_of(rows, radius, shard_size)
    return rows.join(comps, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                         shard_size: int = 512) -> DataFrame:
    """``docs`` with one row of each component left: the one with the smallest id (rows
    without an id last; among repeated rows, the first written)."""
    fp, row = free_name(docs, "simhash"), free_name(docs, "row")
    keyed = materialize(with_fingerprints(docs, text, shingle, out=fp).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    rows = keyed.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("i"),
                                 F.col(row).alias("row")).alias("id"), F.col(fp).alias("fp"))
    comps = components_of(rows, radius, shard_size)
    extra = (rows.join(comps, "fp").where(F.col("id.row") != F.col("component_id.row"))
             .select(F.col("id.row").alias(row)))
    return keyed.join(materialize(extra, "copies"), row, "left_anti").select(*docs.columns)
