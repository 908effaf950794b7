"""Exact top-k search by distributed histogram selection.

Vectors are quantised to integers, so scores are exact integers. Queries go in blocks of
at most ``block`` vectors, which is all the driver and a task ever hold of them. For a
block, one pass scores every candidate and gathers each query's score range; further
passes histogram the scores inside the range, locate the bin with the k-th highest score
and narrow the range to it, until a bin is one score wide. A last pass keeps what beats
the k-th score, and of its ties the smallest ids. No pass sorts or shuffles scores.

Edge cases: a vector that is null, or holds a null or non-finite component, takes no
part, nor does a row without id. A candidate with another dimension is not scored. A
query does not meet rows of its own id; repeated rows of another id each count. Of
queries that repeat an id the smallest vector stands for it. Fewer candidates than k
give all of them; no query or no candidate gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialize

EXACT = 1 << 53  # float64 holds every integer up to here
TOP = (1 << 62)


def quantize(vectors: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """``(id, q)``: floor(scale * x) of each component in double, rows that take part only."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = (F.col(id_col).isNotNull() & F.col(vector).isNotNull()
              & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"),
                                        F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("q"))


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers with that dimension and their vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(lengths == dim)
    flat = column.values.to_numpy(zero_copy_only=False)
    start = column.offsets.to_numpy()[rows]
    return rows, flat[start[:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0), np.int64)


def _scores(cands: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x candidates), in float64 where that is exact."""
    dim = max(1, cands.shape[1])
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (cands, queries)]
    if most[0] * most[1] * dim < EXACT:
        return (queries.astype(np.float64) @ cands.astype(np.float64).T).astype(np.int64)
    if most[0] * most[1] * dim < TOP:
        return queries @ cands.T
    exact = queries.astype(object) @ cands.astype(object).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def _scored(batches, ids, queries):
    """(candidate ids, scores, mask of real candidates) for slices of the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            column = part.column(1)
            column = pa.concat_arrays([column])  # offsets from zero
            rows, cands = _matrix(column, queries.shape[1])
            if len(rows):
                cid = part.column(0).to_numpy(zero_copy_only=False)[rows]
                yield cid, _scores(cands, queries), cid[None, :] != ids[:, None]


def _block_top(cands: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, bins: int) -> DataFrame:
    sc = cands.sparkSession.sparkContext
    shared = sc.broadcast((ids, queries))
    n = len(ids)

    def ranges(batches):
        own, q = shared.value
        low, high = np.full(n, TOP), np.full(n, -TOP)
        seen = np.zeros(n, np.int64)
        for _, s, real in _scored(batches, own, q):
            low = np.minimum(low, np.where(real, s, TOP).min(axis=1))
            high = np.maximum(high, np.where(real, s, -TOP).max(axis=1))
            seen += real.sum(axis=1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, low[at], high[at], seen[at])],
                                         names=["query", "low", "high", "seen"])
    found = (cands.mapInArrow(ranges, "query long, low long, high long, seen long").groupBy("query")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("seen").alias("seen")).collect())
    low, width = np.full(n, TOP), np.zeros(n, np.int64)  # the range [low, low + width) holds the k-th score
    need = np.full(n, k, np.int64)  # its rank among the scores of the range
    for r in found:
        low[r["query"]] = r["low"]
        if r["seen"] > k:
            width[r["query"]] = r["high"] - r["low"] + 1
    # a query with at most k candidates keeps low = its least score, so all are kept
    small = width == 0
    while (width > 1).any():
        step = np.maximum(1, -(-width // bins))
        state = sc.broadcast((low, width, step, need))

        def histogram(batches):
            own, q = shared.value
            lo, wide, per, rank = state.value
            at = np.flatnonzero(wide > 1)
            rank = rank[at]
            counts = np.zeros(len(at) * bins, np.int64)
            lo, wide, per, base = lo[at, None], wide[at, None], per[at, None], np.arange(len(at))[:, None] * bins
            for _, s, real in _scored(batches, own[at], q[at]):
                off = s - lo
                inside = real & (off >= 0) & (off < wide)
                counts += np.bincount((base + off // per)[inside], minlength=len(counts))
            full = np.flatnonzero(counts)
            row = full // bins
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[row], rank[row], full % bins, counts[full])],
                                             names=["query", "need", "bin", "n"])
        counts = (cands.mapInArrow(histogram, "query long, need long, bin long, n long")
                  .groupBy("query", "need", "bin").agg(F.sum("n").alias("n")))
        order = Window.partitionBy("query").orderBy(F.col("bin").desc())
        located = (counts.withColumn("upto", F.sum("n").over(order))
                   .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
                   .select("query", "bin", (F.col("upto") - F.col("n")).alias("above")).collect())
        for r in located:
            i = r["query"]
            low[i] += r["bin"] * step[i]
            width[i] = min(step[i], width[i] - r["bin"] * step[i])
            need[i] -= r["above"]
        state.unpersist()
    final = sc.broadcast((low, np.where(small, np.int64(0), need), small))

    def select(batches):
        own, q = shared.value
        kth, ties, every = final.value
        held = [np.zeros(0, np.int64)] * n  # per query, the smallest ids tied at the k-th score
        for cid, s, real in _scored(batches, own, q):
            keep = real & ((s > kth[:, None]) | (every[:, None] & (s == kth[:, None])))
            at, col = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[at], cid[col], s[at, col])],
                                             names=["query_id", "vec_id", "score"])
            at, col = np.nonzero(real & ~every[:, None] & (s == kth[:, None]))
            for i in np.unique(at):
                held[i] = np.sort(np.concatenate([held[i], cid[col[at == i]]]))[:ties[i]]
        at = np.repeat(np.arange(n), [len(h) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[at], np.concatenate([*held, np.zeros(0, np.int64)]), kth[at])],
                                         names=["query_id", "vec_id", "score"])
    kept = cands.mapInArrow(select, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "topk")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
          scale: float = 1024.0, block: int = 1024, bins: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest integer inner
    products over all candidates but its own, ties to the smaller id."""
    spark = candidates.sparkSession
    cands = materialize(quantize(candidates, id_col, vector, scale), "candidates")
    asked = quantize(queries, id_col, vector, scale).groupBy("id").agg(F.min("q").alias("q"))
    asked = materialize(asked.withColumn("dim", F.size("q")), "queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in asked.groupBy("dim").count().orderBy("dim").collect():
        parts = math.ceil(2 * r["count"] / block) if r["count"] > block else 1
        for part in range(parts):
            some = asked.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "q")
            rows = some.orderBy("id").collect()
            for at in range(0, len(rows), block):
                mine = rows[at:at + block]
                matrix = np.array([x["q"] for x in mine], dtype=np.int64).reshape(len(mine), r["dim"])
                out = out.unionByName(_block_top(cands, np.array([x["id"] for x in mine], dtype=np.int64), matrix, k, bins))
    return out
