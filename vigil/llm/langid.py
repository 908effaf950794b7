"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from a fixed seed). An n-gram's
vector binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a
text's vector bundles (adds) its n-grams' vectors. A language's prototype is the bundle
of its training texts, and a text goes to the prototype with the highest cosine.

Letters are lower-cased; runs of anything else are one blank, also at both ends. ``a-z``
and the blank have item vectors of their own, other letters share ``OTHERS`` by code
point, so the item memory is small and fixed. Sums are integers: results do not depend
on the order of rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text
when nothing was learned (no labelled row, empty table); equal cosines go to the smaller
language name. A training row with null text or language is skipped. Repeated rows count
each time in training. Long texts are bundled whole, in bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHERS = 37
ITEMS = 27 + OTHERS
PLANE = 0x30000  # letters beyond are mapped by their remainder


def _letter_items() -> np.ndarray:
    """Code point -> item: 0 for what is no letter, else 1 to ITEMS - 1."""
    table = np.zeros(PLANE, dtype=np.uint8)
    for point in range(PLANE):
        if chr(point).isalpha():
            table[point] = point - 96 if 97 <= point <= 122 else 27 + point % OTHERS
    return table


class Encoder:
    """Text -> bundled vector of ``dims`` dimensions from letter trigrams."""

    def __init__(self, dims: int, seed: int):
        items = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (ITEMS, dims))
        first, second = np.roll(items, 2, axis=1), np.roll(items, 1, axis=1)
        self.pairs = (first[:, None, :] * second[None, :, :]).reshape(ITEMS * ITEMS, dims)
        self.last, self.dims, self.letters = items, dims, _letter_items()

    def grams(self, text: str) -> np.ndarray:
        """The text's trigram codes, repeats included; empty without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        items = self.letters[np.minimum(points, PLANE - 1)]
        if not items.any():
            return np.zeros(0, dtype=np.int64)
        items = np.concatenate([[0], items, [0]]).astype(np.int64)
        keep = np.ones(len(items), dtype=bool)
        keep[1:] = (items[1:] != 0) | (items[:-1] != 0)
        items = items[keep]
        return (items[:-2] * ITEMS + items[1:-1]) * ITEMS + items[2:]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims, dtype=np.float32 if len(grams) < 1 << 24 else np.float64)
        codes, counts = np.unique(grams, return_counts=True)
        for at in range(0, len(codes), 4096):
            code = codes[at:at + 4096]
            vectors = self.pairs[code // ITEMS] * self.last[code % ITEMS]
            total += counts[at:at + 4096].astype(total.dtype) @ vectors.astype(total.dtype)
        return total


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7) -> dict[str, list[int]]:
    """Language -> prototype (integers). Each task bundles its rows per language, so one
    row per task and language is shuffled however large a language is; the driver gets
    one vector per language."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("body")).where("lang is not null and body is not null")

    def run(batches):
        encoder, sums = Encoder(dims, seed), {}
        for batch in batches:
            mine: dict = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine.setdefault(name, []).append(encoder.grams(body.as_py()))
            for name, grams in mine.items():
                sums[name] = sums.get(name, 0) + np.rint(encoder.bundle(np.concatenate(grams))).astype(np.int64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, dims) if names else [], pa.string()), pa.array(np.tile(np.arange(dims), len(names)), pa.int32()),
             pa.array(np.concatenate([*sums.values(), np.zeros(0, np.int64)]), pa.int64())], names=["lang", "dim", "x"])
    parts = rows.mapInArrow(run, "lang string, dim int, x long").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    vectors = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: r["x"] for r in sorted(vectors, key=lambda r: r["lang"]) if any(r["x"])}


def predict(docs: DataFrame, prototypes: dict[str, list[int]], text: str = "text", dims: int = 1024, seed: int = 7,
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus the predicted language and its cosine (at least 0)."""
    names = list(prototypes)
    schema = docs.select("*", F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema
    matrix = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), dims)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        encoder, profiles = Encoder(dims, seed), shared.value
        for batch in batches:
            found, scores = [], []
            for body in batch.column(text):
                grams = encoder.grams(body.as_py() or "")
                vector = encoder.bundle(grams).astype(np.float64)
                norm = np.linalg.norm(vector)
                if not names or not len(grams) or norm == 0:
                    found.append("und")
                    scores.append(0.0)
                    continue
                cosines = profiles @ vector / norm
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, *out])
    return docs.mapInArrow(run, schema)
