"""Byte-level BPE encoding and decoding.

A text falls apart into words by the vocabulary's split pattern and each word is merged on
its own: of all neighbours whose joint bytes are a token, those of least rank (the first such
place) become one, until none are left. A Python worker splits the texts, merges a word when
its task first meets it, and looks it up from then on. Long words are merged with a heap, so a run
of 100,000 equal bytes takes no square time. Nothing is shuffled or written.

``remember`` bounds the words a task keeps: beyond it the worker forgets all and goes on.

Decoding joins the pieces of the ids, an array literal of their bytes in hexadecimal.

Edge cases: null and empty texts have no id (empty array, decoded to no byte). Repeated rows,
repeated and null ids keep their own rows. Ids outside the vocabulary decode to no byte. An
empty table gives no rows. Columns beside the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WordIds

LONG_WORD = 100  # bytes


def read_ranks(path: str) -> dict[bytes, int]:
    """``token -> rank`` of a rank file (base64 token, blank, rank on every line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no token")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get, none = ranks.get, 1 << 62  # above any rank
    parts = [word[i:i + 1] for i in range(len(word))]
    allowed = [get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while allowed and (least := min(allowed)) < none:
        at = allowed.index(least)
        new = parts[at] = parts[at] + parts.pop(at + 1)
        del allowed[at]
        if at < len(allowed):
            allowed[at] = get(new + parts[at + 1], none)
        if at:
            allowed[at - 1] = get(parts[at - 1] + new, none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of (rank, begin, end): a token stands at its begin, ``ahead`` and ``back`` link the begins."""
    size = len(word)
    ahead, back = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i):
        """What the token at i and the one behind it allow."""
        if i >= 0 and ahead[i] < size:
            end = ahead[ahead[i]]
            if (rank := ranks.get(word[i:end])) is not None:
                heapq.heappush(heap, (rank, i, end))

    while heap:
        _, i, end = heapq.heappop(heap)
        second = ahead[i]
        if second < 0 or second >= size or ahead[second] != end:
            continue  # one of the two has been merged since
        ahead[i], ahead[second] = end, -1
        if end < size:
            back[end] = i
        offer(back[i])
        offer(i)
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i:ahead[i]]])
        i = ahead[i]
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text: str = "text",
           remember: int = 400_000, rows: int = 64) -> DataFrame:
    """``(id, ids)``: the token ids of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))

    def run(batches):
        import regex
        ranks, find = shared.value, regex.compile(pattern).findall
        known = WordIds(lambda word: merge_word(word.encode("utf-8"), ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                known.trim(remember)
                numbers = [np.fromiter(map(known.__getitem__, find(text.as_py() or "")), np.int64) for text in some.column(1)]
                ids, begin = known.ids_of(np.concatenate(numbers))
                ends = pa.array(begin[np.cumsum([0, *map(len, numbers)])], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], names=["id", "ids"])
    encoded = source.mapInArrow(run, source.select("id", F.array(F.lit(0)).alias("ids")).schema)
    return encoded.select(F.col("id").alias(id_col), "ids")


def decode(ids: Column, rank_file: str) -> Column:
    """The bytes that an array of ids stands for."""
    ranks = read_ranks(rank_file)
    pieces = [""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    held = F.split(F.lit(" ".join(pieces)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(held, i)), ""))


def digests(encoded: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """Of each encoded text: id, n_tokens, and SHA-256 of its ids in decimal and of the bytes decoded from them."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(decode(F.col("ids"), rank_file), 256).alias("decoded_sha256"))
