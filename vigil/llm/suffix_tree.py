"""Language-model scoring with a probabilistic suffix tree over words.

Training counts every word of every training text (Spark aggregate). A context of one to ``depth`` words
(newest first) is a node of the tree; a word that follows it ``floor`` (2) times and more is an
entry of it, whatever the size of the corpus, so the tree grows with the corpus. A
context stays only if its next-word distribution diverges from its parent's (the context
without its oldest word) by ``divergence`` nats (Kullback-Leibler).

Smoothing is absolute discounting: P(x|s) = (n(s,x) - d) / n(s) + rest(s) * P(x|parent of s), down
to the root P(x) = (c + 0.5) / (N + 0.5 (V + 1)), which makes each state's distribution sum to one.

The tree is never in one place. Every token of the training texts and of the texts to score is a window:
the word and the ``depth`` words before it. Windows are dealt once, by their newest context word, so a
task has all contexts that end in its words, counts its branches of the tree from the windows of the training
texts, and scores all windows. Only sums per text go back. Windows of a context followed more than
``crowd`` times in training are dealt by one context word more. How often its words follow it is counted before, one row
per distinct (context, word) of a block of texts: the counts go back to the blocks (by a broadcast if they are few), and what all its words leave to
the parent is summed by Spark (at most N / crowd rows).

The words of probability ``dictionary`` and more (at most 1/dictionary) are numbered by a broadcast, all
others by a join, one row per word of a block of texts. Words met less than ``floor`` times in training
can't be in the tree; as contexts they leave the root, which such tokens are scored by at once.

Text is lower-cased (A-Z), words are runs without ASCII blanks, and an end symbol closes
each text; it is also the context of the first word, and no context goes beyond it.

Edge cases: null text counts as empty (one token, the end). Repeated rows and repeated or
null ids each keep their own row. Without training rows every token has the root's single
class (log10 1 = 0). An empty table gives no rows. Long texts are scored whole; a block of texts holds
up to 2.5 million tokens, or one longer text. A block has a row in most buckets of windows, so their number is a product, which
large blocks and buckets keep small.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vigil.llm.common import discard, materialize, materialize_at, share

END = b""  # no word is empty
ONCE = -2  # number of a word met in training, but less than ``floor`` times; -1: never met
UNIT = float(1 << 24)  # parts of a text's sum are whole numbers of 1 / UNIT
PAIRS = 2_000_000  # answers for (context, word) of blocks that are broadcast; more are joined with the blocks
GATHERED = 5_000_000  # tokens of a corpus small enough for ``Model.token_scores``


@dataclass
class Model:
    """Dictionary (the end symbol, then most frequent first), root counts, and the training texts the tree is counted from."""
    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    least: int                   # every word counted this often is in the dictionary
    floor: int
    depth: int
    discount: float
    divergence: float
    crowd: int
    texts: DataFrame | None      # of one column
    gathered: list[np.ndarray] | None = None

    def root(self, counts) -> np.ndarray:
        return np.log10((np.asarray(counts) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def token_scores(self, flat: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 probability of flat[1:] by the longest retained suffix; ``flat`` holds word
        numbers (-1: not in the dictionary), texts closed by 0 (end), and starts with 0.
        A token outside the dictionary gets the factor before its root term only. This gathers the training
        texts, so it is for small corpora with all words in the dictionary; ``score`` is for any."""
        if self.total > GATHERED:
            raise ValueError("the training texts are too many to gather")
        if self.gathered is None:
            index = {w: i for i, w in enumerate(self.words)}
            words = [w for r in self.texts.collect() for w in [*tokens(r[0]), END]]
            ids = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
            self.gathered = [ids, *_contexts(ids, self.depth)]
        x = np.asarray(flat[1:])
        ahead = [np.concatenate(c) for c in zip(self.gathered, [x, *_contexts(x, self.depth, int(flat[0]))])]
        old = self.gathered[0]
        start = np.concatenate([10.0 ** self.root(self.counts)[old] if len(old) else np.zeros(0), np.where(x >= 0, 10.0 ** np.asarray(root), 1.0)])
        learn = np.arange(len(start)) < len(old)
        return np.log10(probabilities(self, ahead[0], ahead[1:], learn, start)[len(old):])


def tokens(text) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts(body)`` -> ``(word, c)`` over all texts, the end symbol included."""
    def run(batches, limit=300_000):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "c"])
        for batch in batches:
            counts[END] += batch.num_rows
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > limit:
                    yield flush()
                    counts.clear()
        yield flush()
    return texts.mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, vocabulary: DataFrame, dictionary: float = 1e-6, floor: int = 2, depth: int = 3,
          discount: float = 0.5, divergence: float = 0.02, crowd: int = 2_000_000) -> Model:
    """``texts(body)`` and their materialised ``word_counts`` -> the model: its dictionary and root here,
    its tree counted where ``score`` needs it."""
    sums = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total, distinct = sums[0] or 0, sums[1]
    least = max(1, int(np.ceil(dictionary * total)))
    top = vocabulary.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toPandas()
    top["end"] = [w == END for w in top["word"]]
    top = top.sort_values(["end", "c", "word"], ascending=[False, False, True])  # the end symbol is number 0
    return Model([bytes(w) for w in top["word"]], top["c"].to_numpy(dtype=np.int64), total, distinct, least, max(2, floor), depth,
                 discount, divergence, crowd, texts)


def _contexts(ids: np.ndarray, depth: int, front: int = 0) -> list[np.ndarray]:
    """The word before each word, the one before that, ...; -1 behind an end symbol or a word that has no number."""
    before = np.concatenate([[front], ids[:-1]]).astype(ids.dtype) if len(ids) else ids
    out = [np.where(before >= 0, before, -1)]
    for k in range(1, depth):
        older = np.concatenate([np.full(min(k, len(ids)), -1, ids.dtype), before[:-k]])
        out.append(np.where((out[-1] > 0) & (older >= 0), older, -1))
    return out


def _hash(columns) -> np.ndarray:
    """One number of 64 bits for each row of whole numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _groups(major: np.ndarray, minor: np.ndarray):
    """Of each pair its number, and of each number a row that has it."""
    key = major.astype(np.int64)
    key <<= 32
    key |= minor + 2
    order = np.argsort(key, kind="stable")
    key, new = key[order], np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return number, order[new]


def _entries(model: Model, number: np.ndarray, at: np.ndarray, x: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """How often each (context, word) was met in training; 0 where that is less than the floor."""
    n = np.bincount(number, weights=learn, minlength=len(at))
    return np.where((n >= model.floor) & (x[at] >= 0), n, 0.0)


def _stays(model: Model, inside, parent_inside, gain):
    """Whether the divergence of contexts from their parents, with all other words as one class, is large enough."""
    out, parent_out = np.clip(1 - inside, 1e-12, 1), np.clip(1 - parent_inside, 1e-12, 1)
    return (inside > 0) & (gain + out * np.log(out / parent_out) >= model.divergence)


def probabilities(model: Model, x: np.ndarray, contexts: list[np.ndarray], learn: np.ndarray, start: np.ndarray, level: int = 0) -> np.ndarray:
    """P(x | contexts) of windows that hold all training windows of their contexts from ``level`` on;
    ``learn`` tells these, ``start`` is the probability by the contexts before."""
    prob = start.copy()
    live = np.flatnonzero(contexts[level] >= 0)
    group = np.zeros(len(live), np.int64)
    for k in range(level):
        group, _ = _groups(group, contexts[k][live])
    for k in range(level, len(contexts)):
        if not len(live):
            break
        group, _ = _groups(group, contexts[k][live])
        word, flag = x[live], learn[live]
        size = np.bincount(group, weights=flag)
        number, at = _groups(group, word)
        n, of = _entries(model, number, at, word, flag), group[at]
        some = n > 0
        p = n[some] / size[of[some]]
        parent = prob[live[at[some]]]

        def total(values, of=of[some], count=len(size)):
            return np.bincount(of, weights=values, minlength=count)
        stays = _stays(model, total(p), total(parent), total(p * np.log(p / parent)))
        taken = np.zeros(len(n))
        taken[some] = (n[some] - model.discount) / size[of[some]]
        rest = 1 - np.bincount(of, weights=taken, minlength=len(size))
        prob[live] = np.where(stays[group], taken[number] + rest[group] * prob[live], prob[live])
        if k + 1 < len(contexts):
            on = (size[group] >= model.floor) & (contexts[k + 1][live] >= 0)  # a longer context is met no more often
            live, group = live[on], group[on]
    return prob


def _chunks(context: np.ndarray, held: np.ndarray, size: int = 200_000):
    """The rows that are held, by about so many at a time or all of one context word: no context is in two."""
    order = np.flatnonzero(held)
    order = order[np.argsort(context[order], kind="stable")]
    ends, begin = np.append(np.flatnonzero(np.diff(context[order])) + 1, len(order)), 0
    while begin < len(order):
        end = ends[min(np.searchsorted(ends, begin + size), len(ends) - 1)]
        yield order[begin:end]
        begin = end


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, their bytes by place, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, "<i4").reshape(-1, 1).view(np.uint8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _array(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(size)


def _parts(rows: np.ndarray, sums: np.ndarray) -> tuple[bytes, bytes]:
    """Rows in order, by their steps, and a sum for each in units of 2 ** -24: a text has a part in most buckets, so
    there are nearly as many as windows."""
    whole = np.rint(sums * UNIT).astype(np.int64)
    low, high = (whole & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (whole >> 32).astype(np.int32)
    return _bytes(np.diff(rows, prepend=0)), _bytes(np.concatenate([low, high]))


def _added(n: int, rows: bytes, sums: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The rows and sums of ``_parts``."""
    low, high = _array(sums, 2 * n).reshape(2, n)
    return np.cumsum(_array(rows, n)), ((high.astype(np.int64) << 32) + low.view(np.uint32)) / UNIT


def _one(value) -> pa.ListArray:
    """One row that holds all values of an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)


def _row(values: list, fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])


def _zipped(words: list[bytes]) -> bytes:
    data = b" ".join(words)  # no word has a blank
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _words(data: bytes) -> list[bytes]:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True).split(b" ")


def _shelves(words: list[bytes], shelves: int):
    """Places of the words by shelf (a hash), then in order; and (shelf, from, to) of these places."""
    shelf = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shelves
    order = np.array(sorted(range(len(words)), key=list(zip(shelf.tolist(), words)).__getitem__), np.int64)
    shelf = shelf[order]
    first = np.flatnonzero(np.diff(shelf, prepend=-1))
    return order, list(zip(shelf[first].tolist(), first.tolist(), [*first[1:].tolist(), len(words)]))


BLOCK = "block long, n long, kept long, learn binary, size binary, token binary, rare array<struct<shelf: long, n: long, words: binary>>"


def _blocks(docs: DataFrame, carried: int, shared, shelves: int, limit: int = 2_500_000) -> DataFrame:
    """``docs`` (carried columns, learn, body) -> blocks of texts: word numbers, other words (``rare``) by their
    place in the block, and the carried columns as arrays."""
    schema = StructType.fromDDL(BLOCK)
    for k, f in enumerate(docs.schema.fields[:carried]):
        schema = schema.add(f"c{k}", ArrayType(f.dataType))

    def run(batches):
        index = {w: i for i, w in enumerate(pickle.loads(shared.value).words)}
        block, held, numbers, rare, size = TaskContext.get().partitionId() << 33, [], [], {}, 0

        class Numbers(dict):
            def __missing__(self, word):
                return -1 - rare.setdefault(word, len(rare))
        find = Numbers(index).__getitem__

        def close():
            table, words = pa.Table.from_batches(held), list(rare)
            sizes, flat = np.array([len(t) for t in numbers]), np.concatenate(numbers)
            order, parts = _shelves(words, shelves)
            place = np.empty(len(words) + 1, np.int32)
            place[order] = np.arange(len(words))
            flat = np.where(flat < 0, -1 - place[np.where(flat < 0, -1 - flat, len(words))], flat)
            words = [words[i] for i in order.tolist()]
            columns = [pa.array([v], t) for v, t in (
                (block, pa.int64()), (len(flat), pa.int64()), (len(sizes), pa.int64()),
                (_bytes(table.column(carried).to_numpy().astype(np.int32)), pa.binary()), (_bytes(sizes), pa.binary()), (_bytes(flat), pa.binary()))]
            columns += [_one(c) for c in (
                pa.StructArray.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([b - a for _, a, b in parts], pa.int64()),
                                            pa.array([_zipped(words[a:b]) for _, a, b in parts], pa.binary())], names=["shelf", "n", "words"]),
                *[table.column(k).combine_chunks() for k in range(carried)])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = 0
                for r, text in enumerate(part.column(carried + 1)):
                    words = [*tokens(text.as_py()), END]
                    if numbers and size + len(words) > limit:
                        if r > cut:
                            held.append(part.slice(cut, r - cut))
                        yield close()
                        block, cut, size = block + 1, r, 0
                        held.clear(), numbers.clear(), rare.clear()
                    numbers.append(np.fromiter(map(find, words), np.int32, len(words)))
                    size += len(words)
                held.append(part.slice(cut))
        if numbers:
            yield close()
    return docs.mapInArrow(run, schema)


def _answers(blocks: DataFrame, vocabulary: DataFrame, model: Model, shelves: int) -> DataFrame:
    """Counts and numbers of the blocks' other words, ``(block, found)``: they and the words outside the dictionary are dealt by shelf,
    where the latter are numbered in order."""
    fields = [("shelf", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())]
    ddl = "shelf long, block long, n long, words binary, numbers binary"
    floor, behind = model.floor, len(model.words)

    def put(batches, limit=300_000):
        held, size = [], 0

        def close():
            words, c = (pa.chunked_array([b.column(k) for b in held]) for k in range(2))
            words, c = words.to_pylist(), c.to_numpy()
            order, parts = _shelves(words, shelves)
            for shelf, a, b in parts:
                yield _row([shelf, -1, b - a, _zipped([words[i] for i in order[a:b].tolist()]), _bytes(c[order[a:b]])], fields)
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                yield from close()
                held, size = [], 0
        if size:
            yield from close()
    asked = blocks.select("block", F.inline("rare")).select("shelf", "block", "n", "words", F.lit(None).cast("binary").alias("numbers"))
    other = vocabulary.where((F.col("c") < model.least) & (F.col("word") != F.lit(END))).select("word", F.col("c").cast("int"))
    dealt = other.mapInArrow(put, ddl).unionByName(asked).repartition(shelves, "shelf").sortWithinPartitions("shelf", "block")

    def answer(batches):
        now, held, index, values = None, {}, None, None
        for batch in batches:
            for shelf, block, n, words, numbers in zip(*[batch.column(k) for k in range(5)]):
                shelf, block, n, words = shelf.as_py(), block.as_py(), n.as_py(), _words(words.as_py())
                if shelf != now:
                    now, held, index = shelf, {}, None
                if block < 0:
                    held.update(zip(words, _array(numbers.as_py(), n).tolist()))
                    continue
                if index is None:
                    names = sorted(held)
                    index = dict(zip(names, range(1, len(names) + 1)))
                    c = np.array([0, *map(held.__getitem__, names)])
                    number = np.where(c >= floor, behind + shelf + shelves * np.arange(len(c)), ONCE)
                    values, held = np.stack([c, np.where(c > 0, number, -1)]), {}
                at = np.fromiter(map(index.get, words, repeat(0)), np.int64, n)
                yield _row([shelf, block, n, None, _bytes(values[:, at])], fields)
    return dealt.mapInArrow(answer, ddl).groupBy("block").agg(F.collect_list(F.struct("shelf", "n", "numbers")).alias("found"))


# Windows stand in a table: word, contexts, 2 * text + learned, and last a word's count where it is outside the dictionary, or
# the bits of the probability by the crowded contexts.
def _windows(m: Model, column: dict, r: int):
    """A block's windows and (counts of the words outside the dictionary, which words have a window, first words of the texts): words
    whose context is not in the tree have none."""
    n, rows = (column[c][r].as_py() for c in ("n", "kept"))
    token, size, learn = (_array(column[c][r].as_py(), k) for c, k in (("token", n), ("size", rows), ("learn", rows)))
    found = sorted(column["found"][r].as_py() or [], key=lambda f: f["shelf"])
    times, number = np.concatenate([*[_array(f["numbers"], 2 * f["n"]).reshape(2, f["n"]) for f in found], np.array([[0], [-1]], np.int32)], axis=1)
    rare = np.flatnonzero(token < 0)
    ids, c = token.copy(), np.zeros(n, np.int32)
    ids[rare], c[rare] = number[-1 - token[rare]], times[-1 - token[rare]]
    del rare, times, number
    contexts = _contexts(ids, m.depth)
    held = contexts[0] >= 0
    table = np.empty((m.depth + 3, int(held.sum())), np.int32)
    for k in range(m.depth, 0, -1):
        np.compress(held, contexts.pop(), out=table[k])
    np.compress(held, np.maximum(ids, -1, out=ids), out=table[0])
    del ids
    np.compress(held, np.repeat(2 * np.arange(rows, dtype=np.int32) + learn, size), out=table[-2])
    np.compress(held, c, out=table[-1])
    return table, token, c, held, size


def _told(m: Model, token: np.ndarray, c: np.ndarray, held: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Sizes and known words of a block's texts, and their sums by the root: of all words, and of those without a window."""
    inside, first = token >= 0, np.cumsum(size) - size
    base = np.empty(len(token))
    base[inside], base[~inside] = m.root(m.counts)[token[inside]], m.root(c[~inside])
    known = np.add.reduceat(inside | (c > 0), first, dtype=np.int64)
    total = np.add.reduceat(base, first)
    base[held] = 0.0
    return _bytes(np.concatenate([size, known])), np.stack([total, np.add.reduceat(base, first)])


@dataclass
class Crowd:
    """Contexts of one level that are followed too often for one task: how often, and once summed what they leave to the parent."""
    hashes: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    stays: np.ndarray | None = None
    rests: np.ndarray | None = None
    met: dict | None = None  # by block, where they are few

    def find(self, columns) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(columns[0]), -1)
        h = _hash(columns)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _crowd(contexts: list[tuple], sizes: list[float], level: int) -> Crowd:
    """The contexts by hash."""
    words = np.array(contexts, np.int64).reshape(len(contexts), level)
    h = _hash(words.T)
    order = np.argsort(h)
    return Crowd(h[order], words[order], np.array(sizes, np.float64)[order])


def _inside(m: Model, crowd: Crowd, level: int, table: np.ndarray, live: np.ndarray):
    """The windows that are in crowded contexts of a level: their rows and contexts; and the distinct (context, word) of those
    that can be entries, dealt by a hash: which windows these are, and the number of each one's pair."""
    at = crowd.find([c[live] for c in table[1:1 + level]])
    live, at = live[at >= 0], at[at >= 0]
    word = np.flatnonzero(table[0, live] >= 0)
    pairs, number = np.unique(at[word] << 32 | table[0, live[word]], return_inverse=True)
    return live, at, word, pairs, number


def _dealt(pairs: np.ndarray, buckets: int):
    """Places of the pairs by bucket, and (bucket, from, to) of these places."""
    bucket = (_hash([pairs]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if a < b]


def _climbed(m: Model, crowds: list[Crowd], buckets: list[int], table: np.ndarray, column: dict, r: int):
    """How many context words of each window are a crowded context, and its probability by these (by the root, at the last level
    that is not yet answered)."""
    passed, prob = np.zeros(table.shape[1], np.int8), None
    live = np.flatnonzero(table[1] <= len(crowds[0].hashes)) if crowds else []  # by number the most frequent words come first, behind the end
    for level, (crowd, parts) in enumerate(zip(crowds, buckets), 1):
        live, at, word, pairs, number = _inside(m, crowd, level, table, live)
        if prob is None:
            prob, x = np.zeros(table.shape[1]), table[0, live]
            inside = (x >= 0) & (x < len(m.words))
            prob[live] = 10.0 ** m.root(np.where(inside, m.counts[np.where(inside, x, 0)], table[-1, live]))
        found = crowd.met.get(column["block"][r].as_py()) if crowd.met is not None else column[f"met{level}"][r].as_py()
        found = sorted(found or [], key=lambda f: f["bucket"])
        met, order = np.zeros(len(pairs)), _dealt(pairs, parts)[0]
        if found:
            met[order] = np.concatenate([_array(f["data"], f["n"]) for f in found])
        taken = np.zeros(len(live))
        taken[word] = (np.where(met > 0, met - m.discount, 0.0)[number]) / crowd.sizes[at[word]]
        passed[live] = level
        prob[live] = np.where(crowd.stays[at], taken + crowd.rests[at] * prob[live], prob[live])
    return passed, prob, live


MET = "kind int, bucket long, block long, n long, data binary, parts array<double>"


def _met(rows: DataFrame, model: Model, shared, crowds: list[Crowd], parts: list[int]) -> DataFrame:
    """Of the windows in crowded contexts of the last level, kind 0: how often a block's distinct (context, word) were met in training,
    1: parts of the sums of a context, 2: a longer context that is crowded itself."""
    sent, level, buckets = share(rows.sparkSession, crowds), len(crowds), parts[-1]
    asked = [("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]

    def ask(batches):
        m, many = pickle.loads(shared.value), pickle.loads(sent.value)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for r in range(batch.num_rows):
                table = _windows(m, column, r)[0]
                _, prob, live = _climbed(m, many[:-1], parts, table, column, r)
                if prob is None:
                    live = np.flatnonzero(table[1] <= len(many[-1].hashes))
                live, _, word, pairs, number = _inside(m, many[-1], level, table, live)
                lead = np.empty(len(pairs), np.int64)
                lead[number] = live[word]
                if prob is None:
                    x = table[0, lead]
                    start = 10.0 ** m.root(np.where(x < len(m.words), m.counts[np.minimum(x, len(m.words) - 1)], table[-1, lead]))
                else:
                    start = prob[lead]
                n = np.bincount(number, weights=table[-2, live[word]] & 1, minlength=len(pairs))
                order, dealt = _dealt(pairs, buckets)
                data = np.stack([v[order] for v in (
                    (pairs >> 32).astype(np.int32), pairs.astype(np.int32), n.astype(np.int32), start.astype(np.float32).view(np.int32))])
                for bucket, a, b in dealt:
                    yield _row([bucket, column["block"][r].as_py(), b - a, _bytes(data[:, a:b])], asked)
    rows = rows.mapInArrow(ask, "bucket long, block long, n long, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def answer(batches):
        m, crowd = pickle.loads(shared.value), pickle.loads(sent.value)[-1]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=[c.split()[0] for c in MET.split(", ")])

        def close(bucket, blocks, tables):
            at, x, n, start = np.concatenate(tables, axis=1)
            number, lead = _groups(at, x)
            n = np.bincount(number, weights=n, minlength=len(lead))
            n = np.where(n >= m.floor, n, 0.0)
            found, end = [], 0
            for block, piece in zip(blocks, tables):
                begin, end = end, end + piece.shape[1]
                found.append([0, bucket, block, end - begin, _bytes(n[number[begin:end]].astype(np.int32)), None])
            yield out(found)
            times, lead = n[n > 0], lead[n > 0]
            of, word, parent = at[lead], x[lead], start[lead].view(np.float32).astype(np.float64)
            seen, which = np.unique(of, return_inverse=True)
            p = times / crowd.sizes[of]
            sums = [np.bincount(which, weights=v, minlength=len(seen)).tolist() for v in (
                (times - m.discount) / crowd.sizes[of], p, parent, p * np.log(p / parent))]
            found = [[1, int(i), None, None, None, list(v)] for i, *v in zip(seen, *sums)]
            more = (times >= m.crowd) & (word > 0) if level < m.depth else np.zeros(len(times), bool)
            found += [[2, int(i), int(w), None, None, [float(k)]] for i, w, k in zip(of[more], word[more], times[more])]
            if found:
                yield out(found)
        now, blocks, tables = None, [], []
        for batch in batches:
            for bucket, block, n, data in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if bucket != now and tables:
                    yield from close(now, blocks, tables)
                    blocks, tables = [], []
                now = bucket
                blocks.append(block)
                tables.append(_array(data, 4 * n).reshape(4, n))
        if tables:
            yield from close(now, blocks, tables)
    return rows.mapInArrow(answer, MET)


def _sums(block: int, table: np.ndarray, prob: np.ndarray) -> list:
    rows, number = np.unique(table[-2] >> 1, return_inverse=True)
    return [block, 0, len(rows), *_parts(rows, np.bincount(number, weights=np.log10(prob)))]


SOLVED = "block long, kind int, n long, data binary, sums binary"


def _solved(rows: DataFrame, model: Model, shared, crowds: list[Crowd], parts: list[int], levels: list[int]) -> DataFrame:
    """Kind 0: sums of texts, 4: what is told of texts before their windows are dealt. ``levels``: in how many buckets windows are that
    are in no crowded context, in one of one word, ..."""
    sent, depth = share(rows.sparkSession, crowds), model.depth
    columns, buckets, begins = depth + 3, sum(levels), np.cumsum([0, *levels])
    dealt = [("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("sums", pa.binary())]

    def route(batches):
        m, many = pickle.loads(shared.value), pickle.loads(sent.value)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for r in range(batch.num_rows):
                block = column["block"][r].as_py()
                table, *words = _windows(m, column, r)
                data, sums = _told(m, *words) if block >= 0 else (None, None)
                del words
                bucket = np.full(table.shape[1], -1, np.int32)
                passed, prob, _ = _climbed(m, many, parts, table, column, r)
                for level in range(1 + len(many)):
                    of = np.flatnonzero(passed == level) if many else slice(None)
                    if level:
                        table[-1, of] = prob[of].astype(np.float32).view(np.int32)
                        done = table[1 + level, of] < 0 if level < depth else np.ones(len(of), bool)  # no longer context
                        if block >= 0:
                            sums[1] += np.bincount(table[-2, of[done]] >> 1, weights=np.log10(prob[of[done]]), minlength=sums.shape[1])
                        of = of[~done]
                    if level < depth:
                        bucket[of] = begins[level] + (_hash(table[1:2 + level, of]) % np.uint64(levels[level])).astype(np.int32)
                del passed, prob
                if block >= 0:
                    yield _row([block % buckets, block, sums.shape[1], data, sums.astype("<f8").tobytes()], dealt)
                order = _side_by_side(bucket, table[1], table[2] if depth > 1 else table[1])
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                held, size = [], 0
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    if a < b:
                        held.append([k, block, b - a, _bytes(table[:, order[a:b]]), None])
                        size += len(held[-1][3])
                    if held and (size > 1 << 20 or k + 1 == buckets):
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*held), dealt)], names=[n for n, _ in dealt])
                        held, size = [], 0
    rows = rows.mapInArrow(route, "bucket long, block long, n long, data binary, sums binary").repartition(
        buckets, "bucket").sortWithinPartitions("bucket")

    def solve(batches):
        m = pickle.loads(shared.value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], names=[c.split()[0] for c in SOLVED.split(", ")])

        def solved(bucket, blocks, sizes, tables):
            level = int(np.searchsorted(begins, bucket, "right")) - 1
            ends = np.cumsum(sizes).tolist()
            table = np.empty((columns, ends[-1]), np.int32)
            for data, size, end in zip(tables, sizes, ends):
                table[:, end - size:end] = _array(data, columns * size).reshape(columns, size)
            tables.clear()
            x, contexts, prob = table[0], list(table[1:1 + depth]), np.ones(table.shape[1])
            for rows in _chunks(contexts[level], np.ones(len(x), bool)):
                if level:
                    start = table[-1, rows].view(np.float32).astype(np.float64)
                else:
                    inside = (x[rows] >= 0) & (x[rows] < len(m.words))
                    start = 10.0 ** m.root(np.where(inside, m.counts[np.where(inside, x[rows], 0)], table[-1, rows]) if len(m.counts) else table[-1, rows])
                prob[rows] = probabilities(m, x[rows], [c[rows] for c in contexts], (table[-2, rows] & 1).astype(bool), start, level)
            found = [_sums(block, table[:, end - size:end], prob[end - size:end]) for block, size, end in zip(blocks, sizes, ends) if block >= 0]
            if found:
                yield out(found)
        now, blocks, sizes, tables = None, [], [], []
        for batch in batches:
            for b, block, n, data, sums in zip(*[batch.column(k) for k in range(5)]):
                b, block, n, data = b.as_py(), block.as_py(), n.as_py(), data.as_py()
                if sums.is_valid:
                    yield out([[block, 4, n, data, sums.as_py()]])
                    continue
                if b != now and tables:
                    yield from solved(now, blocks, sizes, tables)
                    blocks, sizes, tables = [], [], []
                now = b
                blocks.append(block)
                sizes.append(n)
                tables.append(data)
        if tables:
            yield from solved(now, blocks, sizes, tables)
    return rows.mapInArrow(solve, SOLVED)


def _side_by_side(bucket: np.ndarray, newest: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Rows by bucket; in one, equal contexts side by side, which compress best."""
    free = 62 - int(bucket.max(initial=0) + 1).bit_length()
    low, key = free // 2, bucket.astype(np.int64)
    key += 1
    for width, v in ((free - low, newest), (low, older)):
        key <<= width
        key |= v & ((1 << width) - 1)
    return np.argsort(key, kind="stable")


def _tree_sums(rows: DataFrame, paths: list[str], total: int, model: Model, shared, per_task: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """``(block, n, data, sums)`` twice: what is told of the texts, and log10 probabilities summed per text, in any number of parts.
    ``rows`` are read from ``paths``, which no one else reads."""
    crowds, parts, levels = [], [], []
    often = np.flatnonzero(model.counts >= model.crowd)
    crowd = _crowd([(int(i),) for i in often], model.counts[often].tolist(), 1)
    left, joined = 1.0, False
    while len(crowd.hashes):
        part = min(left, crowd.sizes.sum() / model.total)  # of the windows
        levels.append(1 + int(total * (left - part)) // per_task)
        left = part
        crowds.append(crowd)
        parts.append(1 + int(total * part) // (2 * per_task))
        met = materialize(_met(rows, model, shared, crowds, parts), f"suffix-met-{len(crowds)}")
        crowd.stays, crowd.rests = np.zeros(len(crowd.hashes), bool), np.ones(len(crowd.hashes))
        sums = met.where("kind = 1").groupBy("bucket").agg(*[F.sum(F.col("parts")[k]).alias(f"s{k}") for k in range(4)])
        for at, spent, inside, parent_inside, gain in sums.collect():
            crowd.stays[at], crowd.rests[at] = _stays(model, inside, parent_inside, gain), 1 - spent
        answers = met.where("kind = 0").select("block", "bucket", "n", "data")
        if (answers.agg(F.sum("n")).first()[0] or 0) <= PAIRS:
            crowd.met = {}
            for r in answers.collect():
                crowd.met.setdefault(r["block"], []).append(r.asDict())
        else:
            listed = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "data")).alias(f"met{len(crowds)}"))
            rows, joined = rows.join(listed, "block", "left"), True
        longer = met.where("kind = 2").select("bucket", "block", F.col("parts")[0]).collect()
        if len(crowds) == model.depth:
            break
        crowd = _crowd([(x, *crowd.words[at].tolist()) for at, x, _ in longer], [n for *_, n in longer], len(crowds) + 1)
    if len(crowds) < model.depth:
        levels.append(1 + int(total * left) // per_task)
    if joined:  # written, as the shuffle files of the join would stay beside those of the windows
        answered, path = materialize_at(rows, "suffix-answered")
        discard(rows.sparkSession, *paths)
        rows, paths = answered, [path]
    solved = materialize(_solved(rows, model, shared, crowds, parts, levels), "suffix-sums")
    discard(rows.sparkSession, *paths)
    return tuple(solved.where(f"kind = {kind}").select("block", "n", "data", "sums") for kind in (4, 0))


def score(docs: DataFrame, vocabulary: DataFrame, model: Model, text: str = "text", learned: Column | None = None) -> DataFrame:
    """``docs`` (without the text) plus n_tokens, n_known, train_tokens, base_score, score; a column
    of ``docs`` with one of these names gives way to the result. ``learned`` says which rows of ``docs``
    are the training texts, where these are among them: they are dealt once then."""
    spark = docs.sparkSession
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    carried = [c for c in docs.columns if c != text and c.lower() not in results]
    shared = share(spark, replace(model, texts=None, gathered=None))
    learn = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], learn.alias("learn"), F.col(f"`{text}`").alias("body"))
    shelves = 1 + model.distinct // 200_000

    whole, paths = [f"c{k}" for k in range(len(carried))], []

    def prepared(rows, columns):
        blocks, path = materialize_at(_blocks(rows, len(columns), shared, shelves), "suffix-blocks")
        kept = materialize(blocks.select("block", *columns), "suffix-rows")
        tokens_of = blocks.select("block", "n", "kept", "learn", "size", "token")
        known, numbered = materialize_at(tokens_of.join(_answers(blocks, vocabulary, model, shelves), "block", "left"), "suffix-numbers")
        discard(spark, path)
        paths.append(numbered)
        return kept, known
    kept, known = prepared(rows, whole)
    if learned is None:  # blocks that are only learned from have numbers below 0
        own = prepared(model.texts.select(F.lit(True).alias("learn"), F.col(model.texts.columns[0]).alias("body")), [])[1]
        known = known.unionByName(own.withColumn("block", -1 - F.col("block")))
    told, sums = _tree_sums(known, paths, known.agg(F.sum("n")).first()[0] or 0, model, shared)
    texts = kept.join(told, "block").withColumn("part", F.lit(0))
    for f in texts.select(*whole).schema:
        sums = sums.withColumn(f.name, F.lit(None).cast(f.dataType))
    joined = texts.unionByName(sums.withColumn("part", F.lit(1))).repartition("block").sortWithinPartitions("block", "part")
    schema = rows.select(*whole).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches):
        now = None

        def close():
            return pa.RecordBatch.from_arrays([*now[0], *map(pa.array, now[1:])], names=schema.names)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for r in range(batch.num_rows):
                n, data, sums = (column[c][r].as_py() for c in ("n", "data", "sums"))
                if column["part"][r].as_py():
                    rows, parts = _added(n, data, sums)
                    now[-1][rows] += parts
                    continue
                if now:
                    yield close()
                size, known = _array(data, 2 * n).reshape(2, n).astype(np.int64)
                now = [[column[c][r].values for c in whole], size, known, *np.frombuffer(sums, "<f8").reshape(2, n).copy()]
        if now:
            yield close()
    return joined.mapInArrow(run, schema).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
