"""Spelling variant grouping with frequency-vector tries.

Letters are dealt into groups of about equal weight and a word becomes its vector of letter-group
counts. One edit changes a vector little: an insertion adds one to one count (a surplus), a
deletion takes one away (a deficit), a replacement does both or nothing. A trie arranges words by
successive counts; a depth-first search follows a word's own counts and spends at most one
surplus and one deficit on the way. The words of the leaves it reaches are verified by their letters.

The trie is dealt over the cluster by its top: the length and the first ``TOP`` counts are a key.
Each word stands in the trie of its key and is sent, with what is left of the budget, to the
keys that its own can turn into (16 at most: to longer words, and to keys behind its own among those of its
length, so that two words meet once). Keys with more than ``shard_size`` words are cut into
shards by a hash of the word, and a question goes to every shard of its key: a task builds one
shard's trie at a time, however many words share a key.

``group_variants`` counts what is near each word, points each word at its dominant neighbour (its
form) and follows these pointers to the last (its root); each step grows the count by ``dominance``,
so a chain is short.

Edge cases: null and empty texts have no word; a null id counts as the empty text in the choice of
the letter that is left out. Repeated rows count again. Words of equal count: the smallest in code-point order is the form. An
empty table gives no rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize

RUN = "[A-Za-zÀ-ÿ]+"
GROUPS, TOP = 16, 4


def counted_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: str = RUN, drop_one_in: int = 31) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased. Where ``drop_one_in`` divides the CRC-32 h of
    ``id:run``, the run has lost its letter number h mod length."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("body"))

    def count(batches, limit=300_000):
        find, held = re.compile(run).findall, Counter()  # bytes.lower() changes A-Z only

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{id_}:".encode())
                for word, n in Counter(find((text.as_py() or "").encode("utf-8").lower().decode("utf-8"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) > limit:
                    yield flush()
                    held.clear()
        yield flush()
    return rows.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The alphabet in groups of about equal weight, the heaviest letters first. Only letters are collected."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    held = [["", 0] for _ in range(groups)]
    for r in sorted(found, key=lambda r: (-r["n"], r["c"])):
        least = min(held, key=lambda g: g[1])
        least[0] += r["c"]
        least[1] += r["n"]
    return [g for g, _ in held]


def with_vector(words: DataFrame, letters: list[str]) -> DataFrame:
    """Adds ``size``, ``counts`` (the letters a word has of each group of the key) and ``rest`` (of the others, as text)."""
    size = F.char_length("word")
    counts = [size - F.char_length(F.translate("word", g, "")) if g else F.lit(0) for g in letters]
    return words.select("word", "n", size.alias("size"), F.array(*counts[:TOP]).alias("counts"), F.concat_ws(",", *counts[TOP:]).alias("rest"))


def _key(size: Column, counts: list[Column]) -> Column:
    """The length and the counts modulo 64 as one number. A word's questions differ by two at most in a
    count, so they have keys of their own, and the words of a key are of one length."""
    key = size.cast("long")
    for c in counts:
        key = F.shiftleft(key, 6).bitwiseOR(c.cast("long").bitwiseAND(F.lit(63)))
    return key


def questions() -> Column:
    """Where a word's neighbours may stand: array of (key, surplus, deficit) with the budget left."""
    size, own = F.col("size"), [F.get("counts", F.lit(i)) for i in range(TOP)]

    def moved(longer, up=None, down=None):
        """The budget of a key ``longer`` by 0 or 1, with one more at ``up`` and one less at ``down``."""
        counts = [c + int(i == up) - int(i == down) for i, c in enumerate(own)]
        return F.struct(_key(size + longer, counts).alias("key"), F.lit(int(up is None)).alias("surplus"),
                        F.lit(int(not longer and down is None)).alias("deficit"))
    longer = [moved(1), *[moved(1, i) for i in range(TOP)]]
    same = [moved(0), *[moved(0, i) for i in range(TOP)], *[moved(0, i, j) for i in range(TOP) for j in range(i + 1, TOP)]]
    return F.array(*longer, *same)


def one_more(word: str, longer: str) -> bool:
    """Whether ``longer`` is ``word`` with one code point inserted."""
    i = 0
    for x, y in zip(word, longer):
        if x != y:
            break
        i += 1
    return word[i:] == longer[i + 1:]


def near_pairs(vectors: DataFrame, shard_size: int = 8192) -> DataFrame:
    """Written ``with_vector`` of distinct words -> ``(a, a_n, b, b_n)``, each near pair once."""
    placed = vectors.select(_key(F.col("size"), [F.get("counts", F.lit(i)) for i in range(TOP)]).alias("key"), "word", "n", "rest")
    keys = materialize(placed.groupBy("key").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards")), "trie-keys")
    asked = vectors.select(F.explode(questions()).alias("q"), "word", "n", "rest").select(
        "q.key", "word", "n", "rest", (F.col("q.surplus") + 2 * F.col("q.deficit")).cast("byte").alias("budget"))
    columns = ["key", "shard", "budget", "word", "n", "rest"]
    shard = F.pmod(F.xxhash64("word"), F.col("shards").cast("long")).cast("int")
    standing = placed.join(keys, "key").withColumn("shard", shard).withColumn("budget", F.lit(-1).cast("byte")).select(*columns)
    asking = asked.join(keys, "key").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*columns)
    dealt = standing.unionByName(asking).repartition("key", "shard").sortWithinPartitions("key", "shard", "budget")

    def run(batches):
        trie, last, numbers = {}, None, {}

        def reach(node, counts, level, surplus, deficit, out):
            """Adds to ``out`` the leaves under ``node`` whose counts differ by what is left of the budget,
            spent whole (a replacement within a group spends neither)."""
            while level < len(counts):
                c = counts[level]
                level += 1
                if surplus and c + 1 in node:
                    reach(node[c + 1], counts, level, 0, deficit, out)
                if deficit and c - 1 in node:
                    reach(node[c - 1], counts, level, surplus, 0, out)
                if c not in node:
                    return
                node = node[c]
            if surplus == deficit:
                out.append(node)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, places = [], [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            new = np.append(True, np.logical_or(*[p[1:] != p[:-1] for p in places]))
            new[0] = (int(places[0][0]), int(places[1][0])) != last
            last = int(places[0][-1]), int(places[1][-1])
            for other_trie, budget, word, n, rest in zip(new.tolist(), *[c.to_pylist() for c in batch.columns[2:]]):
                if other_trie:
                    trie, numbers = {}, {}
                counts = numbers.get(rest)
                if counts is None:
                    counts = numbers[rest] = [int(c) for c in rest.split(",")]
                if budget < 0:  # sorted first: the words that stand here
                    node = trie
                    for c in counts[:-1]:
                        node = node.setdefault(c, {})
                    node.setdefault(counts[-1], ([], {}, {}))[0].append((word, n))
                    continue
                leaves: list = []
                reach(trie, counts, 0, budget & 1, budget >> 1, leaves)
                size, own = len(word), budget == 3  # two words of one key ask for each other
                half = size // 2
                head, tail = word[:half], word[half:]
                for words, *halves in leaves:
                    longer = len(words[0][0]) - size  # all words of a leaf are of one length
                    behind = half + longer
                    if not (known := halves[longer]):  # one edit leaves a half as it is: words by either half
                        for pair in words:
                            known.setdefault((0, pair[0][:half]), []).append(pair)
                            known.setdefault((1, pair[0][behind:]), []).append(pair)
                    for other, m in known.get((0, head), ()):
                        if one_more(word, other) if longer else sum(map(ne, word, other)) == 1 and not (own and other < word):
                            found.append((word, n, other, m))
                    for other, m in known.get((1, tail), ()):
                        if other[:half] != head and (one_more(word, other) if longer else sum(map(ne, word, other)) == 1 and not (own and other < word)):
                            found.append((word, n, other, m))
            if found:
                a, a_n, b, b_n = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(a_n, pa.int64()), pa.array(b, pa.string()), pa.array(b_n, pa.int64())],
                                                 names=["a", "a_n", "b", "b_n"])
    return dealt.mapInArrow(run, "a string, a_n long, b string, b_n long")


def group_variants(words: DataFrame, dominance: int = 10, groups: int = GROUPS, shard_size: int = 8192) -> DataFrame:
    """``words(word, n)`` of distinct words -> word, form, root, n, n_near, form_n."""
    vectors = materialize(with_vector(words, letter_groups(words, groups)), "vectors")
    pairs = materialize(near_pairs(vectors, shard_size), "near-words")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top"))
    held = vectors.select("word", "n").join(best, "word", "left")
    formed = -F.col("top.m") >= dominance * F.col("n")
    table = materialize(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(formed, F.col("top.near")).alias("form"), F.when(formed, -F.col("top.m")).alias("form_n")), "forms")
    forms = table.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    roots = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a pointer's count grows tenfold a step
        onward = roots.join(forms, F.col("root") == F.col("at"), "left")
        roots = materialize(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return table.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
