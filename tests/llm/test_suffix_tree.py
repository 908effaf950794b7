"""The suffix tree against brute force: every context, whatever its share of the corpus."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import suffix_tree
from vigil.llm.common import CLEANUP, materialize


def brute_scores(training, texts, depth=3, floor=2, discount=0.5, divergence=0.02):
    """log10 probability of each text by a tree held in dictionaries."""
    def windows(text):
        seen = [""]
        for w in [*(text or "").lower().split(), ""]:
            contexts = [tuple(seen[:k]) for k in range(1, depth + 1) if len(seen) >= k and "" not in seen[:k - 1]]
            yield w, contexts
            seen = [w, *seen] if w else [""]
    counts, after = Counter(), defaultdict(Counter)
    for t in training:
        for w, contexts in windows(t):
            counts[w] += 1
            for c in contexts:
                after[c][w] += 1
    scale = sum(counts.values()) + 0.5 * (len(counts) + 1)
    kept = {}

    def prob(w, contexts):
        p = (counts[w] + 0.5) / scale
        for c in contexts:
            if c in kept:
                entries, rest = kept[c]
                p = entries.get(w, 0.0) + rest * p
        return p
    for c in sorted(after, key=len):
        size = sum(after[c].values())
        entries = {w: n for w, n in after[c].items() if n >= floor}
        if entries:
            parents = {w: prob(w, [c[:k] for k in range(1, len(c))]) for w in entries}
            inside, above = sum(entries.values()) / size, sum(parents.values())
            gain = sum(n / size * math.log(n / size / parents[w]) for w, n in entries.items())
            out, out_above = max(1 - inside, 1e-12), max(1 - above, 1e-12)
            if gain + out * math.log(out / out_above) >= divergence:
                shares = {w: (n - discount) / size for w, n in entries.items()}
                kept[c] = shares, 1 - sum(shares.values())
    return [sum(math.log10(prob(w, contexts)) for w, contexts in windows(t)) for t in texts], kept


def corpus():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(words[i:i + rng.randrange(1, 60)]) for i in range(0, 4000, 40)]
    return [*texts, None, "", "once more this line comes twice", "once more this line comes twice", "Never seen at all w1 w1 w2"]


@pytest.mark.parametrize("dictionary, crowd, together", [(1e-6, 1_000_000, True), (0.01, 1_000_000, False), (0.01, 20, True), (1e-6, 5, False)])
def test_scores_are_those_of_the_whole_tree(frame, dictionary, crowd, together):
    texts = corpus()
    docs = frame([(i, t, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    training = docs.where("learn").select(F.col("text").alias("body"))
    vocab = materialize(suffix_tree.word_counts(training), "v")
    model = suffix_tree.train(training, vocab, dictionary=dictionary, crowd=crowd)
    scored = suffix_tree.score(docs, vocab, model, learned=F.col("learn") if together else None)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    want, kept = brute_scores([t for i, t in enumerate(texts) if i % 5 != 1], texts)
    assert {len(c) for c in kept} == {1, 2, 3}
    assert len(got) == len(texts)
    assert all(abs(got[i] - s) < 1e-4 for i, s in enumerate(want)), max(abs(got[i] - s) for i, s in enumerate(want))


def test_the_tree_grows_with_the_corpus(frame):
    """A line that comes twice is known word by word, however long the rest of the corpus is."""
    rng = random.Random(3)
    filler = [" ".join(f"x{rng.randrange(50)}" for _ in range(2000)) for _ in range(300)]
    line = "a line that comes twice"
    docs = frame([(i, t) for i, t in enumerate([*filler, line, line, "a comes that twice line"])], "doc_id long, text string")
    training = docs.where(f"doc_id < {len(filler) + 2}").select(F.col("text").alias("body"))
    vocab = materialize(suffix_tree.word_counts(training), "v")
    rows = suffix_tree.score(docs.where(f"doc_id >= {len(filler)}"), vocab, suffix_tree.train(training, vocab)).collect()
    score = {r["doc_id"] - len(filler): r["score"] for r in rows}
    assert score[0] == score[1] > score[2] + 10


@pytest.mark.parametrize("pairs", [0, 1_000_000])
def test_windows_are_dealt_once(frame, monkeypatch, pairs):
    """A block has a row in a bucket at most, also of windows in crowded contexts, in many small buckets of each level."""
    written, materialized = Counter(), suffix_tree.materialize

    def counted(df, name):
        out = materialized(df, name)
        written["sums" if name.startswith("suffix-sums") else name] += out.count()
        return out
    texts, per_task = corpus(), 100
    monkeypatch.setattr(suffix_tree, "materialize", counted)
    monkeypatch.setattr(suffix_tree._tree_sums, "__defaults__", (per_task,))
    monkeypatch.setattr(suffix_tree, "PAIRS", pairs, raising=False)
    docs = frame([(i, t, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    training = docs.where("learn").select(F.col("text").alias("body"))
    vocab = suffix_tree.materialize(suffix_tree.word_counts(training), "v")
    model = suffix_tree.train(training, vocab, dictionary=0.01, crowd=8)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, vocab, model, learned=F.col("learn")).collect()}
    want = brute_scores([t for i, t in enumerate(texts) if i % 5 != 1], texts)[0]
    assert all(abs(got[i] - s) < 1e-4 for i, s in enumerate(want))
    windows = sum(len((t or "").split()) + 1 for t in texts)
    assert 0 < written["sums"] <= 3 * (windows // per_task + 5)  # 3 blocks, what is told of each, and a bucket more for each level


def test_windows_go_by_whole_contexts():
    """A bucket is solved a share of its contexts at a time, and no context is cut in two."""
    rng = np.random.default_rng(4)
    context, held = rng.integers(0, 40, 5000).astype(np.int32), rng.random(5000) < 0.9
    found = list(suffix_tree._chunks(context, held, 300))
    assert sorted(np.concatenate(found).tolist()) == np.flatnonzero(held).tolist()
    assert len(found) > 5 and max(map(len, found)) < 300 + np.bincount(context[held]).max()
    assert sum(len(set(context[rows].tolist())) for rows in found) == len(set(context[held].tolist()))
    assert all((np.diff(rows[context[rows] == c]) > 0).all() for rows in found for c in set(context[rows].tolist()))
    assert list(suffix_tree._chunks(context, np.zeros(5000, bool))) == []


def test_parts_of_sums_are_small_and_keep_their_value():
    """A text has a part of its sum in most buckets: a part takes about half the bytes of a double and a row number."""
    rng = np.random.default_rng(2)
    rows = np.flatnonzero(rng.random(1700) < 0.8)
    table, prob = np.zeros((6, 2 * len(rows)), np.int32), rng.random(2 * len(rows)) * 1e-3
    table[-2] = np.tile(2 * rows, 2)
    block, kind, n, data, sums = suffix_tree._sums(7, table, prob)[:5]
    assert (block, kind, n) == (7, 0, len(rows)) and len(data) + len(sums) < 6 * n
    got, parts = suffix_tree._added(n, data, sums)
    assert got.tolist() == rows.tolist()
    assert np.abs(parts - np.log10(prob).reshape(2, n).sum(0)).max() < 1e-7
    far = np.array([-1e9, -300.25, 0.0, 2.5])
    assert suffix_tree._added(4, *suffix_tree._parts(np.array([0, 3, 4, 90_000]), far))[1].tolist() == far.tolist()


def test_a_written_step_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_(\d+)_", files))
    before, setting = shuffles(), spark.conf.get(CLEANUP, None)
    kept = spark.range(1000).repartition(3, "id")
    written = materialize(kept, "t")
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert written.count() == 1000
