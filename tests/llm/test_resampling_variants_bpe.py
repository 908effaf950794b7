"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty
tables and callers' columns named like the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import byte_bpe, importance, variants

DOCS = "doc_id long, text string, id long, row long, score long, place long, key string, word string, ids string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, 7, 7, "k", "w", "x") for i, t in rows], DOCS).repartition(3)


# ---- 11

def brute_resample(docs, target, n_min, n_max, buckets, percent, least_words):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1)]
    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    usable = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(usable[:percent * len(usable) // 100])}
    return Counter((r[0], r[1], r[2], r[3], rank.get(id(r))) for r in rows)


@pytest.fixture(scope="module")
def prose():
    random.seed(11)
    words = ["alpha", "Beta", "gamma9", "déjà", "x" * 70, "y" * 200, "z" * 64, "q" * 65, "the", "of", "naïve", "日本"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 19, 20, 21, 60])))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "--- !!"), (None, "alpha beta " * 20), (None, None), (203, "Z" * 100_000), *rows[:5], *rows[:5]]


@pytest.mark.parametrize("n_max", [1, 3])
def test_resampling_is_brute_force(spark, prose, n_max):
    target = ["alpha beta gamma9", None, "", "déjà vu naïve the the", "x" * 70]
    got = importance.resample(docs_of(spark, prose), spark.createDataFrame([(t,) for t in target], "text string"), 1, n_max, 1000, 30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    held = Counter(tuple(r) for r in got.collect())
    want = brute_resample(prose, target, 1, n_max, 1000, 30, 20)
    # repeated rows tie: which of them has which rank is open
    assert Counter({k[:4]: v for k, v in held.items()}) == Counter({k[:4]: v for k, v in want.items()})
    assert sorted((k[4], k[:4]) for k in held if k[4]) == sorted((k[4], k[:4]) for k in want if k[4])


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).collect() == []
    one = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty, percent=100, least_words=1).collect()
    assert [r["rank"] for r in one] == [1]


def test_all_of_one_score_are_ranked(spark):
    rows = [(None, "same words")] * 50
    got = importance.resample(docs_of(spark, rows), spark.createDataFrame([("same",)], "text string"), percent=50, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26)) and len(got) == 50


def test_position_table_is_crc32():
    random.seed(3)
    data = np.frombuffer(random.randbytes(5000), np.uint8)
    start = np.array([random.randrange(4000) for _ in range(300)])
    size = np.array([random.choice([1, 2, 63, 64, 65, 127, 128, 129, 700, 1000]) for _ in range(300)])
    got = importance.span_crcs(data, start, size, importance.position_table(), importance.length_constants())
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size)]


# ---- 12

def brute_variants(counts, dominance=10):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out, form = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        top = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top and counts[top] >= dominance * n else None
        out[w] = [n, len(found), counts[form[w]] if form[w] else None]
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), *v) for w, v in out.items()}


@pytest.mark.parametrize("shard_size", [3, 8192])
def test_variants_are_brute_force(spark, shard_size):
    random.seed(5)
    counts = {}
    for stem in ("aaaaaaa", "abababab", "receives", "ééèèaaa", "zyxwvuts"):
        for _ in range(60):
            w = list(stem)
            for _ in range(random.choice([0, 1, 1, 2, 3])):
                i = random.randrange(len(w))
                w[i:i + 1] = random.choice([[], [random.choice("abeé")], [w[i], random.choice("abz")]])
            counts["".join(w)] = random.choice([1, 2, 20, 200, 2000])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {tuple(r) for r in variants.group_variants(words, shard_size=shard_size).collect()}
    assert got == brute_variants(counts)


def test_words_are_counted_after_the_lost_letter(spark):
    random.seed(6)
    rows = [(i, " ".join(random.choice(["Receive", "letters", "Größe", "a", "naïveté"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "Receive receive"), (3, None), (4, ""), (5, "12 --"), *rows[:3], (6, "Ab" * 60_000)]
    want = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    want.pop("", None)
    got = {r["word"]: r["n"] for r in variants.counted_words(docs_of(spark, rows)).collect()}
    assert got == want


def test_no_words_no_variants(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


# ---- 13

@pytest.fixture(scope="module")
def bpe():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def odd_texts():
    random.seed(7)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [None, "", "x" * 100_000, "=-" * 3000 + "=" * 77 + "--==" * 50, " " * 5000 + "a\n\n  b\t\t ", "\0\0 \0", "<|endoftext|>", " ", "I'll can't"]
    rows += ["".join(random.choice(letters) for _ in range(3000)) for letters in ("ab=- ", "aA ", "xyx", "0.1", "éa ", "\n \t")]
    rows += ["".join(chr(random.choice([random.randrange(0xD800), random.randrange(0xE000, 0x110000), random.randrange(0x80)])) for _ in range(300)) for _ in range(60)]
    rows += ["a1".join(every[i:i + 4000]) for i in range(0, len(every), 4000)]
    return rows + rows[:4]


@pytest.mark.parametrize("remember", [400_000, 5])
def test_byte_bpe_is_the_library(spark, bpe, remember):
    path, pattern, library = bpe
    rows = list(enumerate(odd_texts() if remember > 5 else odd_texts()[:30]))
    encoded = byte_bpe.encode(docs_of(spark, rows), path, pattern, remember=remember, rows=7).cache()
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert [i for i, t in rows if got[i] != library.encode_ordinary(t or "")] == []
    back = {r[0]: bytes(r[1]) for r in encoded.select("doc_id", byte_bpe.decode(F.col("ids"), path)).collect()}
    assert [i for i, t in rows if back[i] != (t or "").encode()] == []
    encoded.unpersist()


def test_byte_bpe_digests_null_ids_and_empty_tables(spark, bpe):
    path, pattern, library = bpe
    rows = [(None, "one two"), (None, "one two"), (1, None)]
    got = byte_bpe.digests(byte_bpe.encode(docs_of(spark, rows), path, pattern), path).collect()
    ids = library.encode_ordinary("one two")
    want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"one two").hexdigest())
    none = hashlib.sha256(b"").hexdigest()
    assert Counter(tuple(r) for r in got) == Counter({(None, *want): 2, (1, 0, none, none): 1})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, path, pattern).collect() == []


def test_byte_bpe_merges_in_the_worker(spark, bpe):
    """Spark's expressions fold no words, and the two ways to merge agree with the library."""
    path, pattern, library = bpe
    encoded = byte_bpe.encode(docs_of(spark, [(1, "one two")]), path, pattern)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan
    ranks = byte_bpe.read_ranks(path)
    rng = random.Random(3)
    for word in ["a" * 300, "=" * 257, *("".join(rng.choices("abcdeé", k=n)) for n in range(2, 240))]:
        want = library.encode_ordinary(word)
        assert byte_bpe.merge_word(word.encode(), ranks) == want
        assert len(word) < 2 or word.encode() in ranks or byte_bpe._merge_long(word.encode(), ranks) == want


def test_unknown_ids_decode_to_nothing(spark, bpe):
    out = spark.range(1).select(byte_bpe.decode(F.array(F.lit(60_000), F.lit(64), F.lit(-1), F.lit(None).cast("int")), bpe[0])).first()[0]
    assert bytes(out) == {v: k for k, v in byte_bpe.read_ranks(bpe[0]).items()}[64]
