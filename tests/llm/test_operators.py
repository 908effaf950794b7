"""Small brute-force checks and edge cases of the training-data operators."""

import glob
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash

from vigil.llm import decontaminate, langid, licenses, repair, sentencepiece, simhash, suffix_tree, topk, urlfilter, warc
from vigil.llm.common import materialize
from vigil.session import ensure_checkpoint_dir

DOC = "doc_id long, text string, lang string, source string"
WORDS = "the of and to in was form order ship house river stone green light open".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))


def awkward():
    """Nulls in every column, empty and long texts, repeated rows and ids, no words."""
    long = prose(1, 30_000)
    return [(1, prose(2, 60), "en", "a"), (2, None, "en", "a"), (None, prose(3, 50), None, None), (3, "", "de", "b"),
            (4, " \n\t ", None, "b"), (5, long, "en", "a"), (6, long + " more", "en", "a"), (7, prose(2, 60), "fr", "c"),
            (7, prose(2, 60), "fr", "c"), (8, "!!! ... 123", "en", "a"), (9, "one", "en", None), (9, "two words", "en", None)]


# --- 1 top-k
def brute_topk(rows, k):
    q = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q.setdefault(i, []).append([math.floor(1024 * float(x)) for x in v])
    out = set()
    for i in q:
        if i % 100:
            continue
        mine = min(q[i])
        found = sorted((-sum(a * b for a, b in zip(mine, v)), j) for j, vs in q.items() if j != i for v in vs if len(v) == len(mine))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


def test_topk_ties_nulls_and_ranges(frame):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.5, -0.25, 0.1, 3.7]) for _ in range(4)]) for i in range(260)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan")] * 4), (None, [1.0] * 4), (303, [1.0, 2.0]), (200, [9.0] * 4),
             (304, [0.5] * 4), (304, [0.5] * 4)]
    vectors = frame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    for bins, block in ((4, 1024), (1024, 1)):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, bins=bins, block=block)
        assert {tuple(r) for r in got.collect()} == brute_topk([(i, v and [np.float32(x) if x is not None else None for x in v]) for i, v in rows], 10)


def test_topk_empty_and_few(frame):
    empty = frame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).collect() == []
    few = frame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


# --- 2 Re-Pair
def test_repair_round_trip_and_ranges():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        ids = (rng.zipf(1.4, n) % 50_000).astype(np.uint32)
        shard = repair.Shard(repair.pack(ids, np.array([0])))
        assert (shard.decode_range(0, shard.size) == ids).all()
        for a, b in ((0, n // 3), (n // 3, n // 2), (n, n)):
            assert (shard.decode_range(a, b) == ids[a:b]).all()


def test_token_files_against_the_tokenizer(frame):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    docs = [(i, t) for i, t, *_ in awkward() if i is not None]
    docs += [(20, "a  b\n c <|endoftext|> d, e.f ; 's \u00a0x"), (21, "\u00fcber \u6f22\u5b57!? (x).")]
    got = repair.token_files(frame(docs, "doc_id long, text string"), path).collect()
    want, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0], 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert repair.token_files(frame([], "doc_id long, text string"), path).collect() == []
    assert [tuple(r) for r in repair.token_files(frame([(None, None)], "doc_id long, text string"), path).collect()][0][:3] == (None, 0, 1)


# --- 3 language ID
def test_language_id_edges_and_accuracy(frame, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.train(docs.where("doc_id % 3 <> 1"))
    found = langid.predict(docs.where("doc_id % 3 = 1"), profiles).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in found) > 0.97 * len(found)
    rows = {r["text"]: r for r in langid.predict(frame(awkward(), DOC), profiles).collect()}
    for text in (None, "", " \n\t ", "!!! ... 123"):
        assert (rows[text]["lang_pred"], rows[text]["score"]) == ("und", 0.0)
    none = langid.train(frame([], DOC))
    assert none == {} and {r["lang_pred"] for r in langid.predict(frame(awkward(), DOC), none).collect()} == {"und"}


# --- 4 WARC
def test_warc_roles_and_fetch(frame):
    big = "<p>" + "\u00fc\r\n\r\nWARC/1.1\r\n" * 200
    pages = [(1, "http://a.b/x", big), (5, "http://c.d/\r\ny", big), (5, "http://c.d/y2", big), (3, None, big), (None, "http://e/", big),
             (7, "u", None), (8, "u", ""), (9, "u", "small"), (10, "u", "small"), (11, "http://www.a.b:80/z?q", big + "!")]
    got = warc.archived_pages(frame(pages, "page_id long, url string, html string"))
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = h == big and i != 5
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert warc.archived_pages(frame([], "page_id long, url string, html string")).collect() == []


def test_capture_lookup(frame, spark, tmp_path):
    pages = frame([(i, f"http://h{i % 7}.org/p/{i % 50}", f"<p>{i}") for i in range(500)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.roles(pages), path)
    index = warc.build_index(warc.read_archives(spark, path), block_rows=16)
    keys = frame([("org,h3)/p/3 00000000000000000003",), ("org,h3)/p/3 x",), ("org,h0)/p/49 00000000000000000049",), ("a",), ("z",)], "key string")
    assert sorted(r["page_id"] for r in warc.fetch(warc.lookup(index, keys, group=2)).collect()) == [3, 49]


# --- 5 licenses
def test_license_scan(frame):
    docs = [(1, "x y\nReleased under the MIT License.\nz"), (2, "RELEASED  under the 'MIT' license!"), (3, "nothing here"), (4, None), (5, ""),
            (6, "This work is licensed under the GNU General Public License, version 2."), (None, "Licensed under CC BY-NC 4.0."), (7, "word"),
            (1, "x y\nReleased under the MIT License.\nz")]
    got = {(r["doc_id"], r["license"]): (r["passages"], r["dice"]) for r in licenses.scan(frame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"): (2, 1.0), (2, "MIT"): (1, 1.0), (6, "GPL-2.0"): (1, 1.0), (None, "CC-BY-NC-4.0"): (1, 1.0)}
    assert licenses.scan(frame([], "doc_id long, text string")).collect() == []


# --- 6 URL filter
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules(frame):
    urls = {"http://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
            "https://www.example.com/en/#f": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "x://com": ("com", "", None, "allow"),
            "http://n.net/es/9": ("n.net", "/es/9", "net/es/", "block"), "http://n.net/ES/9": ("n.net", "/ES/9", None, "allow"),
            "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow")}
    got = urlfilter.judge(frame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), RULES).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == dict(enumerate(urls.values()))
    assert urlfilter.judge(frame([], "page_id long, url string"), RULES).collect() == []


def test_url_templates_reject_by_purity(frame):
    rows = [(i, f"http://h.org/spam/{i}x{i * 7}", True if i < 20 else None) for i in range(60)]
    rows += [(100 + i, f"http://h.org/news/{i}", False if i < 20 else None) for i in range(60)]
    rows += [(200, "http://other.org/spam/1", None)]
    from pyspark.sql import functions as F
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(frame(rows, "page_id long, url string, bad boolean"), [], label=F.col("bad")).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[i] == "allow" for i in [*range(100, 160), 200])


# --- 7 SimHash
def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(frame):
    docs = [r[:2] for r in awkward()]
    got = simhash.near_duplicates(frame(docs, "doc_id long, text string")).collect()
    fps = [brute_simhash(t) for _, t in docs]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{f:016x}" for f in fps)
    parent = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    ids = lambda c: [d[0] for d, p in zip(docs, parent) if p == c and d[0] is not None]
    want = sorted((str(d[0]), str(min(ids(p), default=None))) for d, p in zip(docs, parent))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = simhash.drop_near_duplicates(frame(awkward(), DOC))
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.count() == len(set(parent))
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).collect() == []


def test_links_of_large_buckets_and_bk_tree(frame):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert all(sorted(tree.within(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2] for v in values[:40])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.components_of(materialize(frame(list(enumerate(signed)), "id long, fp long"), "t"), 2, shard_size=16).collect()
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {r["fp"]: r["component_id"] for r in got} == {s: find(i) for i, s in enumerate(signed)}


# --- 8 decontamination
def test_decontamination_against_brute_force(frame):
    items = [(i, prose(100 + i, n)) for i, n in enumerate((5, 6, 12, 40, 200))] + [(9, "too short"), (10, None), (None, prose(300, 20))]
    half = items[3][1].split()
    docs = [(1, prose(1, 400) + " " + items[0][1].upper() + ", " + prose(2, 50)), (2, "x " + items[2][1] + " " + items[4][1]),
            (3, " ".join(half[:37])), (4, " ".join(half[:20])), (5, prose(7, 5000)), (6, None), (7, ""), (None, items[1][1]), (7, items[7][1]), (2, "x")]

    def grams(t):
        w = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = {}
    for d, t in docs:
        for i, b in items:
            g = grams(b)
            if g and len(g & grams(t)) / len(g) >= 0.8:
                want[d, i] = max(want.get((d, i), 0), len(g & grams(t)) / len(g))
    df, items_df = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contaminated(df, items_df).collect()}
    assert got == want and len(want) >= 5
    left = decontaminate.drop_contaminated(df, items_df)
    assert left.columns == df.columns and left.count() == len(docs) - sum(any(grams(b) and len(grams(b) & grams(t)) / len(grams(b)) >= .8
                                                                              for _, b in items) for _, t in docs)
    none = frame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(df, none).count() == len(docs)
    assert decontaminate.contaminated(frame([], "doc_id long, text string"), items_df).collect() == []


def test_decontamination_of_items_that_share_an_id(frame):
    a, b = prose(500, 40).split(), prose(501, 40).split()
    twins = [(i, " ".join(w)) for i in (1, None) for w in (a, b)]
    assert len({tuple(a[i:i + 5]) for i in range(36)}) == len({tuple(b[i:i + 5]) for i in range(36)}) == 36  # one size
    docs = [(1, " ".join(a[:22] + ["-"] + b[:22])), (2, " ".join(a) + " x"), (3, prose(7, 100))]
    df, items = frame(docs, "doc_id long, text string"), frame(twins, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(2, 1): 1.0, (2, None): 1.0}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(df, items).collect()) == [1, 3]


def test_columns_with_the_names_used_inside(frame, spark):
    import corpus_pipeline
    names = ["text_key", "_text_key", "simhash", "_simhash", "row", "_row", "fp", "body", "rare", "_rare", "lang_pred", "_lang_pred",
             "lang_score", "n_tokens", "Score", "word", "c", "m", "hs", "key"]
    rows = [(i, t, "en", "a", *[f"{i}{n}" for n in names]) for i, t in ((1, prose(2, 60)), (2, prose(2, 60)), (3, prose(4, 60)), (4, None))]
    docs = frame(rows, DOC + "".join(f", {n} string" for n in names))
    items = frame([(1, prose(4, 60))], "item_id long, text string")

    def ids(df):
        assert df.columns == docs.columns
        assert all(r[n] == f"{r['doc_id']}{n}" for r in df.collect() for n in names)
        return sorted(r["doc_id"] for r in df.collect())
    assert ids(decontaminate.drop_contaminated(docs, items)) == [1, 2, 4]
    assert ids(simhash.drop_near_duplicates(docs)) == [1, 3, 4]
    assert ids(corpus_pipeline.language_stage(spark, docs, "")) == [1, 2, 3]
    vocab = materialize(suffix_tree.word_counts(docs.select("text")), "v")
    scored = suffix_tree.score(docs, vocab, suffix_tree.train(docs.select("text"), vocab))
    kept = [n for n in names if n not in ("n_tokens", "Score")]
    assert scored.columns == ["doc_id", "lang", "source", *kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert all(r[n] == f"{r['doc_id']}{n}" for r in scored.collect() for n in kept)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in scored.collect()) == [(1, 61), (2, 61), (3, 61), (4, 1)]


# --- 9 suffix tree
def test_suffix_tree(frame):
    cycle = "a b c d " * 300
    train = frame([(cycle,), (None,), ("a b x",)], "body string")
    vocab = materialize(suffix_tree.word_counts(train), "v")
    counts = Counter(w for t in (cycle, None, "a b x") for w in [*suffix_tree.tokens(t), b""])
    assert {bytes(r["word"]): r["c"] for r in vocab.collect()} == dict(counts)
    model = suffix_tree.train(train, vocab)
    docs = [(1, "A b c d a b"), (2, None), (None, "zzz d yyy"), (1, "")]
    rows = suffix_tree.score(frame(docs, "doc_id long, text string"), vocab, model).collect()
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in [*suffix_tree.tokens(t), b""])
    assert sorted(round(r["base_score"], 9) for r in rows) == sorted(round(base(t), 9) for _, t in docs)
    likely = max(rows, key=lambda r: r["n_tokens"])
    assert likely["n_known"] == 7 and likely["score"] > likely["base_score"] + 1  # the end after "b" is a surprise
    # every state's distribution sums to one (the class of unknown words included)
    words = len(model.words)
    for history in ([0], [0, 1], [0, 1, 2], [0, 4, 1]):
        flat = [np.array([*history, x]) for x in range(words)]
        p = [10 ** model.token_scores(f, np.append(np.zeros(len(f) - 2), model.root(model.counts[f[-1]])))[-1] for f in flat]
        unknown = 10 ** model.token_scores(np.array([*history, -1]), np.zeros(len(history)))[-1] * 10 ** model.root(0)
        assert abs(sum(p) + unknown - 1) < 1e-6
    nothing = frame([], "body string")
    empty = materialize(suffix_tree.word_counts(nothing), "v")
    assert {r["base_score"] for r in suffix_tree.score(frame(docs, "doc_id long, text string"), empty, suffix_tree.train(nothing, empty)).collect()} == {0.0}


# --- 10 SentencePiece
def brute_encode(text, table, least):
    normal = {p: (i, s) for p, i, s, b in table if b is None}
    byte = {b: i for p, i, s, b in table if b is not None}
    text = "\u2581" + text.replace(" ", "\u2581") if text else ""
    best = [(0.0, None)]
    for e in range(1, len(text) + 1):
        best.append(max(((best[b][0] + s[1], -b) for b in range(max(0, e - 16), e)
                         if (s := normal.get(text[b:e], (None, least - 10) if e - b == 1 else None))), default=None))
    e, path = len(text), []
    while e:
        b = -best[e][1]
        part = text[b:e]
        path = ([(normal[part][0], 4 * b)] if part in normal else [(byte[x], 4 * b + j) for j, x in enumerate(part.encode())]) + path
        e = b
    return path, best[-1][0]


def test_sentencepiece_lattice_and_round_trip(frame, spark):
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    table = [tuple(r) for r in pieces.collect()]
    least = min(r[2] for r in table)
    docs = [(1, prose(1, 80)), (2, None), (3, ""), (4, "  two  blanks\n\tand \u2603 \u6f22 e\u0301 "), (None, "x" * 300), (6, "a b"), (6, "a b"), (7, "Zq%&" * 60)]
    df = frame(docs, "doc_id long, text string")
    want = [(i, *brute_encode(t, table, least)) for i, t in docs]
    for dictionary in (3, 400_000):
        got = sentencepiece.encode(df, pieces, dictionary=dictionary).collect()
        assert sorted((str(r["doc_id"]), r["n_pieces"], r["ids_checksum"], r["score"]) for r in got) == sorted(
            (str(i), len(p), sum((x + 1) * (y + 1) for x, y in p) % sentencepiece.MODULUS, s) for i, p, s in want)
    encoded = sentencepiece.encode_pieces(df, pieces)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == sorted((str(i), [x for x, _ in p]) for i, p, _ in want)
    assert sorted((str(r["doc_id"]), r["text"]) for r in sentencepiece.decode(encoded, pieces).collect()) == sorted((str(i), t or "") for i, t in docs)
    assert sentencepiece.encode(frame([], "doc_id long, text string"), pieces).collect() == []


def test_sentencepiece_round_trip_is_derived_from_the_ids(frame, spark):
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = [(1, prose(1, 80)), (2, None), (3, ""), (4, "  two  blanks\n\tand \u2603 \u6f22 e\u0301 "), (None, "x" * 300), (6, "a b"), (6, "a b")]
    df = frame(docs, "doc_id long, text string")
    sums = ["doc_id", "n_units", "n_pieces", "score", "ids_checksum"]
    for dictionary in (3, 400_000):
        got = sentencepiece.round_trip(df, pieces, dictionary=dictionary)
        assert sorted((str(r["doc_id"]), r["restored_md5"]) for r in got.collect()) == sorted(
            (str(i), hashlib.md5((t or "").encode()).hexdigest()) for i, t in docs)
        assert sorted(map(str, got.select(*sums).collect())) == sorted(map(str, sentencepiece.encode(df, pieces).select(*sums).collect()))
    assert sentencepiece.round_trip(frame([], "doc_id long, text string"), pieces).collect() == []


def test_sentencepiece_of_long_runs(frame, spark):
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    table = [tuple(r) for r in pieces.collect()]
    least = min(r[2] for r in table)
    rng = random.Random(5)
    short = [(1, "=" * 300), (2, "".join(rng.choices("ACGT", k=400))), (3, "a" * 130)]
    want = [(i, [x for x, _ in brute_encode(t, table, least)[0]]) for i, t in short]
    got = sentencepiece.encode_pieces(frame(short, "doc_id long, text string"), pieces).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    long = [(1, "x" * 100_000), (2, "".join(rng.choices("ACGT", k=100_000))), (3, "a b")]
    out = sentencepiece.round_trip(frame(long, "doc_id long, text string"), pieces).collect()
    assert {r["doc_id"]: r["restored_md5"] for r in out} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in long}


def test_sentencepiece_writes_only_counts_and_ids(frame, spark):
    """Units outside the dictionary are encoded where they stand, however few a task keeps: nothing is joined or written for them."""
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    table = [tuple(r) for r in pieces.collect()]
    docs = [(i, prose(i, 40) + "  (x), \u6f22\u2581y" * (i % 3)) for i in range(300)]
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/vigil/*"))
    got = sentencepiece.encode_pieces(frame(docs, "doc_id long, text string").repartition(1), pieces, dictionary=3, remember=5).collect()
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/vigil/*")) - before} == {"llm-piece-ids"}
    least = min(r[2] for r in table)
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == [(i, [x for x, _ in brute_encode(t, table, least)[0]]) for i, t in docs]


# --- pipeline
def test_pipeline_keeps_clean_documents(frame, spark, tmp_path):
    import corpus_pipeline
    item = prose(77, 30)
    docs = [(i, prose(200 + i, 80), "en", "s", 1) for i in range(12)] + [
        (20, prose(200, 80), "en", "s", 1), (21, "?? 12", "en", "s", 1), (22, None, None, None, None),
        (23, prose(300, 60) + " " + item, "en", "s", 1)]
    frame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(12))


def test_language_stage_without_labels_and_with_gibberish(frame, spark):
    import corpus_pipeline
    schema = "doc_id long, text string, lang string"
    clean = [(i, prose(200 + i, 80), "en") for i in range(6)] + [(6, "To", "en"), (7, "Von.", "de")]
    other = [(20, "?? 12", None), (21, None, None), (22, "", None)]
    noise = [(30, "qwrtz psdfg xcvbn mklpq zzzz " * 30, None)]
    kept = lambda rows: sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, frame(rows, schema), "").collect())
    assert kept([(i, t, None) for i, t, _ in clean + other]) == list(range(8))
    assert kept(clean + other + noise) == list(range(8))


def test_units_encoded_together_are_those_encoded_alone(spark):
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")).collect()
    cut, lattice = sentencepiece.Units([r["piece"] for r in pieces if r["byte"] is None]), sentencepiece.Lattice(pieces)
    rng = random.Random(6)
    units = ["▁", "▁the", "▁ofthndouer", "a" * 64, "a" * 65, "\U0001f600x", "ACGT" * 90,
             *["".join(rng.choice("abcDeñé▁.-=漢\U0001f600xAC0") for _ in range(rng.randrange(1, 70))) for _ in range(400)]]
    ids, sizes = lattice.all_ids(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [list(lattice.ids(u)) for u in units]
    assert [len(x) for x in lattice.all_ids([])] == [0, 0]
    words = ["plain", "Ñandú", "a1b", "x" * 63, "x" * 64, "don't", "a.b", "1,000.", "漢字", "²x", ""]
    fast = [cut.of(w) for w in words if w]
    cut.whole = False
    assert fast == [cut.of(w) for w in words if w]


def test_sentencepiece_forgets_and_goes_on(frame, spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé.") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(300)]
    docs = frame([(i, t) for i, t in enumerate([*texts, None, "", "  ", " a"])], "doc_id long, text string").repartition(1)
    pieces = sentencepiece.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    few = sentencepiece.encode_pieces(docs, pieces, dictionary=20, remember=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, sentencepiece.encode_pieces(docs, pieces).collect()))


def test_runs_of_letters_go_straight_to_the_model():
    """The ids are those of the whole text, and only other words go through the tokenizer."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, asked = repair.WordEncoder(path), []
    plain, ids = [f"{a}{b}" for a in ("lyble", "Thtion", "ñez", "öie") for b in ("heat", "kê", "anou", "Q")], encoder._ids
    encoder._ids = lambda parts: [asked.append(p) for p in parts] and ids(parts)
    texts = [" ".join(plain), "; ".join(plain) + ".", " ".join(f"{w}.\n{w}" for w in plain)]
    found = encoder.encode(texts)
    assert set(asked) == {".", ";", ".\n"}
    rng = random.Random(9)
    signs = [" ", " ", "\n", ".", ",", "a", "Bc", "é", "'s", "1", "²", "×", "\t", "\u00a0", "\x1c", "漢", "<|endoftext|>", "ª", "Ω", "\r", "ɏ"]
    texts += ["", " ", "a.\nB", "a.\n B", "a.\n\nB", "x...\n...y", *["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]]
    found += encoder.encode(texts[3:])
    whole = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in whole]


def test_new_words_go_to_the_model_together(tmp_path):
    """Runs of letters behind a space, marks and lines behind them or not, are looked up in one call for many texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéñöhtAÉɏ") for _ in range(rng.randrange(1, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "###", "$%.", "\n" + rng.choice(words)]) for _ in range(50)) for _ in range(80)]
    encoder, alone = repair.WordEncoder(path, entries=300), []
    one = encoder.model
    encoder.model = lambda word: alone.append(word) or one(word)
    found = encoder.encode(texts[:40]) + encoder.encode(texts[40:])  # the second call has an older generation
    assert alone and not any(word.startswith("Ġ") for word in alone)
    whole = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == whole
    said = json.loads(encoder.tokenizer.to_str())  # with a token over the end of a word and a space, words stand alone
    said["model"]["vocab"]["aĠ"] = max(encoder.tokenizer.get_vocab().values()) + 1
    said["model"]["merges"].append(["a", "Ġ"] if isinstance(said["model"]["merges"][0], list) else "a Ġ")
    (tmp_path / "over.json").write_text(json.dumps(said))
    other = repair.WordEncoder(str(tmp_path / "over.json"))
    assert other.joined is None
    assert [np.frombuffer(f, "<u4").tolist() for f in other.encode(texts)] == whole
