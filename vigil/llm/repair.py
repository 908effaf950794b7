"""Token-id files compressed by Re-Pair, with random access.

Documents are range-partitioned and sorted by id, encoded whole with a tokenizers-library
vocabulary, and cut into shards of whole documents (about ``shard_tokens`` ids). In each
shard frequent pairs of adjacent symbols are replaced by nonterminals, round after round.
A round puts every symbol on the left or the right side by a hash, so pairs
(left symbol, right symbol) never overlap and all the frequent ones are replaced in one
pass; the sides change each round. It ends when a round shortens the shard too little.

A shard file holds: magic, counts, the first id of each round's nonterminals, the rules
(left, right), the rules' expansion lengths, the symbol sequence and the documents' start
positions. ``decode_range`` finds the symbols that cover a range of ids from the cumulated
expansion lengths and expands those only.

Edge cases: null text counts as empty (its only id is the end id); rows without id come
first; rows of one id are ordered by hash of the text, then text, so repeated rows each have
their place. A document longer than a shard is a shard of its own. An empty table gives
no shards and no rows.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialize, worker_object

MAGIC = b"RPG1"
HEAD = "<4sIIIII"  # magic, first nonterminal, rounds, rules, symbols, documents


class Cache(dict):
    """Key -> what ``make`` gives for it, once."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Whole-text ids as little-endian uint32 bytes, words encoded once while cached.

    The byte-level pre-tokenizer always starts a word at a space that a non-space
    follows, at a punctuation mark behind a letter or digit, and on both sides of a single
    line end; so a text's ids are those of its parts cut there, one after the other. A run of letters is
    one pre-token: where the tokenizer has no step but the byte-level one, it goes straight to the
    library's model. The new ones behind a space go there together, joined by their spaces, where no token
    reaches over a space behind a letter: none of the model's merges does then. The cache has two generations of
    ``entries`` words: when the newer is full it becomes the older, whose words move back
    when they are met again. Its keys are words behind a space; one that begins with a space stands without."""

    CUT, UNCUT, MARKS, LETTERS = re.compile(r" (?=\S)"), re.compile(r" (?!\S)"), ".,;:!?", "A-Za-zÀ-ÖØ-öø-ɏ"
    SIGNS = r"!-&(-/:-@\[-`{-~"  # any ASCII punctuation but the apostrophe: one pre-token behind letters
    PLAIN = re.compile(f"( ?[{LETTERS}]+)([{SIGNS}]*)(?:\n([!-~{LETTERS}][^\n]*))?")
    STEP = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    OVER = re.compile("[A-Za-z]Ġ|(?:^|[Ã-É])[^Ġ]Ġ")  # a token with the last byte of a letter and a space behind it
    TOGETHER = 100  # words in a line

    def __init__(self, path: str, entries: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        self.new, self.old = Cache(self._found), {}
        self.tails = Cache(lambda tail: self._ids([tail])[0])
        said = json.loads(self.tokenizer.to_str())
        step = said["pre_tokenizer"] or {}
        self.letters = not said["normalizer"] and {k: step.get(k) for k in self.STEP} == self.STEP and not any(
            re.fullmatch(f"\\s*[{self.LETTERS}]*[{self.SIGNS}]*\\s*", t["content"]) for t in said["added_tokens"])
        self.plain = self.PLAIN.fullmatch if self.letters else lambda word: None
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level tokens
        self.table = dict(zip([b for b in range(256) if b not in printed], range(256, 512)))
        self.bytes = "".join(chr(self.table.get(b, b)) for b in range(256))
        self.model = self.tokenizer.model.tokenize
        tokens, model = self.tokenizer.get_vocab(with_added_tokens=False), said["model"]
        self.first = np.zeros(1 + max(tokens.values(), default=0), bool)
        self.first[[i for t, i in tokens.items() if t[0] == "Ġ"]] = True
        whole = set(self.bytes) <= tokens.keys()
        self.joined = Tokenizer(self.tokenizer.model) if self.letters and whole and model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) and not any(
            map(self.OVER.search, tokens)) else None

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _word(self, text: str) -> bytes:
        """Ids of one pre-token, its bytes as the library's byte-level letters."""
        return array("I", [t.id for t in self.model(text)]).tobytes()

    def _found(self, word: str) -> bytes:
        known = self.old.get(word)
        return self._encode(word) if known is None else known

    def _encode(self, word: str) -> bytes:
        if self.letters and word.isalpha() and word.isascii():
            return self._word("Ġ" + word)
        if part := self.plain(word):
            stem, marks, line = part.groups()
            if line is not None:
                return self.new[stem] + self.tails[marks + "\n"] + self.new[" " + line]
            if marks:
                return self.new[stem] + self.tails[marks]
            text = stem[1:] if stem[0] == " " else " " + stem
            return self._word(text.encode("utf-8").decode("latin-1").translate(self.table))
        if word and word[-1] in self.MARKS and (stem := word.rstrip(self.MARKS)) and stem[-1].isalnum():
            return self.new[stem] + self.tails[word[len(stem):]]
        return self._ids([word[1:] if word[:1] == " " else " " + word])[0]

    def _together(self, words: list[str]) -> None:
        """Learns runs of letters behind a space: each one's ids begin with a token that begins with the space."""
        lines = [" " + " ".join(words[at:at + self.TOGETHER]) for at in range(0, len(words), self.TOGETHER)]
        lines = [codecs.charmap_decode(line.encode("utf-8"), "strict", self.bytes)[0] for line in lines]
        found = self.joined.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        cuts, held = (4 * np.flatnonzero(self.first[ids])).tolist(), ids.tobytes()
        self.new.update(zip(words, [held[a:b] for a, b in zip(cuts, [*cuts[1:], len(held)])], strict=True))

    def _learn(self, words: set[str]) -> None:
        """Words the newer generation lacks; those made of others come after what they are made of."""
        new, old, letters, others, made = self.new, self.old, [], set(), []
        if old:
            new.update((w, old[w]) for w in words if w in old)
            words = [w for w in words if w not in new]
        if self.joined is None:
            return
        for word in words:
            if word.isalpha() and word.isascii():
                letters.append(word)
            elif part := self.plain(word):
                stem, marks, line = part.groups()
                if line is not None or marks:
                    made.append((word, stem, marks, line))
                    word = stem
                if word[0] != " " and word not in new and word not in old:
                    others.add(word)
        others.difference_update(letters)
        self._together(letters)
        self._together(list(others))
        tails = self.tails
        for word, stem, marks, line in made:
            new[word] = new[stem] + tails[marks] if line is None else new[stem] + tails[marks + "\n"] + new[" " + line]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > self.entries:
            self.old, self.new = self.new, Cache(self._found)
        words, ends = [], [0]
        for text in texts:
            parts = self.CUT.split(text) if self.UNCUT.search(text) else text.split(" ")
            parts[0] = " " + parts[0]  # no space before the first part
            words += parts
            ends.append(len(words))
        found = list(map(self.new.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        self._learn({words[i] for i in gaps})
        for i in gaps:
            found[i] = self.new[words[i]]
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]


def compress(ids: np.ndarray, least: int = 4, rounds: int = 8, gain: float = 0.03):
    """Re-Pair of one shard: (first nonterminal, round starts, rules, lengths, symbols)."""
    seq = ids.astype(np.uint32)
    base = int(ids.max()) + 1 if len(ids) else 0
    starts, rules, lengths = [], [np.zeros((0, 2), np.uint64)], np.ones(base, np.int64)
    for r in range(rounds):
        mixed = (np.arange(len(lengths), dtype=np.uint64) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
        side = ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.int8)[seq]  # of each symbol
        at = np.flatnonzero(side[:-1] < side[1:])
        met = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        slot = ((met * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        likely = np.bincount(slot, minlength=1 << 20)[slot] >= least  # what falls out is rarer than ``least``
        at, met = at[likely], met[likely]
        pairs, number, counts = np.unique(met, return_inverse=True, return_counts=True)
        frequent = counts >= least
        chosen = frequent[number]
        at, number, pairs = at[chosen], (np.cumsum(frequent) - 1)[number[chosen]], pairs[frequent]
        if not len(at) or len(at) < gain * len(seq):
            break
        left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        starts.append(len(lengths))
        seq[at] = (number + len(lengths)).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([left, right], axis=1))
        lengths = np.concatenate([lengths, lengths[left.astype(np.int64)] + lengths[right.astype(np.int64)]])
    return base, starts, np.concatenate(rules), lengths[base:], seq


def pack(ids: np.ndarray, doc_starts: np.ndarray) -> bytes:
    """A shard file: the ids of whole documents and where each document starts."""
    base, starts, rules, lengths, seq = compress(ids)
    return b"".join([struct.pack(HEAD, MAGIC, base, len(starts), len(rules), len(seq), len(doc_starts)),
                     *[np.asarray(x).astype("<u4").tobytes() for x in (starts, rules, lengths, seq, doc_starts)]])


class Shard:
    """Reader of a shard file."""

    def __init__(self, blob: bytes):
        magic, self.base, rounds, rules, symbols, docs = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        sizes = [rounds, 2 * rules, rules, symbols, docs]
        parts, at = [], struct.calcsize(HEAD)
        for n in sizes:
            parts.append(np.frombuffer(blob, dtype="<u4", count=n, offset=at))
            at += 4 * n
        self.round_starts, flat, lengths, self.symbols, self.doc_starts = parts
        self.rules = flat.reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), lengths.astype(np.int64)])
        self.ends = np.cumsum(self.lengths[self.symbols])
        self.size = int(self.ends[-1]) if symbols else 0
        # every symbol's expansion, one after the other
        self.phrases = self._expand(np.arange(self.base + rules, dtype=np.uint32))
        self.phrase_ends = np.cumsum(self.lengths)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        for start in self.round_starts[::-1]:
            wide = seq >= start
            at = np.arange(len(seq)) + np.cumsum(wide) - wide
            out = np.empty(len(seq) + int(wide.sum()), dtype=np.uint32)
            pair = self.rules[seq[wide] - self.base]
            out[at] = seq
            out[at[wide]], out[at[wide] + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard (uint32)."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        symbols = self.symbols[first:last]
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        ids = self.phrases[np.repeat(self.phrase_ends[symbols] - ends, sizes) + np.arange(ends[-1])]
        before = int(self.ends[first] - sizes[0])
        return ids[start - before:stop - before]

    def documents(self):
        """(start, ids) of each document."""
        ids, bounds = self.decode_range(0, self.size), [*self.doc_starts.tolist(), self.size]
        for a, b in zip(bounds, bounds[1:]):
            yield a, ids[a:b]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text",
                 shard_tokens: int = 1 << 20) -> None:
    """Encodes ``docs`` and writes the shard table ``(part, shard, ids, n_tokens, file)``
    in ascending id order: parts in order, shards in order within a part."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.xxhash64(body).alias("h"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "body").select("id", "body")

    def run(batches):
        encoder = worker_object(("encoder", vocabulary), lambda: WordEncoder(vocabulary))
        part, end, shard = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), 0
        ids, held, size = [], [], 0

        def close():
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            starts = np.cumsum([0, *[len(h) // 4 for h in held[:-1]]])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([len(flat)], pa.int64()), pa.array([pack(flat, starts)], pa.binary())],
                names=["part", "shard", "ids", "n_tokens", "file"])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                for i, code in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    if held and size + len(code) // 4 >= shard_tokens:
                        yield close()
                        ids, held, size, shard = [], [], 0, shard + 1
                    ids.append(i)
                    held.append(code + end)
                    size += len(code) // 4 + 1
        if held:
            yield close()
    dealt.mapInArrow(run, "part long, shard long, ids array<long>, n_tokens long, file binary").write.parquet(path)


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Shard table -> per document: id, start (ids of all documents before it), its ids'
    count and the crc32 of their uint32 bytes, from the decoded files."""
    sizes = shards.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file part
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard")
    places = sizes.select("part", "shard", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("inside"))
    places = places.join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("offset"))

    def run(batches):
        for batch in batches:
            for part, shard, ids, blob in zip(*[batch.column(c) for c in ("part", "shard", "ids", "file")]):
                ids = ids.as_py()
                found = [(s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for s, x in Shard(blob.as_py()).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py()] * len(ids), pa.int64()) for x in (part, shard)] + [pa.array(ids, pa.int64())]
                    + [pa.array([f[i] for f in found], pa.int64()) for i in range(3)],
                    names=["part", "shard", "id", "at", "n_tokens", "ids_crc32"])
    decoded = shards.select("part", "shard", "ids", "file").mapInArrow(
        run, "part long, shard long, id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(places, ["part", "shard"]).select(
        F.col("id").alias(id_col), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shard files to the shared folder and reads every document back."""
    from vigil.session import scratch_path
    path = scratch_path(docs.sparkSession, "llm-repair")
    write_shards(docs, path, vocabulary, end_id, id_col, text)
    shards = docs.sparkSession.read.schema("part long, shard long, ids array<long>, n_tokens long, file binary").parquet(path)
    return read_documents(shards, id_col)
