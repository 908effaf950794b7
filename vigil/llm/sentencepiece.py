"""SentencePiece encoding and decoding.

A text becomes "▁" plus itself with every space as "▁", and falls apart into units: no
piece has a "▁" behind another character, nor a character that no piece has, so the best
segmentation of a text is that of its units. Distinct units are counted once (Spark aggregate). Those
whose count reaches a threshold that at most ``dictionary`` units reach are encoded once, by tasks of their own, and
broadcast with their ids. All other units are encoded where they stand: by the task that meets them, which keeps the
ids of up to ``remember`` units and words (a text is cut at its spaces first). So no text and no unit goes through a join, and nothing but counts and ids is written.

A unit is encoded by Viterbi over its substrings in the piece table, with one back-pointer a character: time and
memory grow with a unit's length. A character without a piece is its UTF-8 byte pieces.

Per document come the number of pieces, its score and a checksum over all (id, place) pairs, the
place being 4 * character offset + byte within a character: it tells any other order.
``encode_pieces`` writes every document's ids, ``decode`` turns them back into texts, and ``round_trip`` derives
these sums and a digest of the restored text from the written ids (``encode``: the sums alone).

A model of type BPE has merge ranks instead of log probabilities; ``piece_table`` scores
them -100000 - rank (sums stay exact): fewer pieces win, then smaller ranks. That is a Viterbi reading of the
table, not the order of merges.

Edge cases: null and empty texts have no piece (restored as empty); repeated rows and
repeated or null ids keep their own rows. Equal scores go to the segmentation whose last
differing edge starts earlier. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vigil.llm.common import WordIds, discard, materialize_at, share

SPACE = "▁"
MODULUS = (1 << 31) - 1
LONG_UNIT = 64


def piece_table(spark: SparkSession, model_file: str) -> DataFrame:
    """``(piece, id, score, byte)`` of a model file; ``byte`` is set for byte pieces."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=model_file)
    rows, ranks = [], 0
    bpe = not any(model.get_score(i) % 1 for i in range(model.get_piece_size()))  # whole numbers are merge ranks
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        byte = int(name[3:5], 16) if model.is_byte(i) else None
        if byte is None:
            ranks += 1
        rows.append((name, i, (-100_000.0 - ranks if bpe else float(model.get_score(i))), byte))
    return spark.createDataFrame(rows, "piece string, id int, score double, byte int")


class Units:
    """Cuts texts into words and these into units that the pieces of a table never cross."""

    def __init__(self, pieces: list[str]):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space behind another character")
        letters = set().union(*pieces) | {SPACE}
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        ascii_ = list(map(chr, range(128)))
        lone = [c for c in ascii_ if c not in letters]  # in no piece: a unit each
        before = {c: {q[0] for q in self.pairs if q[1] == c} for c in ascii_ if c in letters and not c.isalnum()}
        # punctuation that pieces have behind other punctuation only starts a unit; what they
        # have behind some characters starts one behind all others
        marks = set(before)
        while loose := {c for c in marks if not before[c] <= marks | {SPACE}}:
            marks -= loose
        soft = sorted(set(before) - marks)

        def among(chars):
            return "[" + re.escape("".join(sorted(chars))) + "]"
        plain = f"[^{SPACE}{re.escape(''.join([*lone, *sorted(marks), *soft]))}]"
        behind = "|".join(f"(?<={among(before[c])}){re.escape(c)}" for c in soft if before[c])
        item = f"(?:{plain}++" + (f"|(?={among(soft)})(?:{behind}))" if behind else ")")
        kinds = [f"{SPACE}*{plain}++{item}*", *([f"{SPACE}*{among(marks)}+{item}*"] if marks else []),
                 *([f"{SPACE}*{among(soft)}{item}*"] if soft else []), *([among(lone)] if lone else []), f"{SPACE}+"]
        self.whole = not any(map(str.isalnum, lone))  # a run of letters and digits is a unit
        self.find, self.runs = re.compile("|".join(kinds)).findall, re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)").findall

    def words(self, text: str | None) -> list[str]:
        """What follows each space of "▁" and the text, up to the next space with a character before it: a unit lies in one word."""
        if not text:
            return []
        body = SPACE + text.replace(" ", SPACE)
        return self.runs(body) if SPACE + SPACE in body else body.split(SPACE)[1:]

    def of(self, word: str) -> list[str]:
        """The units of "▁" and a word."""
        if self.whole and len(word) < LONG_UNIT and word.isalnum():
            return [SPACE + word]
        units = self.find(SPACE + word)
        if max(map(len, units)) <= LONG_UNIT:
            return units
        out = []
        for u in units:
            if len(u) <= LONG_UNIT:
                out.append(u)
                continue
            cuts = [0, *[i for i in range(1, len(u)) if u[i - 1:i + 1] not in self.pairs], len(u)]
            out += [u[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


def unit_counts(texts: DataFrame, units: Units) -> DataFrame:
    """``texts(body)`` -> ``(unit, n)``."""
    shared = share(texts.sparkSession, units)

    def run(batches, limit=300_000):
        cut, words = pickle.loads(shared.value), Counter()

        def flush():
            counts: Counter = Counter()
            for word, n in words.items():
                for unit in cut.of(word):
                    counts[unit] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["unit", "n"])
        for batch in batches:
            for text in batch.column(0):
                words.update(cut.words(text.as_py()))
                if len(words) > limit:
                    yield flush()
        yield flush()
    return texts.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


class Lattice:
    """Best segmentations over the rows of a piece table, a tree of characters: (score, what may follow)."""

    def __init__(self, rows: list):
        self.table = {r["piece"]: (r["id"], r["score"]) for r in rows if r["byte"] is None}
        code = {r["byte"]: r["id"] for r in rows if r["byte"] is not None}
        self.code = code if len(code) == 256 else {}
        self.fallback = min((r["score"] for r in rows), default=0.0) - 10.0
        self.longest = max(map(len, self.table), default=1)
        self.tree: dict = {}
        for piece, (_, score) in self.table.items():
            node = self.tree
            for c in piece[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[-1], [None, {}])[0] = score
        starts = {"": 0}  # the same tree in arrays: (node, character) in order, the node it leads to, that node's piece
        for piece in self.table:
            for end in range(1, len(piece) + 1):
                starts.setdefault(piece[:end], len(starts))
        key = np.array([starts[p[:-1]] << 21 | ord(p[-1]) for p in starts if p], np.int64)
        order = np.argsort(key)
        self.key, self.after = key[order], 1 + order
        held = [self.table.get(p, (-1, 0.0)) for p in starts]
        self.piece, self.score = np.array([h[0] for h in held], np.int32), np.array([h[1] for h in held], np.float64)

    def ids(self, unit: str) -> array:
        """Piece ids of a unit; byte pieces for a character without a piece."""
        size, table, tree, fallback, longest = len(unit), self.table, self.tree, self.fallback, self.longest
        best, back = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        for start in range(size):
            before, after, end = best[start], tree, start
            for c in unit[start:start + longest]:
                node = after.get(c)
                if node is None:
                    break
                end += 1
                score, after = node
                if score is not None and before + score > best[end]:  # equal scores: the earlier start
                    best[end], back[end] = before + score, start
            if unit[start] not in table and before + fallback > best[start + 1]:
                best[start + 1], back[start + 1] = before + fallback, start
        cuts = [size]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        out = array("i")
        for start, end in zip(cuts, cuts[1:]):
            if held := table.get(unit[start:end]):
                out.append(held[0])
            else:
                out.extend(self.code.get(byte, 0) for byte in unit[start].encode("utf-8"))
        return out


    def all_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of many units, one after the other, and how many each has: what ``ids`` does, for all units at
        once from one place to the next. Very long units and those with a character without a piece go there."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        quick = sizes <= LONG_UNIT if len(self.key) else np.zeros(len(units), bool)
        short = np.flatnonzero(quick)
        sizes = sizes[short]
        chars = np.frombuffer("".join([units[i] for i in short.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner, first = np.repeat(np.arange(len(short)), sizes), np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - first[owner]
        left, lone = sizes[owner] - place, np.ones(len(chars), bool)
        live, node, edges, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], 0
        while len(live):
            key = node << 21 | chars[live + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            live, node, depth = live[hit], self.after[at[hit]], depth + 1
            some = self.piece[node] >= 0
            edges.append((live[some], np.full(int(some.sum()), depth), node[some]))
            if depth == 1:
                lone[live[some]] = False
            on = left[live] > depth
            live, node = live[on], node[on]
        quick[short[owner[lone]]] = False
        owners, found = [], []
        if edges:
            start, length, node = map(np.concatenate, zip(*edges))
            order = np.argsort(place[start].astype(np.int16), kind="stable")
            start, length, node = start[order], length[order], node[order]
            cuts = np.searchsorted(place[start], np.arange(sizes.max() + 1)).tolist()
            source = start + owner[start]  # a unit of n characters has n + 1 places
            target, gain, origin = source + length, self.score[node], first + np.arange(len(short))
            best, back, by = np.full(len(chars) + len(short), -np.inf), np.zeros(len(chars) + len(short), np.int64), np.zeros(len(chars) + len(short), np.int64)
            best[origin] = 0.0
            for a, b in zip(cuts, cuts[1:]):
                value = best[source[a:b]] + gain[a:b]
                better = np.flatnonzero(value > best[target[a:b]])  # equal scores: the earlier start
                to = target[a:b][better]
                best[to], back[to], by[to] = value[better], source[a:b][better], node[a:b][better]
            now, live = origin + sizes, np.flatnonzero(quick[short] & (sizes > 0))
            while len(live):
                owners.append(short[live])
                found.append(self.piece[by[now[live]]])
                now[live] = back[now[live]]
                live = live[now[live] > origin[live]]
        owners.reverse()
        found.reverse()
        for i in np.flatnonzero(~quick).tolist():
            found.append(np.asarray(self.ids(units[i]), np.int32))
            owners.append(np.full(len(found[-1]), i))
        owners, found = np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.int32), *found])
        return found[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(units))


def encode_units(units: DataFrame, lattice: Lattice) -> DataFrame:
    """``units(unit)`` of distinct units -> ``(unit, ids)``."""
    shared = share(units.sparkSession, lattice)

    def run(batches):
        lattice = pickle.loads(shared.value)
        for batch in batches:
            ids, sizes = lattice.all_ids(batch.column(0).to_pylist())
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], names=["unit", "ids"])
    return units.select("unit").mapInArrow(run, "unit string, ids array<int>")


def frequent_units(vocab: DataFrame, dictionary: int) -> Column:
    """Whether a unit reaches the smallest count that at most ``dictionary`` units reach."""
    tally = vocab.where(F.char_length("unit") <= LONG_UNIT).groupBy("n").agg(F.count("*").alias("units")).orderBy(F.col("n").desc())
    least, taken = None, 0
    for r in tally.toLocalIterator():
        taken += r["units"]
        if taken > dictionary:
            break
        least = r["n"]
    return (F.col("n") >= F.lit(least)) & (F.char_length("unit") <= LONG_UNIT) if least is not None else F.lit(False)


def encode(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text: str = "text", dictionary: int = 150_000) -> DataFrame:
    """Per document: id, n_units, n_pieces, score and ids_checksum of its encoding."""
    return round_trip(docs, pieces, id_col, text, dictionary).drop("restored_md5")


def _bounded(batch, rows: int = 128):
    """A batch's rows by so many at once."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def encode_pieces(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text: str = "text", dictionary: int = 150_000,
                  remember: int = 200_000) -> DataFrame:
    """``(id, n_units, ids)``: the piece ids of every document, one written row each."""
    spark, found = docs.sparkSession, pieces.collect()
    cut, lattice = Units([r["piece"] for r in found if r["byte"] is None]), Lattice(found)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    counted, folder = materialize_at(unit_counts(rows.select("body"), cut), "unit-counts", compression="zstd")
    top = encode_units(counted.where(frequent_units(counted, dictionary)), lattice).toPandas()
    discard(spark, folder)
    ends = np.cumsum([len(x) for x in top["ids"]], dtype=np.int64)
    pool = np.concatenate([np.zeros(0, np.int32), *top["ids"]]).astype(np.int32)
    shared = share(spark, (cut, lattice, top["unit"].tolist(), pool.tobytes(), ends.tobytes()))

    def run(batches):
        cut, lattice, words, pool, ends = pickle.loads(shared.value)
        held, known, sizes = WordIds(lattice.ids, words, pool, ends), WordIds(None), array("q")  # ids of units and words, units of each word

        def learn(new):
            units = list(map(cut.of, new))
            flat, counts = list(chain.from_iterable(units)), np.fromiter(map(len, units), np.int64, len(units))
            other = [u for u in set(flat) if u not in held]
            held.add(other, *lattice.all_ids(other))
            ids, begin = held.ids_of(np.fromiter(map(held.__getitem__, flat), np.int64, len(flat)))
            known.add(new, ids, np.diff(begin[np.cumsum([0, *counts])]))
            sizes.frombytes(counts.tobytes())
        for batch in batches:
            for some in _bounded(batch):
                held.trim(remember)
                if known.trim(remember):
                    del sizes[:]
                texts = [cut.words(text.as_py()) for text in some.column(1)]
                learn([w for w in set(chain.from_iterable(texts)) if w not in known])
                numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64)
                ids, begin = known.ids_of(numbers)
                cuts = np.cumsum([0, *map(len, texts)])
                n_units = np.diff(np.concatenate([[0], np.cumsum(np.asarray(sizes)[numbers])])[cuts])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n_units, pa.int64()), pa.ListArray.from_arrays(pa.array(begin[cuts], pa.int32()), pa.array(ids, pa.int32()))],
                    names=["id", "n_units", "ids"])
    schema = rows.select("id").schema.add("n_units", "long").add("ids", ArrayType(IntegerType()))
    done = rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_units", "ids")
    return materialize_at(done, "piece-ids", compression="zstd")[0]


def _piece_bytes(pieces: DataFrame) -> dict[int, bytes]:
    return {r["id"]: r["piece"].encode("utf-8") if r["byte"] is None else bytes([r["byte"]]) for r in pieces.collect()}


def _text(data: bytes) -> str:
    body = data.decode("utf-8", "replace").replace(SPACE, " ")
    return body[1:] if body.startswith(" ") else body


def _restored(ids: list[int], table: dict[int, bytes]) -> str:
    return _text(b"".join(map(table.get, ids, repeat(b""))))


def decode(encoded: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, ids)`` -> ``(id, text)``: pieces looked up by id, byte pieces joined to characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(_piece_bytes(pieces))
    rows = encoded.select(F.col(id_col), "ids")

    def run(batches):
        for batch in batches:
            for some in _bounded(batch):
                bodies = [_restored(ids or [], shared.value) for ids in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(bodies, pa.string())], names=[id_col, "text"])
    return rows.mapInArrow(run, rows.select(id_col, F.lit("").alias("text")).schema)


def round_trip(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text: str = "text", dictionary: int = 150_000) -> DataFrame:
    """Per document, from its written ids alone: id, n_units, n_pieces, score and ids_checksum
    (those of ``encode``) and the MD5 of the text decoded from them."""
    encoded = encode_pieces(docs, pieces, id_col, text, dictionary)
    rows = pieces.collect()
    fallback = min((r["score"] for r in rows), default=0.0) - 10.0
    top = 1 + max((r["id"] for r in rows), default=0)
    step, weight, inner = np.zeros(top, np.int64), np.zeros(top), np.zeros(top, bool)
    for r in rows:
        byte = r["byte"]
        inner[r["id"]] = byte is not None and byte & 0xC0 == 0x80  # goes on with a character
        step[r["id"]] = len(r["piece"]) if byte is None else not inner[r["id"]]
        weight[r["id"]] = r["score"] if byte is None else 0.0 if inner[r["id"]] else fallback
    shared = docs.sparkSession.sparkContext.broadcast((_piece_bytes(pieces), step, weight, inner))
    names = [id_col, "n_units", "n_pieces", "score", "ids_checksum", "restored_md5"]
    schema = encoded.select(id_col, "n_units").schema.add("n_pieces", "long").add("score", "double").add(
        "ids_checksum", "long").add("restored_md5", "string")

    def run(batches):
        table, step, weight, inner = shared.value
        held = pa.array([table.get(i, b"") for i in range(top)], pa.binary())
        for some in chain.from_iterable(map(_bounded, batches)):
            cuts = some.column(2).offsets.to_numpy().astype(np.int64)
            ids = some.column(2).values[cuts[0]:cuts[-1]].to_numpy(zero_copy_only=False).astype(np.int64)
            cuts -= cuts[0]
            n, order = np.diff(cuts), np.arange(len(ids))
            row = np.repeat(np.arange(len(n)), n)
            start, before = cuts[row], np.cumsum(step[ids]) - step[ids]
            lead = np.maximum.accumulate(np.where(inner[ids], start, order))
            places = 4 * (before[lead] - before[start]) + order - lead
            sums = np.concatenate([[0], np.cumsum((ids + 1) * (places + 1) % MODULUS)])[cuts]
            total = np.bincount(row, weights=weight[ids], minlength=len(n))
            taken = held.take(pa.array(ids))
            ends = np.frombuffer(taken.buffers()[1], np.int32)[cuts].tolist() if len(ids) else [0] * len(cuts)
            body = taken.buffers()[2].to_pybytes() if len(ids) else b""
            restored = [hashlib.md5(_text(body[a:b]).encode("utf-8")).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                                              pa.array(np.diff(sums) % MODULUS, pa.int64()), pa.array(restored, pa.string())], names=names)
    return encoded.mapInArrow(run, schema)
