"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units that no piece can cross. Substrings of a unit, up to the longest piece, are exploded and joined to the piece table;
the edges found are grouped by unit, and a fold by Spark's ``aggregate`` finds the path: for unigram models the path of the greatest sum of
scores (Viterbi), for BPE models the path that merging by priority leaves. A BPE model's scores only order its merges, so that the path of
their greatest sum is not its encoding; for these models the fold follows the merges over the same lattice.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of texts whose units are found and encoded together: the distinct units of so much text are one row's array.
BATCH = 32_000_000
#: Units whose ids every task holds: the commonest of so many sampled documents. A cache, so its bounds change no result.
HEAD_DOCS, HEAD_UNITS = 8192, 1 << 18
#: Tasks that fold the cache: its rows are few bytes but much work.
HEAD_TASKS = 64
#: Units up to this length are folded with a 64-bit mask of their boundaries; longer ones by the same merges with a heap.
MASK = 60
#: Bytes of texts that are cut into words, and words of documents that are put together, at a time.
PART, OUT = 4_000_000, 1 << 18


@dataclass(frozen=True)
class PieceModel:
    """``pieces``: (text, id, rank) with rank 0 the first to merge; ``byte_id``: the id of byte 0; ``longest``: code points of the longest piece."""

    pieces: list[tuple[str, int, int]]
    scores: list[float]
    byte_id: int | None
    unk_id: int
    longest: int
    bpe: bool
    spelled: dict[int, bytes] = field(repr=False)

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity normaliser and a dummy prefix are supported")
        return PieceModel.of([(p.piece, i, p.score, p.type) for i, p in enumerate(m.pieces)], m.trainer_spec.model_type == 2)

    @staticmethod
    def of(rows: list[tuple[str, int, float, int]], bpe: bool) -> PieceModel:
        """From (text, id, score, type) with SentencePiece's types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
        normal = [(p, i, s) for p, i, s, t in rows if t in (1, 4)]
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        byte = {int(p[3:5], 16): i for p, i, _, t in rows if t == 6}
        if byte and any(byte.get(k) != byte[0] + k for k in range(256)):
            raise ValueError("byte pieces do not stand together")
        spelled = {i: p.replace(SPACE, " ").encode() for p, i, _ in normal} | {i: bytes([k]) for k, i in byte.items()} | {i: " ⁇ ".encode() for _, i, _, t in rows if t == 2}
        return PieceModel([(p, i, order[s]) for p, i, s in normal], [s for _, _, s in normal], byte.get(0), next((i for _, i, _, t in rows if t == 2), 0), max((len(p) for p, _, _ in normal), default=1), bpe, spelled)

    @property
    def penalty(self) -> float:
        """What a character without a piece costs a unigram path."""
        return min(self.scores, default=0.0) - 10

    def fallback(self, char: str) -> list[int]:
        return [self.unk_id] if self.byte_id is None else [self.byte_id + b for b in char.encode()]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and ids without a text give none."""
        spelled = self.spelled
        text = b"".join([spelled.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Cutter:
    """Cuts a text where no piece can cross: between two characters that stand side by side in no piece."""

    def __init__(self, model: PieceModel) -> None:
        chars = sorted({c for p, _, _ in model.pieces for c in p})
        self.bare = set(chars) - {p for p, _, _ in model.pieces}  # characters that are no piece by themselves
        self.of = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(chars):
            self.of[ord(c)] = k + 1
        self.joined = np.zeros((len(chars) + 1,) * 2, bool)
        for p, _, _ in model.pieces:
            a = self.of[[ord(c) for c in p]]
            self.joined[a[:-1], a[1:]] = True

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The units of all words, one after the other; how many each word has; each unit's code points; and the code point of a unit that is
        one character of no piece, else -1."""
        marked = pc.replace_substring(pc.binary_join_element_wise(SPACE, words, ""), " ", SPACE)
        offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1] if len(marked) else np.zeros(1, np.int32)
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(marked) else np.zeros(0, np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each code point begins
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        a = self.of[points]
        starts = np.searchsorted(first, offsets[:-1] - offsets[0])
        cut = np.ones(len(a), bool)
        cut[1:] = ~self.joined[a[:-1], a[1:]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        bounds = np.append(first[at], len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data.tobytes()))
        length = np.diff(np.append(at, len(a)))
        lone = np.where((length == 1) & (a[at] == 0), points[at].astype(np.int64), -1)
        return units, np.diff(np.append(np.searchsorted(at, starts), len(at))), length, lone


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (none null), one after the other, and how many each text has. A word is what stands between spaces; of several
    spaces all but the first stand at the word's start, and at a text's end they are a word."""
    texts = pc.replace_substring(texts, SPACE, " ")
    lists = pc.split_pattern(texts, " ")
    words, offsets = lists.values, lists.offsets.to_numpy()
    counts = np.diff(offsets)
    size = pc.binary_length(words).to_numpy()
    if size.all():
        return words, counts
    last = np.zeros(len(words), bool)
    last[offsets[1:] - 1] = True  # every text has a word so far, the empty text an empty one
    keep = np.flatnonzero((size > 0) | last)
    spaces = np.diff(keep, prepend=-1) - 1
    real = (pc.binary_length(texts).to_numpy() > 0)[text_of := np.repeat(np.arange(len(counts)), counts)[keep]]
    words, spaces = words.take(pa.array(keep[real])), spaces[real]
    if spaces.any():
        words = pc.binary_join_element_wise(pc.binary_repeat(" ", pa.array(spaces)), words, "")
    return words, np.bincount(text_of[real], minlength=len(counts))


def best_path(unit: str, scores: dict[str, tuple[float, int]], model: PieceModel) -> list[int]:
    """A unit's ids by Viterbi, as the fold finds them: for units that no mask or array holds."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for e in range(1, len(unit) + 1):
        ways = [(best[e - 1][0] + model.penalty, e - 1, -ord(unit[e - 1]) - 1)]
        for s in range(max(0, e - model.longest), e):
            if (x := scores.get(unit[s:e])) is not None:
                ways.append((best[s][0] + x[0], s, x[1]))
        best.append(max(ways))
    ids: list[int] = []
    e = len(unit)
    while e:
        _, s, i = best[e]
        ids[:0] = [i] if i >= 0 else model.fallback(unit[s])
        e = s
    return ids


def merge(unit: str, rank: dict[str, tuple[int, int]], model: PieceModel) -> list[int]:
    """A unit's BPE ids with a heap: of all adjacent pairs that are a piece, the one of the smallest rank merges first, the leftmost of equals."""
    n = len(unit)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j != -1 and (r := rank.get(unit[i : end[j]])) is not None:
            heapq.heappush(heap, (r[0], i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or after[i] != mid or end[mid] != stop:
            continue  # one of the two has merged with another since
        end[i], after[i] = stop, after[mid]
        end[mid] = -1
        if after[i] != -1:
            before[after[i]] = i
        push(i)
        if before[i] != -1:
            push(before[i])
    ids: list[int] = []
    i = 0
    while i < n:
        r = rank.get(unit[i : end[i]])
        ids += [r[1]] if r is not None else model.fallback(unit[i])
        i = end[i]
    return ids


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``piece, id, rank, score``: as many rows as the vocabulary has, a bound that no data moves, so it may be broadcast."""
    rows = pd.DataFrame([(p, i, r, s) for (p, i, r), s in zip(model.pieces, model.scores, strict=True)], columns=["piece", "id", "rank", "score"])
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double")


def substrings(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``unit, s, e`` and the piece's columns of every substring that is a piece: exploded up to the longest piece, joined to the piece table."""
    n = F.length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    each = starts.select("unit", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, n))).alias("e"))
    return each.select("unit", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("piece")).join(F.broadcast(pieces), "piece")


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def field_of(edge: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(edge, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def merged(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``unit, ids`` that merging leaves, of distinct units up to MASK long. A unit without an edge has no row.

    An edge is one number, its rank over start, end and id, so that rising numbers are the order in which merges apply. The fold's state is the
    mask of boundaries; each step takes the first edge that spans exactly two adjacent symbols and clears the boundary between them."""
    edge = F.col("rank").cast("long") * (1 << 36) + F.col("s").cast("long") * (1 << 30) + F.col("e").cast("long") * (1 << 24) + F.col("id")
    lat = substrings(units, pieces, longest).groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    start, end = (lambda x: field_of(x, 30, 6)), (lambda x: field_of(x, 24, 6))
    wide = F.transform(F.filter("edges", lambda x: end(x) - start(x) > 1), lambda x: F.struct((bit(end(x)) - bit(start(x) + 1)).alias("inner"), bit(start(x)).bitwiseOR(bit(end(x))).alias("ends")))
    first = lambda b: F.get(F.filter("wide", lambda x: (b.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(b.bitwiseAND(x["inner"])) == 1)), F.lit(0))["inner"]
    n = F.length("unit")
    steps = F.when(F.size("wide") > 0, F.sequence(F.lit(1), F.least(F.size("wide"), n))).otherwise(F.array().cast("array<int>"))
    lat = lat.withColumn("wide", wide)
    lat = lat.withColumn("cuts", F.aggregate(steps, bit(n + 1) - 1, lambda b, _: b.bitwiseAND(F.bitwise_not(F.coalesce(first(b), F.lit(0).cast("long"))))))
    cuts = F.col("cuts")
    symbol = lambda x: F.call_function("shiftrightunsigned", cuts, start(x)).bitwiseAND(bit(end(x) - start(x) + 1) - 1) == bit(end(x) - start(x)) + 1
    found = F.array_sort(F.transform(F.filter("edges", symbol), lambda x: x.bitwiseAND(F.lit((1 << 36) - 1))))
    lat = lat.withColumn("found", found)
    covered = F.aggregate("found", F.lit(0), lambda z, x: z + end(x) - start(x))
    known = F.transform("found", lambda x: field_of(x, 0, 24))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: cuts.bitwiseAND(bit(i)) != 0)
    mixed = F.transform(at, lambda i: F.coalesce(field_of(F.get(F.filter("found", lambda x: start(x) == i), F.lit(0)), 0, 24), unknown(i)))
    return lat.select("unit", F.when(covered == n, known).otherwise(mixed).alias("ids"))


def unknown(at: Column) -> Column:
    """A character without a piece, as minus its code point less one."""
    return -F.ascii(F.call_function("substring", F.col("unit"), at + 1, F.lit(1))) - 1


def viterbi(units: DataFrame, pieces: DataFrame, longest: int, penalty: float) -> DataFrame:
    """``unit, ids`` of the path of the greatest sum of scores, of distinct units up to MASK long; a character without a piece costs ``penalty``.

    The fold goes over end positions; its state holds, for each position reached, the best sum with the start and the id of its last edge.
    Of equal sums the later start wins, then the greater id. A unit without an edge has no row."""
    lat = substrings(units, pieces, longest).groupBy("unit").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))
    n = F.length("unit")
    step = lambda best, e: F.concat(best, F.array(F.array_max(F.concat(
        F.transform(F.filter("edges", lambda x: x["e"] == e), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id"))),
        F.array(F.struct((F.get(best, e - 1)["score"] + F.lit(penalty)).alias("score"), (e - 1).alias("s"), unknown(e - 1).alias("id"))),
    ))))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("id")))
    lat = lat.withColumn("best", F.aggregate(F.sequence(F.lit(1), n), start, step))
    back = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda z, _: F.when(z["at"] > 0, F.struct(F.get("best", z["at"])["s"].alias("at"), F.concat(F.array(F.get("best", z["at"])["id"]), z["ids"]).alias("ids"))).otherwise(z),
        lambda z: z["ids"],
    )
    return lat.select("unit", back.alias("ids"))


def fold(units: DataFrame, model: PieceModel) -> DataFrame:
    """``unit, ids`` of each distinct unit (unit) by the fold that the model's kind asks for."""
    pieces = piece_table(units.sparkSession, model)
    return merged(units, pieces.drop("score"), model.longest) if model.bpe else viterbi(units, pieces.drop("rank"), model.longest, model.penalty)


@dataclass(frozen=True)
class Head:
    """Units whose ids every task has at hand: ``names``, ``flat`` ids one unit after the other, ``lengths``, and ``same``: they spell the unit."""

    names: pa.Array
    flat: np.ndarray
    lengths: np.ndarray
    same: np.ndarray

    @staticmethod
    def of(known: pa.Table, model: PieceModel) -> Head:
        names, ids = known["unit"].combine_chunks(), known["ids"].combine_chunks()
        flat, lengths = ids.flatten().to_numpy().astype(np.int32), np.diff(ids.offsets.to_numpy())
        return Head(names, flat, lengths, spells(model, flat, lengths, names))


def spells(model: PieceModel, flat: np.ndarray, lengths: np.ndarray, units: pa.Array) -> np.ndarray:
    """Whether each unit's ids, decoded, are the unit again."""
    if not len(units):
        return np.zeros(0, bool)
    each = pa.array([model.spelled.get(i, b"") for i in range(max(model.spelled, default=0) + 1)], pa.binary())
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), each.take(pa.array(flat))), pa.scalar(b"", pa.binary()))
    return pc.equal(said, pc.replace_substring(units, SPACE, " ").cast(pa.binary())).to_numpy(zero_copy_only=False)


def whole(known: pa.Table) -> pa.Table:
    """The rows whose ids are all pieces. Spark does not filter them, as it would push the filter into the fold and work that out again for each row."""
    ids = known["ids"].combine_chunks()
    out = np.ones(len(ids), bool)
    out[pc.list_parent_indices(ids).to_numpy()[ids.flatten().to_numpy() < 0]] = False
    return known.filter(pa.array(out))


def frequent(docs: DataFrame, model: PieceModel, most: int) -> Head:
    """The ``most`` commonest units of a sample of about HEAD_DOCS documents, with their ids by the fold: a cache of bounded size.

    It decides where a unit's ids are looked up, never what they are: units that are not in it go through the join."""
    sampled = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).sample(min(1.0, HEAD_DOCS / max(1, docs.count())), 17)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(held.value)
        for b in batches:
            each = words_of(b.column(0))[0].value_counts()
            units, per_word, _, lone = cutter.cut(each.field("values"))
            n = pa.array(np.repeat(each.field("counts").to_numpy(), per_word))
            of = pa.table({"unit": units, "n": n}).filter(pa.array(lone < 0)).group_by("unit").aggregate([("n", "sum")])
            yield from of.rename_columns({"n_sum": "n"}).select(["unit", "n"]).to_batches()

    top = sampled.mapInArrow(count, "unit string, n long").filter(F.length("unit") <= MASK).groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)
    return Head.of(whole(fold(top.select("unit").repartition(HEAD_TASKS, "unit"), model).toArrow()), model)


class Packer:
    """Gathers texts as numbers of words until there is enough for a batch; a word is what stands between spaces, with the space before it."""

    def __init__(self, cutter: Cutter, head: Head) -> None:
        self.cutter, self.head = cutter, head
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.marked, self.words, self.size = [], [], [], [], 0
        pa.default_memory_pool().release_unused()

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        words, counts = words_of(texts)
        self.ids.append(ids)
        self.marked.append(pc.match_substring(texts, SPACE))
        self.counts.append(counts)
        self.words.append(words.dictionary_encode())
        self.size += int(pc.sum(pc.binary_length(texts)).as_py() or 0) + len(texts)

    def close(self, place: tuple[int, int]) -> pa.RecordBatch:
        """The batch as a row: its key, its body, and its distinct units but for those of the head and characters of no piece."""
        ids, marked, counts = pa.concat_arrays(self.ids), pa.concat_arrays(self.marked), np.concatenate(self.counts)
        coded = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        numbers, words = coded.indices.to_numpy(), coded.dictionary
        self.clear()
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        units, per_word, _, lone = self.cutter.cut(words.take(pa.array(order)))
        coded = units.dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary
        number = pc.fill_null(pc.index_in(names, value_set=self.head.names), -1).to_numpy().astype(np.int64)
        alone = np.full(len(names), -1, np.int64)
        alone[which] = lone
        rest = (number < 0) & (alone < 0)
        number[rest] = len(self.head.names) + np.arange(rest.sum())
        parts = np.where(alone < 0, number, -alone - 1)[which]  # a character of no piece is a unit of its own: minus its code point less one
        rest = names.filter(pa.array(rest))
        n = len(self.head.names) + len(rest)
        body = pickle.dumps((ids, marked, counts, streams(rank[numbers]), streams(per_word), streams(np.where(parts < 0, n, parts)), parts[parts < 0]))
        # of the content too: should a task that runs again meet its rows in another order, its batches have other keys
        key = hashlib.blake2b(pickle.dumps((place, rest)) + body, digest_size=8).digest()
        rest = pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)
        return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(key, "little", signed=True)], pa.int64()), pa.array([zstandard.compress(body, 3)], pa.binary()), rest], ["batch", "body", "units"])


def streams(x: np.ndarray) -> tuple[bytes, ...]:
    """Non-negative numbers by size, a byte for each one's class and its bytes in streams of the class: alike bytes stand together to be compressed."""
    kind = (x >= 1 << 7).astype(np.uint8) + (x >= 1 << 11) + (x >= 1 << 15)
    out = [kind.tobytes()]
    for k, n in enumerate((1, 2, 2, 4)):
        part = x[kind == k]
        out += [((part >> 8 * j) & 255).astype(np.uint8).tobytes() for j in range(n)]
    return tuple(out)


def unstream(parts: tuple[bytes, ...]) -> np.ndarray:
    kind, at = np.frombuffer(parts[0], np.uint8), 1
    out = np.zeros(len(kind), np.int32)
    for k, n in enumerate((1, 2, 2, 4)):
        value = np.frombuffer(parts[at], np.uint8).astype(np.int32)
        for j in range(1, n):
            value |= np.frombuffer(parts[at + j], np.uint8).astype(np.int32) << 8 * j
        out[kind == k] = value
        at += n
    return out


def pack(docs: DataFrame, model: PieceModel, head: Broadcast, size: int) -> DataFrame:
    """``batch, body, units``: batches of texts as numbers, and the distinct units of each that the head does not hold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, n = Packer(Cutter(held.value), head.value), 0
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype(np.int64) + 1)
            at = 0
            while at < b.num_rows:  # rows up to the one that fills the batch
                stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size - packer.size)) + 1
                stop = min(stop, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART)) + 1)
                part = b.slice(at, min(stop, b.num_rows) - at)
                packer.add(part.column(0), part.column(1))
                at += part.num_rows
                if packer.size >= size:
                    yield packer.close((TaskContext.get().partitionId(), n))
                    n += 1
        if packer.size:
            yield packer.close((TaskContext.get().partitionId(), n))

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(work, "batch long, body binary, units array<string>")


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``which`` names, one after the other, and their lengths."""
    n = size[which]
    return flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def every(ok: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether all are true in each run of ``ok``, of so many values as ``counts`` says."""
    upto = np.append(0, np.cumsum(~ok))
    ends = np.cumsum(counts)
    return upto[ends] == upto[ends - counts]


def unpack(body: bytes, units: pa.Array, found: pa.Table, head: Head, m: PieceModel, by_piece: dict) -> Iterator[pa.RecordBatch]:
    """The encoded documents of a batch: from the ids of the head's units and of those found for the batch's own ``units``."""
    ids, marked, counts, numbers, per_word, parts, odd = pickle.loads(zstandard.decompress(body))
    numbers, per_word, parts = unstream(numbers), unstream(per_word).astype(np.int64), unstream(parts).astype(np.int64)
    n_head, n = len(head.names), len(head.names) + len(units)
    parts[parts == n] = odd
    u, lists = found["u"].to_numpy(), found["ids"].combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    have = np.zeros(len(units), bool)
    have[u] = True
    own = np.flatnonzero(~have)  # units over MASK, those with a character that has no piece, and those that no fold has found
    by_hand = [merge(x, by_piece, m) if m.bpe else best_path(x, by_piece, m) for x in units.take(pa.array(own)).to_pylist()]
    chars = np.unique(odd)
    of_chars = [m.fallback(chr(-c - 1)) for c in chars.tolist()]
    flat = np.concatenate([flat, *(np.array(x, np.int32) for x in by_hand)]).astype(np.int32)
    lengths, u = np.concatenate([lengths, [len(x) for x in by_hand]]).astype(np.int64), np.concatenate([u, own]).astype(np.int64)
    same = np.zeros(len(units), bool)
    same[u] = spells(m, flat, lengths, units.take(pa.array(u)))
    flat = np.concatenate([head.flat, flat, *(np.array(x, np.int32) for x in of_chars)]).astype(np.int32)
    lengths = np.concatenate([head.lengths, lengths, [len(x) for x in of_chars]]).astype(np.int64)
    low = -int(chars.min(initial=0))
    at = np.concatenate([np.arange(n_head), n_head + u, chars]).astype(np.int64) + low
    start, size, ok = np.zeros(n + low, np.int64), np.zeros(n + low, np.int64), np.full(n + low, m.byte_id is not None)
    start[at], size[at] = np.cumsum(lengths) - lengths, lengths
    ok[low:] = np.concatenate([head.same, same])
    parts += low
    flat, n = ragged(flat, start, size, parts)  # unit after unit of each word
    word_start = np.cumsum(per_word) - per_word
    upto = np.append(0, np.cumsum(n))
    start, size, ok = upto[word_start], upto[word_start + per_word] - upto[word_start], every(ok[parts], per_word)
    last = np.cumsum(counts)
    k = 0
    while k < len(counts):  # documents of about OUT words at a time
        stop = max(k + 1, int(np.searchsorted(last, last[k] - counts[k] + OUT, "right")))
        which = numbers[last[k] - counts[k] : last[stop - 1]]
        out, n = ragged(flat, start, size, which)
        offsets = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts[k:stop]))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))
        good = every(ok[which], counts[k:stop]) & ~marked.slice(k, stop - k).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([ids.slice(k, stop - k), pa.array(np.diff(offsets), pa.int32()), lists, pa.array(good)], schema=ENCODED)
        k = stop


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encode(docs: DataFrame, model: PieceModel, batch: int = BATCH, head_units: int = HEAD_UNITS) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for every row of ``docs`` (doc_id, text).

    ``round_trip``: the ids decode to the text again, compared unit by unit as bytes; only a text that holds the mark U+2581 itself does not, as
    that is decoded as a space. Null and empty texts have no ids; characters without a piece are bytes; null ids stay; repeated rows are
    encoded each; further columns are ignored; an empty table gives an empty result.

    Texts become numbers of words in batches of ``batch`` bytes (a longer text is a batch by itself, as its ids are one row). The commonest
    ``head_units`` units of a sample are at hand in every task; each other unit's lattice is built once for the table, and its ids go back to
    the batches that hold the unit, not to every place where it stands, in a plain join whose skewed partitions Spark splits. Texts are packed
    once: both uses read one shuffle. Should a lost executor's task meet its rows in another order, the batches it makes have other
    keys, find no ids, and merge their units themselves, with the same result."""
    sc = docs.sparkSession.sparkContext
    held, head = sc.broadcast(model), sc.broadcast(frequent(docs, model, head_units))
    packed = pack(docs, model, head, batch).repartition("batch")
    # both uses of a shuffle need all its columns, lest it be made twice; and none is ever null, lest a filter part them
    units = F.when(F.length("body") >= 0, F.col("units")).otherwise(F.array().cast("array<string>"))
    spots = packed.select(F.col("batch").alias("home"), F.posexplode(units).alias("u", "unit")).select("home", "u", F.coalesce("unit", F.lit("")).alias("unit")).filter(F.length("unit") <= MASK)
    spots = spots.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")  # a fold is much work for few bytes: not to be put together by size
    distinct = spots.groupBy("unit").agg(F.min("u").alias("u"), F.min("home").alias("home")).filter("u >= 0 or home is not null").select("unit")
    back = spots.join(fold(distinct, model), "unit").select("home", "u", "ids")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        m = held.value
        by_piece = {p: (r, i) for p, i, r in m.pieces} if m.bpe else {p: (s, i) for (p, i, _), s in zip(m.pieces, m.scores, strict=True)}
        known = whole(right)
        out = [x for b, u in zip(left["body"].to_pylist(), left["units"].combine_chunks(), strict=True) for x in unpack(b, u.values, known, head.value, m, by_piece)]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema=ENCODED)

    return packed.groupBy("batch").cogroup(back.groupBy("home")).applyInArrow(work, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, text`` of every row of ``tokens`` (doc_id, ids); null ids give a null text, ids without a piece give nothing."""
    held = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else held.value.decode([int(i) for i in x if i is not None]) for x in ids], dtype=object)

    return tokens.select("doc_id", text("ids").alias("text"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), PieceModel.load())
