"""Benchmark decontamination: n-gram seeds join passages of documents to test items, and Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

WORD = re.compile(r"\w+")
#: Words of a seed. An item keeps all its seeds: an edited or partial copy may hold any of them.
SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item is found from this share of its greatest score, or from a local alignment worth so many words in a row.
SCORE, VERBATIM = 0.5, 13
#: Words of items that go out to the workers at once; a larger benchmark is worked in blocks of this size.
BLOCK_WORDS = 1_000_000


@dataclass
class Items:
    """A block of the benchmark. ``keys`` rise; the places (item, word) of key k are ``item[start[k]:start[k + 1]]`` and ``at`` beside them."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray
    start: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(lowered(t))], np.int64) for _, t in rows]
        keys, item, at = [], [], []
        for k, w in enumerate(words):
            key = seeds(w, len(vocabulary))
            keys.append(key)
            item.append(np.full(len(key), k))
            at.append(np.arange(len(key)))
        return Items([i for i, _ in rows], words, vocabulary, *index(*(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (keys, item, at))))

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's words as numbers (-1: in no item), the places of its seeds, and which keys those are."""
        get = self.vocabulary.get
        w = np.array([get(x, -1) for x in WORD.findall(lowered(text))], np.int64)
        key = seeds(w, len(self.vocabulary))
        if not len(key) or not len(self.keys):
            return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.flatnonzero(key >= 0)
        k = np.minimum(np.searchsorted(self.keys, key[places]), len(self.keys) - 1)
        found = self.keys[k] == key[places]
        return w, places[found], k[found]

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) of each item found in the text, its best alignment.

        Seeds on diagonals near each other are aligned as one stretch, row by row of the item: at worst, where a text repeats a seed all along,
        the whole text once for the item, so time grows with words of the text times words of the item, and memory with the text."""
        w, places, k = self.hits(text)
        if not len(places):
            return []
        n = self.start[k + 1] - self.start[k]
        spots = np.repeat(self.start[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = self.item[spots], np.repeat(places, n) - self.at[spots]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        out: dict[int, tuple[float, int, int]] = {}
        cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > 16)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True):
            own = self.words[item[a]]
            lo, hi = max(0, int(diagonal[a]) - 16), min(len(w), int(diagonal[b - 1]) + len(own) + 16)
            value, end = align(w[lo:hi], own)
            share = value / (MATCH * len(own))
            if (share >= SCORE or value >= MATCH * VERBATIM) and share > out.get(int(item[a]), (0.0,))[0]:
                back = align(w[lo : lo + end][::-1], own[::-1])[1]
                out[int(item[a])] = (share, lo + end - back, lo + end)
        return [(i, *x) for i, x in sorted(out.items())]


def lowered(text: str) -> str:
    """Lower case, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def seeds(w: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of SEED words; -1 where one of them is in no item."""
    n = len(w) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(SEED):
        key = key * size + w[k : n + k]
        known &= w[k : n + k] >= 0
    return np.where(known, key, -1)


def index(key: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    keys, start = np.unique(key[order], return_index=True)
    return keys, np.append(start, len(key)).astype(np.int64), item[order], at[order]


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """The greatest Smith-Waterman score of the two word sequences, and where in the text it ends."""
    steps = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP))
        row = np.maximum.accumulate(new - GAP * steps) + GAP * steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size, read one after the other."""
    rows, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        n += len(r["text"]) // 4 + 1
        if n >= BLOCK_WORDS:
            yield Items.of(rows)
            rows, n = [], 0
    if rows:
        yield Items.of(rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, start, end`` for each document (doc_id, text) and item (item_id, text) found in it.

    Words are runs of letters, digits and underscores, lower-cased. ``score`` is the Smith-Waterman score of the best alignment as a share of the item's
    greatest; start and end are its code points in the text. Null and empty texts hold nothing; items of fewer words than a seed have
    none and are never found; null ids stay null; repeated rows and items give a row each; further columns are ignored; an empty table on
    either side gives an empty result. Maps over Arrow batches without a shuffle, so a passage that stands in a third of all documents makes
    no hot task. A copy without SEED words of the item in a row is not found."""
    out = None
    schema = "doc_id long, item_id long, score double, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for items in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    got = held.value.matches(text) if text else []
                    if got:
                        spans = [m.span() for m in WORD.finditer(lowered(text))]
                        found += [(doc_id, held.value.ids[i], score, spans[s][0], spans[e - 1][1]) for i, score, s, e in got]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(work, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def free_of(items) -> Callable:
    """A filter for texts in which no item of a block (a broadcast) is found."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not (t and items.value.matches(t)) for t in texts], dtype=bool)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns: a filter in place, without a join."""
    for items in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.filter(free_of(held)(F.col("text").cast("string")))
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
