"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, table, training_rows
from tessera.llm.learn import FactorisationMachine, Rows

#: Buckets of words; a statistic of 0 to 1 has STEPS features, one for each step of its range, and one that carries its value.
WORDS, STEPS = 1 << 15, 10
STATS = ("capitals", "digits", "marks", "odd marks", "other bytes", "white space", "distinct words", "most frequent word", "distinct pairs", "distinct lines", "word length", "words", "characters as stored", "none stored")
SIZE = WORDS + len(STATS) * (STEPS + 1)
#: The greatest number of labelled documents that a fit collects.
TRAIN_LIMIT = 6000
HELD_MOD, HELD_REST = 4, 2


def statistics(text: str, words: list[str], n_chars: float | None) -> list[float]:
    """Each of STATS in 0 to 1."""
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(n.sum()))
    marks = int(n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum())
    odd = marks - int(n[44] + n[46] + n[39] + n[45])  # all but , . ' -
    lines = [x for x in text.split("\n") if x]
    count = Counter(words)
    w = max(1, len(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    stored = None if n_chars is None or math.isnan(n_chars) else n_chars
    return [
        int(n[65:91].sum()) / total, int(n[48:58].sum()) / total, marks / total, min(1.0, 4 * odd / total), int(n[128:].sum()) / total, int(n[9:14].sum() + n[32]) / total,
        len(count) / w, max(count.values(), default=0) / w, pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), min(1.0, len("".join(words)) / w / 16), min(1.0, math.log1p(len(words)) / 12),
        min(1.0, math.log1p(max(0.0, stored or 0.0)) / 16), float(stored is None),
    ]


class Features:
    """Features of a text; buckets of words already seen are kept, up to a bound."""

    def __init__(self) -> None:
        self.bucket: dict[str, int] = {}

    def __call__(self, text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        known, bag = self.bucket, Counter()
        if len(known) > 300_000:
            known.clear()
        for word, n in Counter(words).items():
            b = known.get(word)
            if b is None:
                b = known[word] = zlib.crc32(word.encode()) % WORDS
            bag[b] += n
        stats = statistics(text, words, n_chars)
        index = np.fromiter(bag, np.int64, len(bag))
        value = np.log1p(np.fromiter(bag.values(), np.float32, len(bag)))
        value /= max(1e-9, float(np.sqrt((value * value).sum())))
        first = WORDS + np.arange(len(STATS)) * (STEPS + 1)
        x = np.array(stats, np.float32)
        step = first + 1 + np.minimum(STEPS - 1, (x * STEPS).astype(np.int64))
        return np.concatenate([index, first, step]), np.concatenate([value, x, np.ones(len(STATS), np.float32)])


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT, seed: int = 1) -> FactorisationMachine:
    """Fit on at most ``limit`` labelled documents whose crc32(doc_id) modulo 4 is not 2: those with the smallest hash of their id.

    Features are made where the rows are; a row's features, SIZE at most however long its text, are what reaches the driver. Without
    labelled rows, or with one label only, the score is the base rate."""
    rows = training_rows(docs, labels, "quality", HELD_MOD, HELD_REST, limit, seed, ["doc_id", F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars")])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for b in batches:
            x = [make(t or "", n) for t, n in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "i": [i.astype("<i4").tobytes() for i, _ in x], "v": [v.astype("<f4").tobytes() for _, v in x]})

    got = sorted(rows.select("doc_id", "label", "text", "n_chars").mapInPandas(work, "doc_id long, label int, i binary, v binary").collect())
    x = Rows.of([(np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["v"], "<f4")) for r in got])
    return FactorisationMachine.fit(x, np.array([r["label"] for r in got], np.float32), SIZE, seed=seed)


def can_fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT, seed: int = 1) -> bool:
    """Whether the rows that ``fit_quality`` learns from hold both labels."""
    return training_rows(docs, labels, "quality", HELD_MOD, HELD_REST, limit, seed, ["doc_id"]).select("label").distinct().count() == 2


def score_quality(docs: DataFrame, model: FactorisationMachine, keep_from: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text, n_chars).

    A null text counts as empty and has a score like any other; null ids count as empty text for held_out and stay; repeated rows stay,
    each scored alike; further columns are ignored; an empty table gives an empty result. A map over Arrow batches: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x (1 + rank) numbers

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, m = Features(), held.value
        for b in batches:
            score = np.zeros(len(b))
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                score[k : k + 256] = m.score(Rows.of([make(t or "", n) for t, n in zip(part["text"], part["n_chars"], strict=True)]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": score})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("n_chars").cast("double")).mapInPandas(work, "doc_id long, score double")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), HELD_MOD) == HELD_REST).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: FactorisationMachine, keep_from: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_from``, with all their columns: a filter in place, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        make = Features()
        out = [held.value.score(Rows.of([make(t or "", n) for t, n in zip(text[k : k + 256], n_chars[k : k + 256], strict=True)])) for k in range(0, len(text), 256)]
        return pd.Series(np.concatenate(out) if out else [])

    return docs.filter(score(F.col("text").cast("string"), F.col("n_chars").cast("double")) >= keep_from)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
