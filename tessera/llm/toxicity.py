"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, table, training_rows
from tessera.llm.learn import BoostedTrees, Isotonic, calibrated_trees

#: Insults that count wherever they stand; the fit adds words that its labelled rows show to be toxic.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile jerk creep freak liar coward pig vermin filth filthy hate hateful ugly shut kill die bastard bitch damn hell crap idiota imbécil estúpido estúpida basura asqueroso inútil connard imbécile stupide ordure débile dummkopf idiotisch trottel abschaum widerlich".split())
YOU = frozenset("you your yours yourself youre ur u tú tu te ti usted ustedes vosotros vous votre toi du dich dir dein deine sie ihr euch".split())
WORD = re.compile(r"[^\W_]+")
LEET = re.compile(r"[a-z][@$!*0134579._-]+[a-z]")
SPACED = re.compile(r"\b(?:[a-z][ .*_-]){3,}[a-z]\b")
LONG = re.compile(r"\w*([a-z])\1\1\w*")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "9": "g", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "_": None, "-": None})
TRAIN_LIMIT = 6000
HELD_MOD, HELD_REST = 3, 1


@dataclass
class ToxicityModel:
    """``learned``: words beyond INSULTS with their log-odds."""

    learned: dict[str, float]
    trees: BoostedTrees
    calibration: Isotonic


def collapse(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def dense(text: str, learned: dict[str, float], lexicon: frozenset[str], collapsed: frozenset[str]) -> list[float]:
    """The dense features of a text. ``lexicon``: INSULTS with the learned words; ``collapsed``: those without doubled letters."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    of = [(k, w) for k, w in enumerate(words) if w in lexicon]
    you = [k for k, w in enumerate(words) if w in YOU] if of else []
    marks = np.array(you)
    far = [int(np.abs(marks - k).min()) if len(you) else 50 for k, _ in of]
    hidden = 0
    leet = 0
    for m in LEET.finditer(low):
        start, end = low.rfind(" ", 0, m.start()) + 1, low.find(" ", m.end())
        token = low[max(start, m.start() - 40) : (end if 0 <= end <= m.end() + 40 else m.end() + 40)]
        leet += 1
        hidden += any(x in lexicon for x in WORD.findall(token.translate(PLAIN)))
    for m in SPACED.finditer(low):
        hidden += re.sub(r"[ .*_-]", "", m[0]) in lexicon
    for m in LONG.finditer(low):
        hidden += collapse(m[0]) in collapsed and m[0] not in lexicon
    b = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(b.sum()))
    letters = max(1, int(b[65:91].sum() + b[97:123].sum()))
    marked = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
    kinds = {w for _, w in of}
    return [
        math.log1p(len(words)), len(of), 100 * len(of) / n, 100 * sum(w in INSULTS for _, w in of) / n, len(kinds), sum(learned.get(w, 2.0) for w in kinds),
        100 * sum(learned.get(w, 2.0) for _, w in of) / n, 100 * len(you) / n, min(far, default=60), sum(x <= 5 for x in far) / max(1, len(far)),
        int(b[65:91].sum()) / letters, 100 * int(b[33]) / n, 100 * int(b[63]) / n, marked / total, 100 * hidden / n, hidden, 100 * leet / n,
    ]


def features(texts: list[str], learned: dict[str, float]) -> np.ndarray:
    lexicon = INSULTS | frozenset(learned)
    collapsed = frozenset(map(collapse, lexicon))
    return np.array([dense(t, learned, lexicon, collapsed) for t in texts or [""]], np.float64)[: len(texts)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT, seed: int = 4) -> ToxicityModel:
    """Fit on at most ``limit`` labelled documents whose crc32(doc_id) modulo 3 is not 1: those with the smallest hash of their id.

    First the lexicon grows by words that stand in a fiftieth of the toxic sample and ten times as often as in the rest; their counts are
    made where the rows are. Then a row of dense features for each sampled document reaches the driver. Without labelled rows the score
    is 1/2; with one label only it is that label's rate, smoothed."""
    rows = training_rows(docs, labels, "toxic", HELD_MOD, HELD_REST, limit, seed, ["doc_id", F.col("text").cast("string").alias("text")])
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, rest = n.get(1, 0), n.get(0, 0)
    least = max(3.0, 0.02 * toxic)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                seen[label].update(set(WORD.findall((text or "").lower())))
        yield pd.DataFrame([(w, seen[0][w], seen[1][w]) for w in seen[0].keys() | seen[1].keys()], columns=["word", "rest", "toxic"])

    counts = rows.select("text", "label").mapInPandas(count, "word string, rest long, toxic long").groupBy("word").agg(F.sum("rest").alias("rest"), F.sum("toxic").alias("toxic"))
    shown = counts.filter((F.col("toxic") >= least) & (F.col("toxic") * rest >= 10 * F.greatest(F.col("rest"), F.lit(0.5)) * toxic)).collect()
    learned = {r["word"]: math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["rest"] + 0.5) / (rest + 1)) for r in shown}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": list(features([t or "" for t in b["text"]], learned))})

    got = sorted((r["doc_id"], r["label"], r["x"]) for r in rows.select("doc_id", "label", "text").mapInPandas(work, "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in got]).reshape(len(got), features([""], learned).shape[1])
    return ToxicityModel(learned, *calibrated_trees(x, np.array([r[1] for r in got], np.float64)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, toxic_from: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    A null text counts as empty and has a score like any other; null ids stay; repeated rows stay, each scored alike; further columns are
    ignored; an empty table gives an empty result. A map over Arrow batches: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # trees of fixed size and a lexicon of a bounded sample

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            x = features([t or "" for t in b["text"]], m.learned)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": m.calibration(m.trees.margin(x)) if len(b) else []})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, "doc_id long, score double")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), HELD_MOD) == HELD_REST).alias("held_out"), "score", (F.col("score") >= toxic_from).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
