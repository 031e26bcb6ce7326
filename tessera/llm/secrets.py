"""Secrets in texts: fixed patterns, and tokens that a character Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, sample_by_hash, table

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of any length of which those under 32 are dropped
KINDS = ("assign", "access", "hex", "markov")
#: Tokens the models judge: runs of key characters, of letters alone too; a run of digits alone is a number. Of fewer characters no ratio would do.
MIN_TOKEN = 12
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"  # digits first
CODE = {c: k for k, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1  # and a mark for a token's start
#: The bounds of the fit: documents that give identifiers and labelled secrets, and drawn random strings of each alphabet.
TRAIN_DOCS, DRAWN = 2000, 4000
#: Weight of ordinary strings in capitals, few of which a sample may hold.
CAPITALS = 0.1
#: Log-likelihood ratio (nats) from which a token counts as random: a mean for each character, and a sum that outweighs the odds of some ten
#: million ordinary tokens to one secret.
RATIO, EVIDENCE = 0.9, 16.0
#: Each code point's number in ALPHABET, others -1; and whether it is a digit.
CODES = np.full(129, -1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def pairs_in(tokens: list[str]) -> np.ndarray:
    """Counts of character pairs, by the first and then the second, flattened."""
    out = np.zeros(SIZE * SIZE, np.int64)
    for t in tokens:
        c = np.fromiter((CODE.get(x, -1) for x in t), np.int64, len(t))
        c = c[c >= 0]
        if len(c):
            out += np.bincount(np.concatenate([[SIZE - 1], c[:-1]]) * SIZE + c, minlength=SIZE * SIZE)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def drawn_strings(n: int, seed: int) -> list[str]:
    """Random strings as keys have them: base 64, base 62, upper case with digits, hexadecimal, letters."""
    rng = np.random.default_rng(seed)
    sets = [ALPHABET[:62] + "+/", ALPHABET[:62], ALPHABET[:62] + "_-", ALPHABET[:36], "0123456789abcdef", ALPHABET[10:62]]
    return ["".join(np.array(list(s))[rng.integers(0, len(s), 32)]) for s in sets for _ in range(n // len(sets))]


def fit_markov(docs: DataFrame, n_docs: int = TRAIN_DOCS, drawn: int = DRAWN, seed: int = 8) -> np.ndarray:
    """The log-likelihood ratio of each pair of characters, random over ordinary.

    Labelled samples: strings that the fixed patterns mark, and ``drawn`` seeded random ones, are random; every other run of key characters
    of the ``n_docs`` documents with the smallest hash of their id is ordinary, as it stands and in capitals. Two tables of pair counts are all that reaches the driver."""
    ids = F.broadcast(sample_by_hash(docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", n_docs, seed))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        secret, plain = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        for b in batches:
            for text in b["text"]:
                if text:
                    marked = base_spans(text)
                    secret += pairs_in([text[s:e] if k else text[s:e].split("=")[-1].split(":")[-1].strip(" \"'") for s, k, e in marked])
                    for s, _, e in reversed(marked):
                        text = f"{text[:s]} {text[e:]}"
                    plain += pairs_in(re.findall(r"[A-Za-z0-9+/_=-]{4,}", text))
        at = np.flatnonzero(secret + plain)
        yield pd.DataFrame({"at": at, "secret": secret[at], "plain": plain[at]})

    counts = docs.select("doc_id", F.col("text").cast("string")).join(ids, "doc_id").select("text").mapInPandas(count, "at int, secret long, plain long")
    secret, plain = pairs_in(drawn_strings(drawn, seed)), np.zeros(SIZE * SIZE, np.int64)
    for r in counts.groupBy("at").agg(F.sum("secret").alias("s"), F.sum("plain").alias("p")).toLocalIterator():
        secret[r["at"]] += r["s"]
        plain[r["at"]] += r["p"]
    return log_rows(secret) - log_rows(plain + CAPITALS * in_capitals(plain))


def in_capitals(counts: np.ndarray) -> np.ndarray:
    """Counts of the same pairs with their letters in upper case: what shouting and constants do to ordinary words."""
    code = np.arange(SIZE)
    code[36:62] -= 26
    out = np.zeros((SIZE, SIZE))
    np.add.at(out, (code[:, None], code[None, :]), counts.reshape(SIZE, SIZE))
    return out.ravel()


def log_rows(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log-probabilities of the second character after the first, drawn to the characters' own frequencies where pairs are few."""
    c = counts.reshape(SIZE, SIZE).astype(np.float64)
    single = (c.sum(0) + 0.5) / (c.sum(0) + 0.5).sum()
    return np.log((c + weight * single) / (c.sum(1, keepdims=True) + weight))


def random_runs(text: str, model: np.ndarray) -> list[tuple[int, int]]:
    """The runs of key characters that the models take for random strings: all of a text's are judged at once."""
    code = CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    edges = np.flatnonzero(np.diff(code >= 0, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    long = end - start >= MIN_TOKEN
    if not long.any():
        return []
    before = np.concatenate([[-1], code[:-1]])
    upto = np.append(0.0, np.cumsum(model[np.where(before < 0, SIZE - 1, before), np.maximum(code, 0)]))  # what stands between runs cancels out
    letters = np.append(0, np.cumsum((code >= 10) & (code < 62)))
    start, end = start[long], end[long]
    total = upto[end] - upto[start]
    found = (total >= EVIDENCE) & (total >= RATIO * (end - start)) & (letters[end] > letters[start])
    return list(zip(start[found].tolist(), end[found].tolist(), strict=True))


def all_spans(text: str, model: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with the models' spans added. Base spans stay; a token that touches one adds none."""
    base = base_spans(text)
    added = [(a, 3, b) for a, b in random_runs(text, model) if not any(s < b and a < e for s, _, e in base)]
    return base, sorted(base + added)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs`` (doc_id, text).

    Offsets are code points. A null or empty text has no spans: its digest is that of the empty string. Rows are worked one by one, so
    repeated rows stay, null ids stay, and further columns are ignored. A map over Arrow batches: no shuffle."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(model)  # SIZE x SIZE numbers

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                base, spans = all_spans(text or "", held.value)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, model: np.ndarray, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mark`` and n_chars counted anew where a text changed; null texts stay null. All columns
    come back in their order."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text:
                parts, at = [], 0
                for s, _, e in all_spans(text, held.value)[1]:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    new = free_name(docs, "_clean")
    done = docs.withColumn(new, clean(F.col("text").cast("string")))
    n = F.when(F.col(new).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new).cast("long")) if "n_chars" in docs.columns else None
    return done.select(*[F.col(new).alias(c) if c == "text" else n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_markov(docs))
