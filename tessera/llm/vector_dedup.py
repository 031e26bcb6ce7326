"""Near-duplicate vectors by an index of pivots.

A vector is at home in the list of its nearest reference point, and a guest in that of each other point whose border with its own is near
enough for a link to cross it. Of two vectors that link, one stands in the list where the other is at home, so no link is lost; within a list
those at home meet each other and the guests, and their cosine in double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, sample_by_hash, table

#: Reference points: this many per label at least, and one for PER_LIST vectors of the table, up to MOST_PIVOTS (a broadcast of bounded size).
LEAST_PIVOTS, PER_LIST, MOST_PIVOTS = 64, 64, 16384
#: Pivots are so many times the distance of a link apart at least: a crowd of near copies has one, not one for each PER_LIST of them.
APART = 3
#: Rounding of a product of unit vectors, with room to spare.
ROUNDING = 1e-9
#: Vectors of a list that are compared in one piece of work; longer lists are dealt out in pairs of such pieces.
BLOCK = 512


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that may link, with the smallest id and the number of rows that are alike: ``label, embedding, key, rep, copies``.

    Null, empty and zero vectors, those with a null or non-finite component, and rows without a label link with nothing."""
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).filter(~bad).filter(F.exists("e", lambda x: x != 0))
    return rows.groupBy("label", F.col("e").alias("embedding")).agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("label", "embedding"))


def describe(distinct: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``distinct`` with ``near``: the number of the nearest pivot of the vector's dimension, then those of the pivots where it is a guest.

    A link between vectors with different homes crosses the border (the plane midway) of the two pivots, so one of the vectors is within half
    the link's angle of it."""
    held, reach = distinct.sparkSession.sparkContext.broadcast(pivots), np.sqrt(max(0.0, 1 - cosine) / 2)  # the sine of half the angle

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["embedding"].map(len)
            for d, part in b.groupby(size):
                p = held.value.get(int(d))
                x = unit_rows(part["embedding"])
                near = [[0]] * len(part)
                if p is not None and len(p):
                    near = []
                    for k in range(0, len(x), 256):
                        c = x[k : k + 256] @ p.T
                        home = c.argmax(1)  # ties go to the pivot of the smaller number
                        between = np.sqrt(np.maximum(0, 2 - 2 * (p[home] @ p.T)))
                        guest = c.max(1, keepdims=True) - c <= reach * between + ROUNDING
                        near += [[int(h), *(int(g) for g in np.flatnonzero(r) if g != h)] for h, r in zip(home, guest, strict=True)]
                yield part.assign(near=near)

    return distinct.withColumn("label", F.col("label").cast("long")).mapInPandas(work, "label long, embedding array<double>, rep long, copies long, key long, near array<int>")


def spread(x: np.ndarray, cosine: float) -> np.ndarray:
    """The rows of ``x`` in order, without those that have a greater cosine with one taken before."""
    taken = np.zeros_like(x)
    n = 0
    for row in x:
        if not n or (taken[:n] @ row).max() <= cosine:
            taken[n] = row
            n += 1
    return taken[:n]


def choose_pivots(distinct: DataFrame, n: int, seed: int, cosine: float) -> dict[int, np.ndarray]:
    """Unit vectors of the ``n`` rows with the smallest hash of their id, by dimension: a bounded sample, less those that crowd."""
    out: dict[int, list] = {}
    for r in sample_by_hash(distinct.select("rep", "embedding"), "rep", n, seed).collect():
        out.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {d: spread(unit_rows(pd.Series(v)), max(0.0, 1 - APART**2 * (1 - cosine))) for d, v in out.items()}


def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each node's smallest known relative) after the links i-j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = a[apart], b[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root = root[root]


def compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within one piece, or between two: for each vector the rows linked there, and its root there."""
    x, ids, keys, copies = unit_rows(pdf["embedding"]), pdf["rep"].to_numpy(), pdf["key"].to_numpy(), pdf["copies"].to_numpy().astype(np.float64)
    pivot, side = int(pdf["pivot"].iloc[0]), pdf["side"].to_numpy()
    posted = np.full((len(x), pdf["near"].map(len).max()), -1)
    for r, ps in enumerate(pdf["near"]):
        posted[r, : len(ps)] = ps
    home = posted[:, 0]
    own = home == pivot
    if int(pdf["p"].iloc[0]) == int(pdf["q"].iloc[0]):
        meet = [(np.flatnonzero(own), np.flatnonzero(own), True), (np.flatnonzero(own), np.flatnonzero(~own), False)]
    else:
        meet = [(np.flatnonzero(own & (side == 0)), np.flatnonzero(side == 1), False), (np.flatnonzero(~own & (side == 0)), np.flatnonzero(own & (side == 1)), False)]
    links, root = np.zeros(len(x)), np.arange(len(x))
    for left, right, alone in meet:
        for k in range(0, len(left) if len(right) else 0, 256):
            a = left[k : k + 256]
            c = x[a] @ x[right].T
            ok = c >= cosine
            r, s = np.nonzero(np.abs(c - cosine) < ROUNDING)
            ok[r, s] = np.einsum("ij,ij->i", x[a[r]], x[right[s]]) >= cosine
            if alone:
                ok &= a[:, None] < right[None, :]
            r, s = np.nonzero(ok & (home[a][:, None] != home[right][None, :]))
            i, j = a[r], right[s]
            host, guest = np.where(own[i], i, j), np.where(own[i], j, i)
            twice = (home[guest] < pivot) & (posted[host] == home[guest][:, None]).any(1)  # met in the guest's home too: counts where the number is smaller
            ok[r[twice], s[twice]] = False
            links[a] += ok @ copies[right]
            links[right] += copies[a] @ ok
            r, s = np.nonzero(ok)
            root = join(root, a[r], right[s])
    at = np.flatnonzero(links)
    return pd.DataFrame({"rep": ids[at], "key": keys[at], "links": links[at].astype(np.int64), "root": ids[root[at]]})


def near_vectors(vectors: DataFrame, cosine: float = 0.98, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label).

    Linked are different rows of one label (not null) with cosine >= ``cosine`` in double precision. Like vectors are compared once and
    counted by their number of rows. Null, empty and zero vectors and those with null or non-finite components have no links and are their own
    component; vectors of different lengths link with nothing; a null id has null component and kept. Repeated ids share their component,
    and count as other rows. Further columns are ignored; an empty table gives an empty result.

    A list is worked in pieces of BLOCK vectors, a pair of pieces being one task's group, and a piece gives a count and a root for each of
    its vectors, never the pairs, so neither a common vector nor a crowded pivot is a hot task. No link is missed."""
    distinct = cut(usable(vectors))
    n = distinct.count()
    labels = F.approx_count_distinct("label")
    n_labels = max(1, distinct.agg(labels).first()[0])
    pivots = choose_pivots(distinct, min(MOST_PIVOTS, max(LEAST_PIVOTS, n // (PER_LIST * n_labels))), seed, cosine)
    known = cut(describe(distinct, pivots, cosine))
    known = known.withColumn("dim", F.size("embedding"))
    spots = known.select("label", "dim", F.explode("near").alias("pivot"))
    pieces = spots.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    posted = known.withColumn("pivot", F.explode("near")).join(pieces, ["label", "dim", "pivot"]).withColumn("own", F.pmod("key", F.col("pieces")).cast("int"))
    # piece p meets itself and every other piece once: as the left side with those after it, as the right side with those before it
    meets = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda q: F.struct(F.least(q, F.col("own")).alias("p"), F.greatest(q, F.col("own")).alias("q"), F.when(F.col("own") > q, 1).otherwise(0).alias("side")))
    work = posted.withColumn("m", F.explode(meets)).select("label", "dim", "pivot", "m.p", "m.q", "m.side", "rep", "key", "copies", "embedding", "near")
    found = cut(work.groupBy("label", "dim", "pivot", "p", "q").applyInPandas(lambda pdf: compare(pdf, cosine), "rep long, key long, links long, root long"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep", "key").agg(F.sum("links").alias("links"))
    of_rep = distinct.join(links, ["rep", "key"], "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = of_rep.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    out = rows.join(of_rep, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").cast("long").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
