"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set of word shingles is hashed by one function; its sketch is the k smallest values. Inverted lists of the retained values
give pairs that overlap, the sketch of a pair's union estimates their similarity and filters, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, free_name, table

#: Clusters of at most this many documents are joined whole; larger ones are dealt out in pieces of so many documents and shingles, which meet two
#: by two. Columns of shared shingles are multiplied so many at a time.
SMALL, BLOCK, PIECE, COLUMNS = 16, 512, 250_000, 4096
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Similarity:
    """``percent``: least 100 * |intersection| / |union| of a link; ``words`` in a shingle; ``k`` values in a sketch; a pair right at the
    threshold is lost with a chance of at most ``miss``, by the binomial tail of what its union's sketch shares."""

    percent: int = 85
    words: int = 5
    k: int = 64
    miss: float = 1e-9

    @property
    def least_shared(self) -> int:
        """Values that the sketches of a link share but for a chance of ``miss``: of the k values of the side whose sketch ends first, each is its own
        alone with a chance of at most 1 - J, as where it contains the other side."""
        alone = (100 - self.percent) / 100
        p, upto = (1 - alone) ** self.k, 0.0
        for x in range(self.k):
            upto += p
            if 1 - upto <= self.miss / 2:
                return self.k - x
            p *= (self.k - x) / (x + 1) * alone / (1 - alone)
        return 0

    @property
    def least_in_union(self) -> int:
        """Values shared among the k smallest of a union that a link has but for a chance of ``miss``."""
        j, p, below = self.percent / 100, (1 - self.percent / 100) ** self.k, 0.0
        for x in range(self.k):
            below += p
            if below > self.miss:
                return x
            p *= (self.k - x) / (x + 1) * j / (1 - j)
        return self.k

    @property
    def whole(self) -> int:
        """Sets up to this size, and every set they can link with, fit a sketch whole."""
        return self.k * self.percent // 100


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising. A-Z are lower-cased; words are runs of anything but the six ASCII white spaces; with
    fewer words than a shingle has, all of them are one shingle; without a word there is none."""
    w = text.encode().lower().split()  # bytes: exactly A-Z and \x20 \x09-\x0D
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def sketches(docs: DataFrame, how: Similarity) -> DataFrame:
    """``doc_id, n, print, sketch`` of every row: the size of its set, a digest of the whole set, and its k smallest hashes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_hashes(t or "", how.words) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "print": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[: how.k] for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, "doc_id long, n long, print string, sketch array<long>")


def whole_sets(docs: DataFrame, how: Similarity) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc_id"], "set": [shingle_hashes(t or "", how.words) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, "doc long, set array<long>")


def semi(rows: DataFrame, ids: DataFrame, n: int, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """``rows`` whose key is (or, anti, is not) among the ``n`` ids: by broadcast while there are few, else by a shuffle."""
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def may_link(pairs: DataFrame, known: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (a, b) that their sketches let pass: the k smallest of the union hold an unbiased estimate of the similarity, which may fall
    short of the threshold by what chance explains. Where both sets are whole in their sketches this is exact."""
    side = lambda c, s, n: known.select(F.col("rep").alias(c), F.col("sketch").alias(s), F.col("n").alias(n))
    both = pairs.join(side("a", "sa", "na"), "a").join(side("b", "sb", "nb"), "b")
    both = both.filter((100 * F.least("na", "nb") >= how.percent * F.greatest("na", "nb"))).withColumn("i", F.array_intersect("sa", "sb"))
    u = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, how.k)
    exact = (F.col("na") <= how.k) & (F.col("nb") <= how.k)
    i = F.size("i")
    passes = F.when(exact, 100 * i >= how.percent * (F.col("na") + F.col("nb") - i)).otherwise(F.size(F.array_intersect("i", u)) >= how.least_in_union)
    return both.filter(passes).select("a", "b").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("t")), "b")
    i = F.size(F.array_intersect("s", "t"))
    return both.filter(100 * i >= percent * (F.size("s") + F.size("t") - i)).select("a", "b").distinct()


def postings(known: DataFrame, how: Similarity) -> DataFrame:
    """``v, rep, weight``: each set's rarest retained values that other sets retain too.

    A link shares so many retained values that it shares one among the rarest of either side, rarest by the length of the inverted lists
    (prefix filter): a passage that many documents hold gives no list unless it is most of a document. ``weight`` adds up the lengths of
    a set's lists: it is greatest for the middle of a group of copies."""
    each = known.select("rep", "print", "n", F.explode("sketch").alias("v"))
    shared = each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    mine = each.join(shared, "v").groupBy("rep", "print", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"), F.sum("df").alias("weight"))
    kept = F.least(F.col("n"), F.lit(how.k))
    need = F.when(F.col("n") <= how.whole, F.ceil(F.col("n") * how.percent / 100)).otherwise(F.lit(how.least_shared))
    rare = kept - need + 1 - (kept - F.size("s"))  # values that no other set retains come first and post nothing
    return mine.withColumn("rare", rare.cast("int")).filter("rare > 0").select(F.explode(F.expr("slice(s, 1, rare)")).alias("p"), "rep", "weight").select("p.v", "rep", "weight")


def clusters(lists: DataFrame) -> DataFrame:
    """``pivot, rep, size``: each list's documents under its pivot, the document of the greatest weight. Lists of one group of copies have the same few
    pivots, so a document stands in a few clusters rather than in dozens of lists, and two that share a list share its cluster."""
    pivots = lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("m"))).alias("p"), F.count("*").alias("size")).filter("size > 1").select("v", (-F.col("p.m")).alias("pivot"))
    members = lists.select("v", "rep").join(pivots, "v").select("pivot", "rep").distinct()
    return members.join(members.groupBy("pivot").agg(F.count("*").alias("size")), "pivot")


def pairs_of(small: DataFrame) -> DataFrame:
    """Pairs within small clusters: at most SMALL - 1 for each membership."""
    a, b = small.select("pivot", F.col("rep").alias("a")), small.select("pivot", F.col("rep").alias("b"))
    return a.join(b, "pivot").filter("a < b").select("a", "b").distinct()


def forest(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that join what the links i-j join, fewer than there are nodes."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    found = [(root(a), a) for a in up]
    return [a for a, b in found if a != b], [b for a, b in found if a != b]


def linked_in_pieces(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs that join what the links within large clusters join, decided on whole sets.

    A cluster is dealt out in pieces, each of which meets every other once, in a group of its own; a product of 0/1 rows over the shingles that
    the group shares counts intersections. A group gives a spanning forest of its links, never the pairs. A cluster of several pieces is
    first compared with its pivot alone: documents that link with it are in one class already, so their pieces meet only the rest's."""
    whole = sets.select(F.col("doc").alias("rep"), "set")
    members = cut(large.select("pivot", "rep").join(whole.select("rep", F.size("set").alias("n")), "rep"))
    pieces_of = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / PIECE)).cast("int")
    several = members.groupBy("pivot").agg(pieces_of(F.lit(True)).alias("pieces")).filter("pieces > 1")
    star = cut(linked_to_pivot(members.join(several, "pivot"), several, whole, percent))
    members = members.join(star.withColumn("linked", F.lit(True)), ["pivot", "rep"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    n = members.groupBy("pivot").agg(pieces_of(~F.col("linked")).alias("rest"), pieces_of(F.col("linked")).alias("near")).filter("rest > 0")
    piece = lambda k: F.pmod(F.xxhash64("rep", "pivot"), F.greatest(F.col(k), F.lit(1))).cast("int")
    dealt = members.join(n, "pivot").withColumn("own", F.when(F.col("linked"), F.col("rest") + piece("near")).otherwise(piece("rest"))).join(whole, "rep")
    last = F.when(F.col("linked"), F.col("rest")).otherwise(F.col("rest") + F.col("near")) - 1
    meets = F.transform(F.sequence(F.lit(0), last), lambda q: F.struct(F.least(q, F.col("own")).alias("p"), F.greatest(q, F.col("own")).alias("q")))
    dealt = dealt.withColumn("m", F.explode(meets)).select("pivot", "m.p", "m.q", "own", "rep", "set")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own, size = pdf["rep"].to_numpy(), pdf["own"].to_numpy(), pdf["set"].map(len).to_numpy()
        values, at, n = np.unique(np.concatenate(pdf["set"].to_list()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(pdf)), size)
        shared = n[at] > 1
        column = (np.cumsum(n > 1) - 1)[at[shared]]
        row, order = row[shared], np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(pdf), len(pdf)), np.float32)
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [k, k + COLUMNS])
            has = np.zeros((len(pdf), COLUMNS), np.float32)
            has[row[a:b], column[a:b] - k] = 1
            common += has @ has.T
        ok = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        i, j = np.nonzero(np.triu(ok, 1))
        if pdf["p"].iloc[0] != pdf["q"].iloc[0]:
            i, j = i[own[i] != own[j]], j[own[i] != own[j]]
        a, b = forest(ids[i], ids[j])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    links = dealt.groupBy("pivot", "p", "q").applyInPandas(work, "a long, b long")
    return links.unionByName(star.filter("pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))


def linked_to_pivot(members: DataFrame, several: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``pivot, rep`` of the members (pivot, rep, pieces) whose whole set links with their pivot's, the pivot itself among them. The pivot's set goes
    once to each piece of its cluster, so that no task gets a whole one."""
    pivots = several.select("pivot", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(whole.select(F.col("rep").alias("pivot"), F.col("set").alias("of_pivot")), "pivot")
    both = members.withColumn("piece", F.pmod(F.xxhash64("rep", "pivot"), F.col("pieces")).cast("int")).join(whole, "rep").join(pivots, ["pivot", "piece"])
    i = F.size(F.array_intersect("set", "of_pivot"))
    return both.filter(100 * i >= percent * (F.size("set") + F.size("of_pivot") - i)).select("pivot", "rep")


def link_classes(docs: DataFrame, known: DataFrame, how: Similarity) -> DataFrame:
    """``rep, component`` of the sets that link with another. ``known``: one row for each distinct set, ``rep, n, print, sketch``.

    Small clusters are joined whole, filtered by their sketches and confirmed on their sets; large ones are decided on their sets in pieces.
    No pair that shares a list is left out, whatever the size of a group."""
    found = cut(clusters(cut(postings(known, how))))
    pairs = cut(may_link(pairs_of(found.filter(F.col("size") <= SMALL)), known, how))
    large = found.filter(F.col("size") > SMALL)
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(large.select(F.col("rep").alias("doc_id"))).distinct())
    sets = cut(whole_sets(semi(docs, ids, ids.count()), how).distinct())
    links = confirm(pairs, sets, how.percent).unionByName(linked_in_pieces(large, sets, how.percent))
    return components(links).select(F.col("node").alias("rep"), "component")


def near_documents(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Sets that are alike are one node, its id their smallest doc_id, so a group of exact copies of any size costs one row after a partial
    aggregation. Null and empty texts, and texts of white space, have an empty set, no links, and are their own component. Rows with a null
    id have a null component and kept and link nothing. A repeated row gives a row each time; a repeated id with other texts has a
    row for each, and is one node where it is the smallest of a group. Further columns are ignored; an empty table gives an empty result."""
    each = cut(sketches(docs, how))
    known = cut(each.filter("doc_id is not null and n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    classes = link_classes(docs, known, how)
    of = known.select("print", "rep").join(classes, "rep", "left").select("print", F.coalesce("component", "rep").alias("c"))
    out = each.select("doc_id", "n", "print").join(of, "print", "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), (c == F.col("doc_id")).alias("kept"))


def drop_near(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``docs`` without the rows that a near-duplicate of smaller id stands for: one document of each class stays, with all its columns.

    Rows with a null id stay. Where ids repeat, rows are numbered in the order of their ids and each is decided for itself: of rows with one id
    those go whose text is a near-duplicate of a row before them."""
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return without_copies(docs, docs, "doc_id", how)
    row = free_name(docs, "_row")
    rows = cut(named.orderBy("doc_id", F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()))
    left = without_copies(rows, rows.select(F.col(row).alias("doc_id"), "text"), row, how)
    return left.drop(row).unionByName(docs.filter("doc_id is null"))


def without_copies(rows: DataFrame, docs: DataFrame, key: str, how: Similarity) -> DataFrame:
    """``rows`` whose key is not that of one of the ``docs`` for which another stands."""
    gone = cut(near_documents(docs, how).filter("not kept").select(F.col("doc_id").alias(key)).distinct())
    return semi(rows, gone, gone.count(), key, "left_anti")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))
