"""What the operators of this subpackage share: reading, cutting lineage, bounded samples, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by the only path that works for every store: Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    A folder of its own is set only where none is configured and one machine does all the work; a cluster without one is an error, as its
    executors would not see each other's files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def sample_by_hash(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest seeded hash of ``key``: the same rows however the table is laid out."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_mod: int, held_rest: int, limit: int, seed: int, columns: list[str]) -> DataFrame:
    """A bounded labelled sample: ``columns`` (doc_id first) of the documents and ``label`` (0 or 1), one row for each id.

    Rows whose crc32(doc_id) leaves ``held_rest`` modulo ``held_mod`` never take part. Several labels of one document count by their
    greatest; of several rows of one id the least counts, so ``limit`` bounds the rows that a fit may collect, however often an id
    repeats, and the side that is broadcast here too."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), held_mod) != held_rest))
    known = sample_by_hash(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "doc_id", limit, seed)
    rows = docs.select(*columns).join(F.broadcast(known), "doc_id")
    rest = [c for c in rows.columns if c not in ("doc_id", "label")]
    if not rest:
        return rows.distinct()
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[F.col("row")[c].alias(c) for c in rest], "label")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component being its smallest node.

    Alternates large-star and small-star contraction: each round hangs every node's greater neighbours, then its smaller ones, under the
    smallest node it sees. Only minima are grouped, by partial aggregation, so a hub with millions of links is no hot task. Each round is
    checkpointed, and the rounds needed grow with the logarithm of the longest path; they end when one changes nothing."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        new = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == sign:
            break
        sign = new
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
