"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank (rank - u) / (rows of its source) places it in one
common order in which every stretch holds the sources in their proportions; equal cuts of that order are the shards. The offset u, in 0..1, is
the source's own, from a seeded hash, lest sources of like size step together and push the others' rows across a cut.

Law: ``rows``. Shard sizes in rows differ by one at most; equal texts are not held together, as a group of copies may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: A source is numbered by slices of its hash range, and the common order by slices of the fractional ranks; each slice is one task's, and only counts
#: are summed up. There are so many slices at least, and one for so many rows of the table.
HASH_BITS, RANK_SLICES, SLICE_ROWS = 10, 4096, 100_000


def digest(docs: DataFrame, seed: int) -> DataFrame:
    """What the order needs of each row; texts stay where they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("stratum"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))


def interleave_shards(docs: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source_rank, fraction`` for every row of ``docs`` (doc_id, text, source).

    size is the UTF-8 length of the text plus 1 (a null text has none); a null source is a stratum of its own; repeated rows each get a
    slot of their own; rows alike in all these columns are interchangeable; an empty table gives an empty result; further columns are
    ignored. No task holds a whole source: a slice of the hash range is numbered by itself and moved by the counts of the slices before it."""
    d = cut(digest(docs, seed))
    n = d.count()
    bits, slices = max(HASH_BITS, (n // SLICE_ROWS).bit_length()), max(RANK_SLICES, n // SLICE_ROWS)
    d = d.withColumn("slice", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    in_source = Window.partitionBy("stratum").orderBy("slice")
    counts = d.groupBy("stratum", "slice").agg(F.count("*").alias("n"))
    before = counts.select("stratum", "slice", (F.sum("n").over(in_source) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("of"))
    in_slice = Window.partitionBy("stratum", "slice").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = d.withColumn("rn", F.row_number().over(in_slice)).join(before, ["stratum", "slice"])
    ranked = ranked.select("doc_id", "size", "text_crc32", "stratum", "h", (F.col("rn") + F.col("before")).alias("source_rank"), "of")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))
    ranked = ranked.withColumn("fraction", (F.col("source_rank") - offset) / F.col("of"))
    ranked = cut(ranked.withColumn("part", F.floor(F.col("fraction") * slices).cast("int")))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    everything = Window.orderBy("part")  # a row a slice
    start = parts.select("part", (F.sum("n").over(everything) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    in_part = Window.partitionBy("part").orderBy("fraction", "stratum", "h", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("rn", F.row_number().over(in_part)).join(start, "part").withColumn("at", F.col("start") + F.col("rn") - 1)
    placed = placed.withColumn("shard", F.expr(f"(at * {n_shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("source_rank").cast("long"), "fraction")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(table(spark, sf_dir, "documents"))
