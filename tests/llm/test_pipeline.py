"""The pipeline and the registered queries on small tables."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import minhash, registry
from tests.compare import both, views

SF = "/root/testdata/sf0.001"


def words(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_chat_sql(spark):
    got, want = both(spark, views(SF), registry.QUERIES["op6_chat"], registry.SQL["op6_chat"], SF)
    assert got == want


def test_pipeline(spark, tmp_path):
    leak = words(999, 25)
    rows = [(i, words(i)) for i in range(60)]
    rows += [(100 + k, words(0) + " end" * (k + 1)) for k in range(3)]  # near copies of 0
    rows += [(200, words(201) + " " + leak + " " + words(202)), (201, words(203) + " token = 0123456789abcdef0123456789abcdef")]
    rows += [(300 + k, " ".join(x.upper() + "!!" for x in words(400 + k).split())) for k in range(60)]  # of low quality
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out-{name}"))
        at = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    good = {i for i, _ in rows if i < 300}
    assert kept["quality"] >= good and len(kept["quality"] - good) <= 6
    near = {r["doc_id"] for r in minhash.near_documents(spark.read.parquet(str(tmp_path / "out-quality")), minhash.Similarity(80)).filter("kept").collect()}
    assert kept["near duplicates"] == near and not near & {100, 101, 102} and 0 in near
    assert kept["leaks"] == near - {200} and kept["secrets"] == kept["tokens"] == kept["leaks"]
    clean = spark.read.parquet(str(tmp_path / "out-secrets")).filter("doc_id = 201").first()
    assert "0123456789abcdef" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == kept["tokens"]
    assert at.filter(~F.col("round_trip")).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_without_both_labels_keeps_all(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    d = spark.createDataFrame([(i, words(i), "en", "s", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows in (("held", [(i, i % 2, 0) for i in held]), ("zeros", [(i, 0, 0) for i in range(200)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.quality(spark, d, str(tmp_path / name)).count() == 200


def test_pipeline_with_nulls_and_further_columns(spark, tmp_path):
    rows = [(i, words(i), "en", "s", 1, "c", 0.5, 1) for i in range(80)] + [(None, words(900), None, None, None, None, None, None), (500, None, None, None, None, "c", None, 2), (501, "", "en", "s", 0, None, 1.0, None)]
    rows += [(7, words(7), "en", "s", 1, "again", 0.5, 1), (502, words(502, 30_000), "en", "s", 1, "long", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _clean string, score double, label int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0, None) for i in range(0)], "doc_id long, quality int, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None, 5), (None, words(999, 20), 6)], "item_id long, text string, doc_id int").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out-{name}"))
        at = spark.read.parquet(str(tmp_path / f"out-{name}"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in at.select("doc_id").collect())
    assert got == sorted([(False, i) for i in [*range(80), 500, 501, 502]] + [(True, 0)])
    assert {r["doc_id"]: r["n_tokens"] for r in at.filter("doc_id >= 500").collect()}[500] == 0
    kept = spark.read.parquet(str(tmp_path / "out-secrets")).filter("doc_id = 502").first()
    assert kept["_clean"] == "long" and kept["text"] == words(502, 30_000)
