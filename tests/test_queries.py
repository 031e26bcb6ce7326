import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog
from tests.compare import both, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, con, name):
    got, want = both(spark, con, entry.queries()[name], catalog.SQL[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert sum(got[1].values()) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_deviation_is_of_all_frames(spark, tmp_path):
    n = 240_000  # 120,000 frames of each channel
    x = np.random.default_rng(12).standard_normal((n, 2)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    got = {r["pixel_id"]: r["value"] for r in entry.queries()["std_projection"](spark, str(tmp_path)).collect()}
    want = (1000 + 100 * x[::2].astype(np.float64)).std(0)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in range(2))
    keep = {r["pixel_id"]: r["keep"] for r in entry.queries()["percentile_threshold"](spark, str(tmp_path)).collect()}
    assert keep == {k: bool(k == want.argmax()) for k in range(2)}


@pytest.mark.parametrize("name", ["preprocess", "svd_components"])
def test_no_matrix_of_all_bins_reaches_the_driver(spark, tmp_path, monkeypatch, name):
    """80 bins or more of 64 pixels."""
    x = np.random.default_rng(13).standard_normal((1200, 64)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(1200), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    seen, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda c: seen.append(len(c)) or eigh(c))
    assert entry.queries()[name](spark, str(tmp_path)).count() in (64, 4096) and seen and max(seen) <= 64
