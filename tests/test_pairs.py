"""All pairs by blocks against their SQL, and in time."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftlens.operators import pairs
from driftlens.plans import catalog


@pytest.mark.parametrize("name", ["q_kernel_linear", "q_dissimilarity"])
def test_pairs_with_copies_and_null_vectors(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [r.tolist() for r in rng.normal(size=(40, 5)).astype("float32")]
    rows[11], rows[12], rows[20:30] = rows[3], None, [None] * 10
    pd.DataFrame({"vec_id": np.arange(40), "embedding": rows, "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM '{tmp_path}/embeddings.parquet'")
    value = "k" if name == "q_kernel_linear" else "d"
    want = {(i, j): v for i, j, v in con.execute(f"SELECT i, j, {value} FROM ({catalog.ORACLE_SQL[name]})").fetchall()}
    got = {(r.i, r.j): r[value] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == 1600 and got == want


@pytest.mark.parametrize("name", ["q_kernel_linear", "q_dissimilarity"])
def test_four_million_pairs_take_seconds(spark, name):
    start = time.monotonic()
    catalog.QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
    assert time.monotonic() - start < 30


def test_each_pair_is_valued_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(1000, 3)))], "t long, x array<double>").repartition(2)
    work = spark.sparkContext.accumulator(0)

    def kernel(a, b, *_):
        work.add(len(a) * len(b))
        return a @ b.T

    got = pairs.all_pairs(rows, kernel, "v", 5).distinct().count()
    assert got == 1_000_000 and work.value <= 540_000


def test_distances_by_products_are_those_from_differences():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(60, 8)), rng.normal(size=(70, 8))
    b[:9] = a[:9]  # copies, near copies, halves, rows far from 0, rows that have no number
    b[9:18] = a[9:18] + 1e-7 * rng.normal(size=(9, 8))
    a[20:24], b[20:24] = 0, 0
    b[20:24, 0] = [0.5 / 2**5, 1.5 / 2**5, 1 / 64, 3 / 64]
    a[30:33] += 1e8
    b[30:33] += 1e8
    a[40, 0], b[41, 1], a[42, 2], b[43] = np.nan, np.inf, -np.inf, 1e200
    with np.errstate(all="ignore"):
        d = np.sqrt(((a[:, None] - b) ** 2).sum(2)) * 1e5
        want = np.trunc(d + 0.5) / 1e5
    assert np.array_equal(pairs.distances(a, b, 5), want, equal_nan=True)


@pytest.mark.parametrize("decimals", [0, 5])
def test_distances_take_differences_only_where_they_must(monkeypatch, decimals):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(300, 64))
    b[7] = a[3]
    monkeypatch.setattr(pairs, "PIECE", 64)
    assert pairs.distances(a, b, decimals)[3, 7] == 0
    monkeypatch.setattr(pairs, "PIECE", 0)  # a step of one pair
    start = time.monotonic()
    pairs.distances(a, b, decimals)
    assert time.monotonic() - start < 0.5


def test_both_ways_of_a_pair_are_stored_about_once(spark, tmp_path):
    catalog.QUERIES["q_kernel_linear"](spark, "/root/testdata/sf0.1").write.parquet(str(tmp_path / "k"))
    assert sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")) < 3 * 2000**2
