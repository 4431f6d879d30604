"""Every query that has SQL against DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from driftlens.plans import catalog, long_series, whole_fits  # noqa: E402, F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if n not in ("q_kernel_linear", "q_dissimilarity")])
def test_query(spark, db, name):
    df, want = catalog.QUERIES[name](spark, D), db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-5, abs=2e-5) if all(isinstance(v, (int, float)) for v in x) else x == y


def test_the_long_fit_ends_by_convergence(spark, monkeypatch):
    costs, fit = [], catalog.models.ConvexCoding.fit_long

    def kept(*args):
        out = fit(*args)
        costs.extend(out[2])
        return out

    monkeypatch.setattr(catalog.models.ConvexCoding, "fit_long", kept)
    assert catalog.QUERIES["q_gpnh_fit_long"](spark, D).count() > 0
    assert abs(costs[-1] - costs[-2]) < 1e-6


def test_the_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
