"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os
import re

import duckdb
import pytest

from meridian import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    sql = q.ORACLE_SQL[name]
    want = db.sql(sql if isinstance(sql, str) else sql())
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    pick = lambda rows, names: sorted((tuple(r[names.index(c)] for c in cols) for r in rows), key=repr)
    got, expected = pick([tuple(r) for r in df.collect()], df.columns), pick(want.fetchall(), want.columns)
    assert len(got) == len(expected) and got
    assert all(close(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(q.ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["doy", "cell", "n", "clim_mean", "p90"]


def test_report_files(spark, sf_dir, tmp_path):
    from meridian.operators.validate import write_report

    write_report(q.rmse_daily(spark, sf_dir), str(tmp_path))
    lines = spark.read.text(f"{tmp_path}/RMSE_clim_daily").collect()
    assert len(lines) == 92 and all("." in r.value for r in lines)
    mean = sum(r.rmse_p90 for r in q.rmse_daily(spark, sf_dir).collect()) / 92
    assert [r.value for r in spark.read.text(f"{tmp_path}/RMSE_P90").collect()] == [f"{mean:.4f}"]


def test_gaps_of_every_cell_are_reported(spark, sf_dir):
    held = {(r.cell, r.year, r.doy) for r in q._li(spark, sf_dir).select("cell", "year", "doy").collect()}
    want = {(c, y): sum((c, y, d) not in held for d in range(147, 249)) for c in {c for c, _, _ in held} for y in range(1995, 2002)}
    assert {(r.cell, r.year): r.failed for r in q.missing_cell_report(spark, sf_dir).collect()} == {k: n for k, n in want.items() if n}


def test_anchors_alone_are_expanded_and_dealt_by_cell(spark, sf_dir):
    from meridian.operators import climatology as clim
    from meridian.operators import interpolate

    days = interpolate.anchors(clim.SEASON, 7)
    rows = clim.in_windows(q._li(spark, sf_dir), days=days, by_cell=True)
    assert {r.target for r in rows.select("target").distinct().collect()} == set(days) and len(days) == 14
    plan = clim.climatology(q._li(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(cell#\d+, \d+\)", plan)) == 1 and "hashpartitioning(target" not in plan


def test_stage_metrics(spark):
    from meridian.operators.metrics import StageMetrics

    m = StageMetrics()
    df = m.watch("read", spark.createDataFrame([(1, None), (2, 3.0)], "cell int, v double"), "v")
    assert m.timed("count", lambda: len(df.collect())) == 2
    assert m.report() == {"read": {"rows": 2, "v": 1}} and m.seconds["count"] > 0
