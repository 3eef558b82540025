"""Stored layouts, the choice of plans, circular windows, running sums, and the stream over an archive."""

import json
import os
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian import queries as q
from meridian.operators import climatology as clim
from meridian.operators import estimators as est
from meridian.operators import sampling
from meridian.plans import choose
from meridian.plans.tiles import collected_histogram, prefix_histogram, tiled_climatology
from meridian.session import shared_folder
from meridian.sources import grid_nc, obs, store
from meridian.streaming import archive


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def li(spark, sf_dir):
    return q._li(spark, sf_dir).cache()


# stored layouts -------------------------------------------------------------------------------------
def scanned(df):
    """Rows that the scans of files of a plan that has run have given."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_days_without_a_draw_are_not_read(spark, li):
    stored = store.write_by_day(li, shared_folder(spark, "days"))
    df = sampling.sampled_climatology(stored, "packed", 6, q.YEARS, (170, 173))
    assert "dynamicpruning" in plan_of(df)
    got = rows_of(df)
    assert got == rows_of(sampling.sampled_climatology(li, "packed", 6, q.YEARS, (170, 173)))
    draws = {(r.year_idx + q.YEARS[0], r.doy) for r in sampling.sample_plan(spark, spark.range(1).select(F.lit(0).alias("unit")), "packed", 6, 6, (170, 173)).collect()}
    sampled = sum((r.year, r.doy) in draws for r in li.select("year", "doy").collect())
    assert 0 < scanned(df) == sampled < li.where("doy between 165 and 178").count() / 2


def test_stored_tiles_are_not_exchanged(spark, li):
    stored = store.write_by_tile(li, shared_folder(spark, "tiles"), 10, 4)
    df = tiled_climatology(stored, q.YEARS)
    assert "Exchange" not in plan_of(df) and "Exchange" in plan_of(tiled_climatology(li, q.YEARS, tile_cells=10))
    assert len(rows_of(df)) == clim.climatology(li).count()
    assert rows_of(q._rounded(df)) == rows_of(q._rounded(tiled_climatology(li, q.YEARS, tile_cells=10)))


@pytest.mark.parametrize("lon_major", [False, True])
def test_planes_have_every_place(spark, lon_major):
    rows = [(1995, 10, i, j, None if (i, j) == (1, 1) else float(10 * i + j)) for i in range(3) for j in range(4) if (i, j) not in ((0, 0), (1, 2), (2, 3))] + [(1996, 11, 2, 3, 7.0)]
    df = spark.createDataFrame(rows, "year int, doy int, lat_idx int, lon_idx int, v double")
    got = {(r.year, r.doy): r.plane for r in obs.packed_planes(df, 3, 4, lon_major).collect()}
    for (year, doy), plane in got.items():
        want = np.full((3, 4), None, dtype=object)
        for y, d, i, j, v in rows:
            if (y, d) == (year, doy):
                want[i, j] = v
        assert plane == (want.T if lon_major else want).ravel().tolist()
    assert len(got) == 2


def test_a_large_plane_is_packed_in_one_go(spark):
    """200,000 cells: by a search for each cell this took half an hour."""
    df = spark.range(200_000).where("id % 3 > 0").select(F.lit(1995).alias("year"), F.lit(1).alias("doy"), F.expr("cast(id div 500 as int)").alias("lat_idx"), F.expr("cast(id % 500 as int)").alias("lon_idx"), F.col("id").cast("double").alias("v"))
    began = time.time()
    (row,) = obs.packed_planes(df, 400, 500, False).collect()
    assert row.plane == [None if i % 3 == 0 else float(i) for i in range(200_000)] and time.time() - began < 120


# circular windows -----------------------------------------------------------------------------------
def test_windows_go_around_the_year(spark):
    rng = np.random.default_rng(4)
    rows = [(c, y, int(d), float(rng.normal())) for c in range(2) for y in (1995, 1996) for d in rng.permutation(np.arange(1, 366))[:300]]
    df = spark.createDataFrame(rows, "cell int, year int, doy int, v double")
    for targets in ((1, 365), (1, 3), (362, 365), (100, 101)):
        got = {(r.doy, r.cell): (r.n, r.clim_mean, r.p90) for r in clim.climatology(df, targets, circular=True).collect()}
        assert {d for d, _ in got} == set(range(targets[0], targets[1] + 1))
        for (t, c), (n, mean, p90) in got.items():
            x = [v for cell, _, d, v in rows if cell == c and min((d - t) % 365, (t - d) % 365) <= 5]
            assert n == len(x) and abs(mean - np.mean(x)) < 1e-9 and abs(p90 - np.quantile(x, 0.9)) < 1e-6
    with pytest.raises(ValueError, match="circular"):
        clim.check_targets((0, 365), circular=True)
    with pytest.raises(ValueError, match="slot"):
        clim.climatology(df, (1, 365), circular=True, zero_mask_year=1995)
    plain = clim.climatology(df, (100, 103))
    assert rows_of(plain) == rows_of(clim.climatology(df, (100, 103), circular=True))


# running sums ---------------------------------------------------------------------------------------
def test_running_sums_give_the_same_bins(spark):
    rng = np.random.default_rng(6)
    rows = [(int(c), int(d), None if v > 44 else float(v)) for c, d, v in zip(rng.integers(0, 700, 4000), rng.integers(1, 30, 4000), rng.normal(20, 14, 4000), strict=True)]
    df = spark.createDataFrame(rows, "cell int, doy int, v double")
    got = prefix_histogram(df, (6, 22), 5, tile_cells=64)
    assert "Generate" not in plan_of(got) and "Generate" in plan_of(est.fast_histogram(df, (6, 22), 5))
    assert rows_of(got) == rows_of(est.fast_histogram(df, (6, 22), 5)) and got.count() > 4000
    assert rows_of(prefix_histogram(df.limit(0), (6, 22))) == []


@pytest.mark.parametrize("most", [None, 3])
def test_values_in_order_give_the_same_ranks(spark, most):
    rng = np.random.default_rng(7)
    rows = [(int(c), int(d), None if v > 46 else round(float(v), 1)) for c, d, v in zip(rng.integers(0, 200, 4000), rng.integers(1, 30, 4000), rng.normal(20, 14, 4000), strict=True)]
    df = spark.createDataFrame(rows, "cell int, doy int, v double")
    got = collected_histogram(df, (6, 22), 5, most, tile_cells=16)
    assert "Generate" not in plan_of(got) and rows_of(got) == rows_of(est.fixed_collect(df, (6, 22), 5, most)) and got.count() > 3000
    assert rows_of(collected_histogram(df.limit(0), (6, 22))) == []


# the choice -----------------------------------------------------------------------------------------
S = choose.Settings


@pytest.mark.parametrize("settings,size,name", [
    (S((1995, 2000), sampler="source", draws=30, estimator="fixed_collect"), 1, "sampled"), (S((1995, 2000), sampler="source"), 1, "expanded"), (S((1995, 2000), estimator="fixed_collect"), 1, "collected_histogram"),
    (S((1995, 2000), estimator="fast_histogram"), 1, "prefix_histogram"), (S((1995, 2000), anchor_stride=7), 1 << 50, "anchored"), (S((1995, 2000)), 1 << 20, "expanded"), (S((1995, 2000)), 1 << 40, "tiled"),
    (S((1995, 2000), targets=(1, 365), circular=True), 1 << 40, "expanded"), (S((1995, 2000), zero_mask=True), 1 << 40, "tiled"),
])
def test_settings_have_a_precedence(settings, size, name):
    plan = choose.choose(settings, size)
    assert plan.name == name and plan.reason


def test_tiles_fit_a_task():
    plan = choose.choose(S((1991, 2020)), 1 << 40)
    assert plan.tile_cells * 102 * 30 * 8 <= choose.TILE_BYTES < (plan.tile_cells + 1) * 102 * 30 * 8


@pytest.mark.parametrize("bad", [S((1995, 2000), estimator="x"), S((1995, 2000), draws=-1), S((1995, 2000), anchor_stride=7, circular=True, targets=(1, 365)), S((1995, 2000), zero_mask=True, estimator="fast_histogram"), S((1995, 2000), targets=(1, 365)), S((2000, 1995)), S((1995, 2000), anchor_stride=7, sampler="source", draws=3)])
def test_settings_that_contradict_are_refused(bad):
    with pytest.raises(ValueError):
        choose.choose(bad, 1)


def test_rows_do_not_depend_on_the_plan(spark, li):
    for settings in (S(q.YEARS), S(q.YEARS, targets=(170, 180), zero_mask=True)):
        results = [rows_of(q._rounded(choose.run(li, settings, choose.Plan(name, "", 7)))) for name in ("expanded", "tiled")]
        assert results[0] == results[1] and results[0]
    assert rows_of(choose.climatology_of(li, S(q.YEARS))) == rows_of(clim.climatology(li))
    assert rows_of(choose.climatology_of(li, S(q.YEARS, anchor_stride=7))) == rows_of(q.clim_anchor7(spark, f"{os.environ.get('MERIDIAN_TESTDATA', '/root/testdata')}/sf0.001"))
    assert choose.estimated_bytes(li) > 0


# the stream -----------------------------------------------------------------------------------------
class Held:
    """A state as Spark keeps it."""

    def __init__(self):
        self.value, self.sizes = None, []

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value
        self.sizes.append(len(value[1]) + len(value[2]))


def test_state_holds_a_window_of_days_however_long_the_stream_is():
    rng, held, out, every = np.random.default_rng(8), Held(), [], []
    run = archive._emit((1995, 1998), (20, 300), 5)
    days = [d for d in range(15, 306) if d % 17]  # some days have no file
    for batch in np.array_split(days, 40):
        rows = pd.DataFrame([(c, y, d, rng.normal() if rng.random() < 0.8 else np.nan) for d in batch for y in range(1995, 1999) for c in (3, 4, 9)], columns=["cell", "year", "doy", "v"])
        every.append(rows)
        shuffled = rows.sample(frac=1, random_state=1)
        out += list(run((0,), iter([shuffled.iloc[: len(rows) // 2], shuffled.iloc[len(rows) // 2 :]]), held))
    assert set(held.sizes) == {3 * 4 + 11 * 4 * 3 * 8}
    got, rows = pd.concat(out), pd.concat(every)
    assert len(got) == 281 * 3 and not got.duplicated(["doy", "cell"]).any()
    for r in got.itertuples():
        x = rows[(rows.cell == r.cell) & (abs(rows.doy - r.doy) <= 5)].v.dropna()
        assert r.n == len(x) and abs(r.clim_mean - x.mean()) < 1e-12 and abs(r.p90 - x.quantile(0.9)) < 1e-12


def test_a_tile_gets_cells_later_on():
    held, run = Held(), archive._emit((1995, 1995), (20, 22), 1)
    frame = lambda *rows: pd.DataFrame(list(rows), columns=["cell", "year", "doy", "v"])
    out = list(run((0,), iter([frame((5, 1995, 19, 1.0), (5, 1995, 20, 2.0))]), held)) + list(run((0,), iter([frame((2, 1995, 21, 4.0), (5, 1995, 21, 6.0))]), held))
    got = pd.concat(out)
    assert got[["doy", "cell", "n", "clim_mean"]].values.tolist() == [[20, 2, 1, 4.0], [20, 5, 3, 3.0]]


def test_a_stream_goes_on_from_its_checkpoint(spark, li, tmp_path):
    rows = obs.with_grid(li, q.N_LON)
    folder, out = str(tmp_path / "archive"), str(tmp_path / "out")
    targets = (152, 175)
    for i, days in enumerate(((140, 160), (161, 161), (162, 190))):
        grid_nc.write_archive(rows.where(F.col("doy").between(*days)), folder, q.N_LAT, q.N_LON, kind="netcdf4-compressed" if i else "classic")
        got = archive.run_archive(spark, folder, out, q.N_LON, q.YEARS, targets, tile_cells=10)
        last = min(days[1] - 5, targets[1])
        assert rows_of(q._rounded(got)) == rows_of(q._rounded(tiled_climatology(li, q.YEARS, targets, tile_cells=10).where(F.col("doy") <= last)))
    offsets = sorted(int(f) for f in os.listdir(f"{out}/state/offsets") if f.isdigit())
    days = [json.loads(open(f"{out}/state/offsets/{n}").read().splitlines()[-1])["day"] for n in offsets]
    assert days == [160, 161, 180] and not re.search("day", "".join(os.listdir(folder)))
