from collections import Counter

import numpy as np
import pytest

from meridian import queries as q
from meridian.operators import sampling as s


def offsets(mode, unit, first_years, *, day=152, k=30, reps=(0,), n_years=30):
    grid = np.array([(day, unit, y, r) for y in range(first_years) for r in reps]).T
    return s.plan_offsets(mode, *grid, first=152, n_years=n_years, k=k)


def numbers(text):
    return [int(x) for x in text.split()]


@pytest.mark.parametrize("unit,years,day,want", [
    (0, 30, 152, "2 9 1 4 9 10 7 4 3 2 7 0 4 5 7 0 2 5 1 10 6 9 9 2 8 1 6 2 4 2"), (256, 30, 152, "8 10 3 6 3 9 6 7 4 9 10 6 10 4 6 3 2 2 9 6 5 8 0 2 5 4 1 1 2 7"),
    (260640, 6, 152, "0 1 1 7 8 7"), (0, 6, 157, "9 0 2 5 10 7"), (1000, 6, 152, "1 0 8 10 0 3"),
])
def test_source_vectors(unit, years, day, want):
    assert offsets("source", unit, years, day=day)[1].tolist() == numbers(want)


def test_more_golden_vectors():
    assert offsets("source", 0, 5, k=60, reps=(0, 1))[1].reshape(5, 2).tolist() == [[4, 9], [0, 9], [2, 10], [4, 8], [1, 6]]
    year, off = s.plan_offsets("source_flat", [152] * 10, [0] * 10, [0] * 10, range(10), first=152, n_years=30, k=10)
    assert (off * 30 + year).tolist() == numbers("24 34 69 129 152 177 222 245 293 308")
    assert (offsets("packed", 0, 30)[1] - 5).tolist() == numbers("0 3 -5 3 2 5 -3 2 -5 1 -1 1 -3 2 -1 4 -3 4 4 0 0 -1 3 -1 0 2 4 2 -2 -5")
    assert (offsets("packed", 0, 5, k=60, reps=(0, 1))[1] - 5).reshape(5, 2).tolist() == [[0, 2], [3, -4], [-5, 2], [3, -4], [2, -4]]
    year, off = offsets("consistent", 0, 30)
    assert (year * 11 + off).tolist() == numbers("9 15 25 43 44 62 67 78 89 100 114 121 140 143 162 170 185 187 206 213 224 234 250 255 274 281 295 298 318 325")
    year, off = s.plan_offsets("independent", [152] * 6, [0] * 6, [0] * 6, range(6), first=152, n_years=30, k=30)
    assert (year * 11 + off).tolist() == numbers("178 258 101 76 89 28")
    year, off = offsets("block", 0, 6)
    assert (year * 11 + off).tolist() == numbers("2 12 24 36 51 64")


def test_draws_per_year():
    assert [s.draws_per_year(k, 30) for k in (-1, 0, 29, 30, 65, 500)] == [1, 1, 1, 1, 2, 4]


def test_strata_cover_the_window():
    x = s.stratum(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64), np.arange(1000) % 4, 4, 11)
    for r, (a, b) in enumerate([(0, 2), (2, 5), (5, 8), (8, 11)]):
        assert set(x[np.arange(1000) % 4 == r].tolist()) == set(range(a, b))


def test_plan_multiplicity_and_bands(spark):
    units = spark.createDataFrame([(0,), (256,)], "unit int")
    plan = s.sample_plan(spark, units, "block", 30, 6, (152, 153))
    assert plan.count() == 2 * 2 * 30
    cells = spark.range(600).selectExpr("cast(id as int) as cell").select(s.unit_of("source", False, band_start=100).alias("u")).distinct().collect()
    assert sorted(r.u for r in cells) == [-156, 100, 356]


@pytest.mark.parametrize("name,mode", [("clim_mc_independent", "independent"), ("clim_source_mc_independent", "source"), ("clim_source_mc_flat_independent", "source_flat")])
def test_draws_of_each_cell_cover_the_season(spark, sf_dir, name, mode):
    """Against a plan in plain Python: the number of draws that meet an observation, on every target day of the season."""
    held = {(r.cell, r.year, r.doy) for r in q._li(spark, sf_dir).where("v is not null").collect()}
    cells, want = {c for c, _, _ in held}, Counter()
    for t in range(152, 244):
        for c in cells:
            pairs = [(0, r) for r in range(30)] if mode != "source" else [(y, r) for y in range(6) for r in range(5)]
            year, off = s.plan_offsets(mode, [t] * 30, [c] * 30, *zip(*pairs, strict=True), first=152, n_years=6, k=30)
            for y, o in zip(year.tolist(), off.tolist(), strict=True):
                want[t, c] += (c, 1995 + y, t + o - 5) in held
    assert {(r.doy, r.cell): r.n for r in q.QUERIES[name](spark, sf_dir).collect()} == {k: n for k, n in want.items() if n}


def test_packed_draws_are_distinct_however_many_are_asked_for():
    assert s.draws_per_year(120, 6, "packed") == 11 and s.draws_per_year(120, 6) == 20
    year, off = s.plan_offsets("packed", [152] * 66, [0] * 66, [y for y in range(6) for _ in range(11)], list(range(11)) * 6, first=152, n_years=6, k=120)
    assert all(sorted(off[year == y]) == list(range(11)) for y in range(6))


def test_fewer_draws_than_years_are_flat_strata(spark):
    assert s.settled_mode("source", 29, 30) == "source_flat" and s.settled_mode("source", 30, 30) == "source"
    units = spark.createDataFrame([(0,)], "unit int")
    plan = lambda mode: sorted(map(tuple, s.sample_plan(spark, units, mode, 4, 6, (160, 162)).collect()))
    assert plan("source") == plan("source_flat") and len(plan("source")) == 12
