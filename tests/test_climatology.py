import math

import pytest
from pyspark.sql import functions as F

from meridian.operators import climatology as clim
from meridian.operators import estimators as est
from meridian.operators.interpolate import anchored_climatology, anchors
from meridian.plans.tiles import tiled_climatology
from meridian.sources import obs as sources


def samples(spark, values, doy=152):
    """One window's samples: a value a year at one day."""
    return spark.createDataFrame([(0, 1000 + i, doy, None if v is None else float(v)) for i, v in enumerate(values)], "cell int, year int, doy int, v double")


CUBES = [
    ([1], 1, 1, None), ([20], 20, 20, 20.015625), ([1, 2], 1.5, 1.9, None), ([1, 2, 3, 4], 2.5, 3.7, 3.065625), ([5] * 11, 5, 5, None), (range(1, 12), 6, 10, None),
    (range(330), 164.5, 296.1, None), ([x / 10 for x in range(330)], 16.45, 29.61, 29.540625), ([-10, 50], 20, 44, -2.915625), ([50, 50], 50, 50, 44.9484375),
    ([1, 1] + [5] * 28, 142 / 30, 5, None), ([0] * 10 + [10], 10 / 11, 0, None),
]


@pytest.mark.parametrize("values,mean,p90,hist", CUBES)
def test_known_cubes(spark, values, mean, p90, hist):
    rows = samples(spark, values)
    got = clim.climatology(rows, (152, 152)).first()
    assert (got.n, got.clim_mean, got.p90) == (len(values), pytest.approx(mean), pytest.approx(p90))
    assert clim.by_selection(rows, (152, 152)).first().p90 == pytest.approx(p90)
    assert est.fixed_collect(rows, (152, 152)).first().p90 == pytest.approx(p90)
    if hist is not None:
        assert est.fast_histogram(rows, (152, 152)).first().p90 == pytest.approx(hist, abs=1e-6)


def test_missing_values_and_spine(spark):
    rows = sources.cleaned(samples(spark, [math.nan, 4, -99, 7, None]), fill=-99.0, scale=2.0, offset=1.0)
    got = clim.climatology(rows, (152, 152)).first()
    assert (got.n, got.clim_mean) == (2, 12.0)
    none = clim.dense(clim.climatology(samples(spark, [None, 1], doy=147), (152, 153)), sources.spine(rows, (152, 153))).orderBy("doy").collect()
    assert [(r.doy, r.n, r.p90) for r in none] == [(152, 1, 1.0), (153, 0, None)]


def test_fill_is_compared_before_scaling(spark):
    # 5 * 2 + 1 = 11 equals no mark; the raw 11 is the mark
    rows = sources.cleaned(samples(spark, [5, 11]), fill=11.0, scale=2.0, offset=1.0)
    assert sorted((r.v for r in rows.collect()), key=lambda x: x is None) == [11.0, None]


def test_zero_mask_looks_at_the_first_slot_only(spark):
    def one(first, second):
        rows = [(0, 1991, 147, first), (0, 1992, 147, second), (0, 1993, 150, 8.0)]
        rows = spark.createDataFrame([r for r in rows if r[3] is not ...], "cell int, year int, doy int, v double")
        return clim.climatology(rows, (152, 152), zero_mask_year=1991).first()

    assert (one(0.0, 5.0).clim_mean, one(0.0, 5.0).p90) == (0.0, 0.0)
    assert one(..., 0.0).clim_mean == 4.0 and one(None, 0.0).clim_mean == 4.0 and one(5.0, 0.0).clim_mean == pytest.approx(13 / 3)


def test_plans_agree(spark):
    rows = spark.range(6 * 112 * 7).select((F.col("id") % 7).cast("int").alias("cell"), (1995 + F.expr("id div 7 % 6")).cast("int").alias("year"), (147 + F.expr("id div 42 % 102")).cast("int").alias("doy"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("decimal(18,2)").alias("v")).dropDuplicates(["cell", "year", "doy"])
    want = {(r.doy, r.cell): r for r in clim.climatology(rows, (152, 243)).collect()}
    for other in (clim.by_time_window(rows), tiled_climatology(rows, (1995, 2000), tile_cells=3), clim.preaggregated_mean(rows, sources.spine(rows, (147, 248)))):
        got = {(r.doy, r.cell): r for r in other.collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r.n == want[k].n and r.clim_mean == pytest.approx(want[k].clim_mean) and ("p90" not in other.columns or r.p90 == pytest.approx(want[k].p90, abs=1e-5))


def test_anchors_and_interpolation(spark):
    assert anchors((152, 160), 7) == [152, 159, 160] and anchors((152, 152), 7) == [152]
    rows = spark.range(102).select(F.lit(0).alias("cell"), F.lit(1995).alias("year"), (147 + F.col("id")).cast("int").alias("doy"), (147.0 + F.col("id")).alias("v"))
    got = {r.doy: r.clim_mean for r in anchored_climatology(rows, 7, (152, 170)).collect()}
    assert got == {d: pytest.approx(d) for d in range(152, 171)}
    assert [r.clim_mean for r in anchored_climatology(rows, 7, (152, 152)).collect()] == [152.0]


def test_target_range_is_checked(spark):
    for bad in ((243, 152), (3, 10), (300, 364)):
        with pytest.raises(ValueError):
            clim.check_targets(bad)


def test_fixed_collect_fallback(spark):
    rows = samples(spark, [10.0 + i / 1e5 for i in range(300)])
    assert est.fixed_collect(rows, (152, 152), most=256).first().p90 == pytest.approx(-3 + (138 + 0.5) * 0.09375)
    assert est.fixed_collect(rows, (152, 152)).first().p90 == pytest.approx(10 + 0.9 * 299 / 1e5, abs=1e-6)


def test_aggregation_has_one_shuffle_and_prunes_columns(spark, sf_dir):
    plan = clim.climatology(sources.from_lineitem(spark, sf_dir))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp" in plan


def test_tiles_have_masks_and_cells_without_values(spark):
    from meridian.plans.tiles import tiled_climatology

    rows = [(c, y, d, None if c == 1 or (c + d) % 7 == 0 else float((c * 31 + y * 7 + d * 3) % 11)) for c in range(6) for y in (2000, 2001, 2002) for d in range(147, 165) if (c + y + d) % 4]
    df = spark.createDataFrame(rows, "cell int, year int, doy int, v double")
    key = lambda x: {(r.doy, r.cell): (r.n, r.clim_mean and round(r.clim_mean, 9), r.p90 and round(r.p90, 6)) for r in x.collect()}
    for year in (None, 2000):
        want = key(clim.climatology(df, (152, 159), zero_mask_year=year))
        assert key(tiled_climatology(df, (2000, 2002), (152, 159), tile_cells=4, zero_mask_year=year)) == want
        assert any(c == 1 and n == 0 for (_, c), (n, _, _) in want.items())
    assert any(v == (v[0], 0.0, 0.0) and v[0] > 0 for v in want.values())
