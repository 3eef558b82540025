"""The registered queries of the climatology engine and their DuckDB SQL.

Adapters: ``lineitem`` x ``supplier`` (25 cells, years 1995-2000), ``orders`` x ``customer`` and
``events``; see ``meridian.sources.obs``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import calendar as cal
from meridian.operators import climatology as clim
from meridian.operators import estimators as est
from meridian.operators import interpolate, sampling, validate
from meridian.operators.metrics import StageMetrics
from meridian.plans.choose import Settings, climatology_of
from meridian.plans.tiles import collected_histogram, prefix_histogram, tiled_climatology
from meridian.session import shared_folder
from meridian.sources import grid_nc, grid_source, obs, store
from meridian.streaming.archive import run_archive
from meridian.streaming.chunks import run_stream

YEARS, SEASON, EVENT_DAYS = (1995, 2000), (152, 243), (6, 25)
N_YEARS, N_LAT, N_LON = 6, 5, 5
FILES = ["0601", "0615.nc", "0831"]
RAW_FILL, RAW_MISSING = -32768, -32767

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str]):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# SQL pieces ------------------------------------------------------------------------------------
LEAP = "(year({d}) % 4 = 0 AND (year({d}) % 100 <> 0 OR year({d}) % 400 = 0))"


def _doy(d: str) -> str:
    return f"CAST(dayofyear({d}) - CASE WHEN month({d}) > 2 AND {LEAP.format(d=d)} THEN 1 ELSE 0 END AS INTEGER)"


def _daily(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT cell, CAST(year(d) AS INTEGER) AS year, {_doy('d')} AS doy, max(v) AS v FROM ({rows})
        WHERE NOT (month(d) = 2 AND day(d) = 29) AND year(d) BETWEEN 1995 AND 2000 GROUP BY ALL)"""


LI = _daily("obs", "SELECT CAST(s_nationkey AS INTEGER) AS cell, CAST(l_shipdate AS DATE) AS d, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
ORD = _daily("ord", "SELECT CAST(c_nationkey AS INTEGER) AS cell, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey")
EV = f"ev AS (SELECT CAST(user_id % 25 AS INTEGER) AS cell, {_doy('CAST(ts AS DATE)')} AS doy, value / 5e0 AS v FROM events WHERE NOT (month(ts) = 2 AND day(ts) = 29))"
STATS = "count(v) AS n, CAST(sum(v) AS DOUBLE) / count(v) AS clim_mean, round(quantile_cont(CAST(v AS DOUBLE), 0.9), 6) AS p90"


def _targets(b: int, e: int) -> str:
    return f"(SELECT CAST(unnest(generate_series({b}, {e})) AS INTEGER) AS t)"


def _clim(name: str, source: str, b: int = 152, e: int = 243) -> str:
    return f"{name} AS (SELECT t AS doy, cell, {STATS} FROM {_targets(b, e)} JOIN {source} o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY t, cell)"


EXACT = f"WITH {LI}, {_clim('c', 'obs')} SELECT doy, cell, n, clim_mean, p90 FROM c"


def _li(spark, sf_dir):
    return obs.from_lineitem(spark, sf_dir, YEARS)


# exact statistics ------------------------------------------------------------------------------
@query(EXACT)
def clim_exact(spark, sf_dir):
    return clim.climatology(_li(spark, sf_dir), SEASON)


@query(f"WITH {LI}, {_clim('c', 'obs', 170, 189)} SELECT doy, cell, n, clim_mean, p90 FROM c")
def clim_subrange(spark, sf_dir):
    return clim.climatology(_li(spark, sf_dir), (170, 189))


@query(f"""WITH {LI}, z AS (SELECT cell, year, doy, CASE WHEN cell % 3 = 0 AND year = 1995 AND doy % 4 = 1 THEN 0 ELSE v END AS v FROM obs),
    c AS (SELECT t AS doy, cell, {STATS}, coalesce(max(CASE WHEN o.doy = t - 5 AND year = 1995 THEN CAST(v = 0 AS INTEGER) END), 0) AS m
          FROM {_targets(152, 243)} JOIN z o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY t, cell)
    SELECT doy, cell, n, CASE WHEN m = 1 THEN 0.0 ELSE clim_mean END AS clim_mean, CASE WHEN m = 1 THEN 0.0 ELSE p90 END AS p90 FROM c""")
def clim_zero_mask(spark, sf_dir):
    """A zero in the window's first slot (first day, first year) masks the cell; zeros are put in here by a rule."""
    rows = _li(spark, sf_dir)
    land = (F.col("cell") % 3 == 0) & (F.col("year") == 1995) & (F.col("doy") % 4 == 1)
    return clim.climatology(rows.withColumn("v", F.when(land, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("v"))), SEASON, zero_mask_year=1995)


@query(f"""WITH {LI}, raw AS (SELECT cell, year, doy, CASE WHEN cell = 4 OR doy % 13 = 0 THEN {RAW_FILL} WHEN doy % 17 = 0 THEN {RAW_MISSING} ELSE v END AS v FROM obs),
    o AS (SELECT cell, year, doy, CAST(CASE WHEN v NOT IN ({RAW_FILL}, {RAW_MISSING}) THEN v * 0.01 + 1 END AS DECIMAL(24,4)) AS v FROM raw),
    {_clim('c', 'o')} SELECT t AS doy, s.cell, coalesce(n, 0) AS n, clim_mean, p90 FROM (SELECT DISTINCT cell FROM obs) s CROSS JOIN {_targets(152, 243)} LEFT JOIN c ON c.doy = t AND c.cell = s.cell""")
def clim_missing_values(spark, sf_dir):
    """Fill and missing marks, scale and offset, and cells or days without a sample."""
    rows = _li(spark, sf_dir)
    raw = F.when((F.col("cell") == 4) | (F.col("doy") % 13 == 0), RAW_FILL).when(F.col("doy") % 17 == 0, RAW_MISSING).otherwise(F.col("v"))
    clean = obs.cleaned(rows.withColumn("v", raw.cast("decimal(18,2)")), fill=RAW_FILL, missing=RAW_MISSING, scale=F.lit("0.01").cast("decimal(3,2)"), offset=1)
    return clim.dense(clim.climatology(clean.withColumn("v", F.col("v").cast("decimal(24,4)")), SEASON), obs.spine(rows, SEASON)).select("doy", "cell", "n", "clim_mean", "p90")


@query(f"""WITH {LI}, x AS (SELECT t AS doy, cell, list_sort(list(CAST(v AS DOUBLE))) AS x FROM {_targets(152, 243)} JOIN obs o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY t, cell),
    r AS (SELECT *, 0.9::DOUBLE * (len(x) - 1) AS r FROM x)
    SELECT doy, cell, CAST(len(x) AS BIGINT) AS n, x[CAST(floor(r) AS INTEGER) + 1] AS kth,
           round(x[CAST(floor(r) AS INTEGER) + 1] + (r - floor(r)) * (x[least(CAST(floor(r) AS INTEGER) + 2, len(x))] - x[CAST(floor(r) AS INTEGER) + 1]), 6) AS p90 FROM r""")
def clim_select_kth(spark, sf_dir):
    return clim.by_selection(_li(spark, sf_dir), SEASON)


@query(EXACT)
def clim_window_tvf(spark, sf_dir):
    return clim.by_time_window(_li(spark, sf_dir), SEASON)


@query(f"WITH {LI}, {_clim('c', 'obs')} SELECT doy, cell, n, clim_mean FROM c")
def clim_preagg_mean(spark, sf_dir):
    rows = _li(spark, sf_dir)
    return clim.preaggregated_mean(rows, obs.spine(rows, (SEASON[0] - 5, SEASON[1] + 5)), SEASON)


def _rounded(rows: DataFrame) -> DataFrame:
    """Sums of doubles, rounded off the ties that the exact sums can lie on."""
    return rows.withColumns({"clim_mean": F.round(F.col("clim_mean") + 1e-7, 4), "p90": F.round("p90", 6)})


ROUNDED = f"WITH {LI}, {_clim('c', 'obs')} SELECT doy, cell, n, round(clim_mean + 1e-7, 4) AS clim_mean, p90 FROM c"


@query(ROUNDED)
def clim_tile_arrow(spark, sf_dir):
    return _rounded(tiled_climatology(_li(spark, sf_dir), YEARS, SEASON, tile_cells=10))


@query(ROUNDED)
def clim_tile_bucketed(spark, sf_dir):
    """The same over observations stored by tile, without an exchange."""
    return _rounded(tiled_climatology(store.write_by_tile(_li(spark, sf_dir), shared_folder(spark, "tiles"), tile_cells=10, buckets=8), YEARS, SEASON))


@query(f"""WITH {LI}, c AS (SELECT t AS doy, cell, {STATS} FROM {_targets(1, 365)} JOIN obs o ON (o.doy - t + 735) % 365 <= 10 GROUP BY t, cell)
    SELECT doy, cell, n, clim_mean, p90 FROM c""")
def clim_circular(spark, sf_dir):
    """Every day of the year, windows going around its end."""
    return clim.climatology(_li(spark, sf_dir), (1, 365), circular=True)


# estimators on bins ----------------------------------------------------------------------------
_BINS = f"""{EV}, b AS (SELECT t, cell, greatest(0, least(511, CAST(floor((v + 3.0e0) / 0.09375e0) AS INTEGER))) AS bin, count(*) AS cnt
        FROM {_targets(*EVENT_DAYS)} JOIN ev o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY ALL),
    w AS (SELECT *, sum(cnt) OVER (PARTITION BY t, cell ORDER BY bin) - cnt AS before, sum(cnt) OVER (PARTITION BY t, cell) AS n FROM b),
    r AS (SELECT *, 0.9::DOUBLE * (n - 1) AS r FROM w)"""


_FAST = f"""WITH {_BINS} SELECT t AS doy, cell, CAST(n AS BIGINT) AS n,
    round(-3.0e0 + (bin + CASE WHEN n = 1 THEN 0.5e0 ELSE greatest(0e0, least(1e0, (r - before) / cnt)) END) * 0.09375e0, 6) AS p90
    FROM r WHERE before <= floor(r) AND before + cnt > floor(r)"""


@query(_FAST)
def clim_fast_hist(spark, sf_dir):
    return est.fast_histogram(obs.from_events(spark, sf_dir), EVENT_DAYS)


@query(_FAST)
def clim_prefix_hist(spark, sf_dir):
    """The same bins, each window as a difference of running sums."""
    return prefix_histogram(obs.from_events(spark, sf_dir), EVENT_DAYS)


_COLLECTED = f"WITH {EV} SELECT t AS doy, cell, count(*) AS n, round(quantile_cont(v, 0.9), 6) AS p90 FROM {_targets(*EVENT_DAYS)} JOIN ev o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY t, cell"


@query(_COLLECTED)
def clim_fixed_collect(spark, sf_dir):
    return est.fixed_collect(obs.from_events(spark, sf_dir), EVENT_DAYS)


@query(_COLLECTED)
def clim_collect_tiles(spark, sf_dir):
    """The same by tile, each value once."""
    return collected_histogram(obs.from_events(spark, sf_dir), EVENT_DAYS)


@query(f"""WITH {EV}, b AS (SELECT cell, greatest(0, least(511, CAST(floor((v + 3.0e0) / 0.09375e0) AS INTEGER))) AS bin, count(*) AS cnt FROM ev GROUP BY ALL)
    SELECT cell, bin, cnt, CAST(sum(cnt) OVER (PARTITION BY cell ORDER BY bin) AS BIGINT) AS cumulative FROM b""")
def cumulative_hist(spark, sf_dir):
    return est.histogram(obs.from_events(spark, sf_dir), "cell")


# Monte-Carlo -----------------------------------------------------------------------------------
def _plan_rows(mode: str, k: int, days: tuple[int, int], units: list[int]) -> str:
    mode = sampling.settled_mode(mode, k, N_YEARS)
    each = sampling.draws_per_year(k, N_YEARS, mode)
    flat = mode in ("source_flat", "independent")
    k = k if mode == "source_flat" else each * N_YEARS
    grid = np.array([(t, u, y, r) for t in range(days[0], days[1] + 1) for u in units for y in range(1 if flat else N_YEARS) for r in range(k if flat else each)]).T
    year, off = sampling.plan_offsets(mode, *grid, first=days[0], n_years=N_YEARS, k=k)
    return ", ".join(f"({t},{u},{y + YEARS[0]},{t + o - 5})" for t, u, y, o in zip(grid[0], grid[1], year, off, strict=True))


def _sampled(mode: str, k: int, days: tuple[int, int] = SEASON, per_cell: bool = False, exact_mean: bool = False):
    def sql() -> str:
        unit = "o.cell" if per_cell else "0"  # 25 cells are one block
        plan = f"plan(t, unit, year, doy) AS (VALUES {_plan_rows(mode, k, days, list(range(25)) if per_cell else [0])})"
        s = f"s AS (SELECT t AS doy, cell, {STATS} FROM plan JOIN obs o ON o.year = plan.year AND o.doy = plan.doy AND plan.unit = {unit} GROUP BY t, cell)"
        if not exact_mean:
            return f"WITH {LI}, {plan}, {s} SELECT doy, cell, n, clim_mean, p90 FROM s"
        return f"WITH {LI}, {plan}, {s}, {_clim('c', 'obs', *days)} SELECT c.doy, c.cell, coalesce(s.n, 0) AS n, c.clim_mean, s.p90 FROM c LEFT JOIN s ON c.doy = s.doy AND c.cell = s.cell"

    def run(spark, sf_dir):
        return sampling.sampled_climatology(_li(spark, sf_dir), mode, k, YEARS, days, per_cell=per_cell, exact_mean=exact_mean)

    return run, sql


for _name, _args in {
    "clim_mc_consistent": ("consistent", 30), "clim_mc_packed": ("packed", 30), "clim_mc_packed_k120": ("packed", 120), "clim_source_mc_k4": ("source", 4), "clim_mc_block": ("block", 30), "clim_mc_independent": ("independent", 30, SEASON, True),
    "clim_source_mc_k30": ("source", 30), "clim_source_mc_k60": ("source", 60), "clim_source_mc_flat10": ("source_flat", 10),
    "clim_source_mc_exact_mean": ("source", 30, SEASON, False, True), "clim_source_mc_independent": ("source", 30, SEASON, True), "clim_source_mc_flat_independent": ("source_flat", 30, SEASON, True),
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sampled(*_args)


@query(_sampled("packed", 6)[1])
def clim_mc_pruned(spark, sf_dir):
    """One draw a year and day, from a season's observations stored by day: folders that no draw falls on aren't read."""
    stored = store.write_by_day(_li(spark, sf_dir).where(F.col("doy").between(147, 248)), shared_folder(spark, "days"))
    return sampling.sampled_climatology(stored, "packed", 6, YEARS, SEASON)


def _planned() -> str:
    exact, sampled = f"SELECT 'exact' AS settings, * FROM ({EXACT})", f"SELECT 'sampled' AS settings, * FROM ({_sampled('source', 30)[1]()})"
    return f"{exact} UNION ALL {sampled}"


@query(_planned)
def clim_planned(spark, sf_dir):
    """Two settings, each by the plan that is chosen for it."""
    rows = _li(spark, sf_dir)
    exact, sampled = climatology_of(rows, Settings(YEARS)), climatology_of(rows, Settings(YEARS, sampler="source", draws=30))
    return exact.select(F.lit("exact").alias("settings"), *exact.columns).unionByName(sampled.select(F.lit("sampled").alias("settings"), *exact.columns))


# interpolation ---------------------------------------------------------------------------------
@query(f"""WITH {LI}, {_clim('c', 'obs')}, a AS (SELECT * FROM c WHERE (doy - 152) % 7 = 0 OR doy = 243),
    g AS (SELECT cell, t AS doy, CASE WHEN t = 243 THEN 243 ELSE 152 + ((t - 152) // 7) * 7 END AS l FROM (SELECT DISTINCT cell FROM a) CROSS JOIN {_targets(152, 243)}),
    h AS (SELECT *, CASE WHEN doy = l THEN l ELSE least(l + 7, 243) END AS r FROM g)
    SELECT h.doy, h.cell, round(x.clim_mean + (y.clim_mean - x.clim_mean) * f, 6) AS clim_mean, round(x.p90 + (y.p90 - x.p90) * f, 6) AS p90
    FROM (SELECT *, CASE WHEN r > l THEN (doy - l)::DOUBLE / (r - l) ELSE 0.0 END AS f FROM h) h
    LEFT JOIN a x ON x.cell = h.cell AND x.doy = l LEFT JOIN a y ON y.cell = h.cell AND y.doy = r""")
def clim_anchor7(spark, sf_dir):
    return interpolate.anchored_climatology(_li(spark, sf_dir), 7, SEASON)


# calendar --------------------------------------------------------------------------------------
@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT d, {LEAP.format(d='d')} AS leap, month(d) = 2 AND day(d) = 29 AS feb29 FROM d),
    y AS (SELECT *, CASE WHEN NOT feb29 THEN {_doy('d')} END AS doy FROM x)
    SELECT d, leap, CAST(day(last_day(d)) AS INTEGER) AS month_days, doy, CASE WHEN NOT feb29 THEN strftime(d, '%m%d') END AS mmdd, strftime(d, '%Y%m%d') AS ymd,
           CASE WHEN NOT feb29 THEN d END AS again, CAST(d - 40 AS DATE) AS before FROM y""")
def calendar_noleap(spark, sf_dir):
    d = F.col("d")
    rows = obs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("doy", cal.noleap_doy(d).cast("int"))
    return rows.select(
        "d", cal.is_leap(F.year(d)).alias("leap"), cal.days_in_month(F.year(d), F.month(d)).alias("month_days"), "doy", cal.mmdd(F.col("doy")).alias("mmdd"), cal.yyyymmdd(d).alias("ymd"),
        cal.noleap_date(F.year(d), F.col("doy")).alias("again"), F.date_add(d, -40).alias("before"),
    )


@query(f"""WITH c AS (SELECT y AS year, t AS doy, make_date(y, 1, 1) + CAST(t - 1 + CASE WHEN t >= 60 AND {LEAP.format(d='make_date(y, 1, 1)')} THEN 1 ELSE 0 END AS INTEGER) AS center
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) CROSS JOIN {_targets(152, 243)})
    SELECT doy, year, o AS "offset", CAST(center + o AS DATE) AS date, strftime(center + o, '%Y%m%d') AS ymd FROM c CROSS JOIN (SELECT CAST(unnest(generate_series(-5, 5)) AS INTEGER) AS o)""")
def sample_dates(spark, sf_dir):
    """The dates that each target's window samples in the years of the orders."""
    years = obs.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    days = years.withColumn("doy", F.explode(F.sequence(F.lit(SEASON[0]), F.lit(SEASON[1]))))
    rows = days.select("doy", F.explode(cal.sample_dates(F.array("year"), F.col("doy"), 5)).alias("s"))
    return rows.select("doy", "s.year", "s.offset", "s.date", cal.yyyymmdd(F.col("s.date")).alias("ymd"))


# layouts ---------------------------------------------------------------------------------------
@query(f"""WITH {LI}, d AS (SELECT DISTINCT year, doy FROM obs WHERE doy BETWEEN 147 AND 248), g AS (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS cell)
    SELECT d.year, d.doy, CAST(g.cell // 5 AS INTEGER) AS lat_idx, CAST(g.cell % 5 AS INTEGER) AS lon_idx, o.v FROM d CROSS JOIN g LEFT JOIN obs o ON o.year = d.year AND o.doy = d.doy AND o.cell = g.cell""")
def transpose_layout(spark, sf_dir):
    """Fields packed in (lon, lat) order and read back by (lat, lon)."""
    rows = obs.with_grid(_li(spark, sf_dir).where(F.col("doy").between(147, 248)), N_LON)
    return obs.unpacked_planes(obs.packed_planes(rows, N_LAT, N_LON, lon_major=True), N_LAT, N_LON, lon_major=True)


@query(f"""WITH {LI} SELECT CAST((cell // 5) // 2 AS INTEGER) AS tile, count(DISTINCT cell) AS cells, count(*) AS n, CAST(sum(v) AS DECIMAL(38,2)) AS total FROM obs GROUP BY 1""")
def tile_bands(spark, sf_dir):
    tiled = obs.with_tiles(obs.with_grid(_li(spark, sf_dir), N_LON), N_LAT, 3)
    return tiled.groupBy("tile").agg(F.countDistinct("cell").alias("cells"), F.count("*").alias("n"), F.sum("v").cast("decimal(38,2)").alias("total"))


# validation ------------------------------------------------------------------------------------
@query(f"WITH {LI}, {_clim('c', 'obs')} SELECT doy, count(p90) AS finite, count(*) - count(p90) AS missing, count(*) FILTER (p90 = 0) AS zeros, min(p90) AS least, max(p90) AS largest FROM c GROUP BY doy")
def field_stats(spark, sf_dir):
    return validate.field_statistics(clim_exact(spark, sf_dir), "p90")


@query(f"""WITH {_BINS}, f AS (SELECT t AS doy, cell, round(-3.0e0 + (bin + CASE WHEN n = 1 THEN 0.5e0 ELSE greatest(0e0, least(1e0, (r - before) / cnt)) END) * 0.09375e0, 6) AS p90
        FROM r WHERE before <= floor(r) AND before + cnt > floor(r)),
    e AS (SELECT t AS doy, cell, round(quantile_cont(v, 0.9), 6) AS p90 FROM {_targets(*EVENT_DAYS)} JOIN ev o ON o.doy BETWEEN t - 5 AND t + 5 GROUP BY t, cell)
    SELECT e.doy, e.cell, e.p90 AS exact, f.p90 AS estimate, round(abs(e.p90 - f.p90), 6) AS difference FROM e JOIN f ON e.doy = f.doy AND e.cell = f.cell
    WHERE e.cell IN (SELECT DISTINCT cell FROM e WHERE cell % 3 = 0 ORDER BY cell LIMIT 8)""")
def spot_check(spark, sf_dir):
    rows = obs.from_events(spark, sf_dir)
    return validate.spot_check(est.fixed_collect(rows, EVENT_DAYS), est.fast_histogram(rows, EVENT_DAYS), stride=3)


_DAILY = f"""WITH {LI}, {ORD}, {_clim('a', 'obs')}, {_clim('b', 'ord')},
    daily AS (SELECT b.doy, round(sqrt(avg(pow(b.clim_mean - a.clim_mean, 2))), 6) AS rmse_clim, round(sqrt(avg(pow(b.p90 - a.p90, 2))), 6) AS rmse_p90
              FROM a JOIN b ON a.doy = b.doy AND a.cell = b.cell GROUP BY b.doy)"""


def _rmse(spark, sf_dir, days=None):
    return validate.daily_rmse(clim_exact(spark, sf_dir), clim.climatology(obs.from_orders(spark, sf_dir, YEARS), SEASON), days)


@query(f"{_DAILY} SELECT * FROM daily")
def rmse_daily(spark, sf_dir):
    return _rmse(spark, sf_dir)


@query(f"{_DAILY} SELECT * FROM daily WHERE doy IN (152, 166, 243)")
def rmse_files(spark, sf_dir):
    """Only the listed files (MMDD or MMDD.nc)."""
    return _rmse(spark, sf_dir, FILES)


@query(f"{_DAILY} SELECT * FROM daily")
def rmse_from_files(spark, sf_dir):
    """The daily errors from two folders of NetCDF files, one file a day."""
    folder = shared_folder(spark, "validation")
    for name, rows in (("reference", _li(spark, sf_dir)), ("candidate", obs.from_orders(spark, sf_dir, YEARS))):
        grid_nc.write_fields(obs.with_grid(clim.climatology(rows, SEASON), N_LON), f"{folder}/{name}", N_LAT, N_LON, value_type="double")
    return validate.rmse_of_files(spark, f"{folder}/reference", f"{folder}/candidate")


@query(f"""WITH {LI}, {ORD}, {_clim('a', 'obs')}, {_clim('b', 'ord')},
    x AS (SELECT coalesce(a.doy, b.doy) AS doy, count(*) FILTER (b.doy IS NULL) AS only_reference, count(*) FILTER (a.doy IS NULL) AS only_candidate
          FROM (SELECT * FROM a WHERE cell <> 7) a FULL JOIN (SELECT * FROM b WHERE doy % 5 > 0) b ON a.doy = b.doy AND a.cell = b.cell GROUP BY 1)
    SELECT * FROM x WHERE only_reference + only_candidate > 0""")
def rmse_unmatched(spark, sf_dir):
    """Cells that only one side has; here the reference lacks cell 7 and the candidate every fifth day."""
    reference, candidate = clim_exact(spark, sf_dir), clim.climatology(obs.from_orders(spark, sf_dir, YEARS), SEASON)
    return validate.unmatched_cells(reference.where("cell <> 7"), candidate.where("doy % 5 > 0"))


@query(f"{_DAILY} SELECT round(avg(rmse_clim), 4) AS mean_rmse_clim, max(rmse_clim) AS max_rmse_clim, round(avg(rmse_p90), 4) AS mean_rmse_p90, max(rmse_p90) AS max_rmse_p90 FROM daily")
def rmse_season(spark, sf_dir):
    return validate.season_rmse(_rmse(spark, sf_dir))


@query(f"""{_DAILY} SELECT count(*) FILTER (rmse_clim >= 200000) AS clim_days_over, count(*) FILTER (rmse_p90 >= 200000) AS p90_days_over,
    max(rmse_clim) < 200000 AND max(rmse_p90) < 200000 AS days_ok, avg(rmse_clim) < 400000 AND avg(rmse_p90) < 400000 AS season_ok FROM daily""")
def rmse_threshold(spark, sf_dir):
    return validate.threshold_report(_rmse(spark, sf_dir), 200_000, 400_000)


@query(f"""WITH {LI}, s AS (SELECT y AS year, t AS doy FROM (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS y) CROSS JOIN {_targets(147, 248)}),
    whole AS (SELECT year, doy FROM obs GROUP BY year, doy HAVING count(DISTINCT cell) = (SELECT count(DISTINCT cell) FROM obs))
    SELECT year, count(*) AS failed FROM s ANTI JOIN whole USING (year, doy) GROUP BY year""")
def missing_file_report(spark, sf_dir):
    """Source days without a whole file, per year: days on which a cell that is seen at all wasn't observed, and all of 2001."""
    rows = _li(spark, sf_dir)
    cells = rows.agg(F.countDistinct("cell").alias("cells"))
    whole = rows.groupBy("year", "doy").agg(F.countDistinct("cell").alias("n")).join(F.broadcast(cells), F.col("n") == F.col("cells"))
    return obs.missing_days(whole, (1995, 2001), (147, 248)).groupBy("year").agg(F.count("*").alias("failed"))


@query(f"""WITH {LI}, s AS (SELECT cell, y AS year, t AS doy FROM (SELECT DISTINCT cell FROM obs) CROSS JOIN (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS y) CROSS JOIN {_targets(147, 248)})
    SELECT cell, year, count(*) AS failed FROM s ANTI JOIN (SELECT DISTINCT cell, year, doy FROM obs) o USING (cell, year, doy) GROUP BY cell, year""")
def missing_cell_report(spark, sf_dir):
    """Source days without an observation, per cell and year, of all cells seen; years without a gap have no row."""
    return obs.missing_cell_days(_li(spark, sf_dir), (1995, 2001), (147, 248)).groupBy("cell", "year").agg(F.count("*").alias("failed"))


# streams and files -----------------------------------------------------------------------------
@query(EXACT)
def stream_chunks(spark, sf_dir):
    """The exact statistics from a stream of chunks of source days."""
    return run_stream(_li(spark, sf_dir), shared_folder(spark, "stream"), SEASON)


@query(f"""WITH {LI}, {_clim('c', 'obs')}, g AS (SELECT t AS doy, k.cell FROM {_targets(152, 243)} CROSS JOIN (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS cell) k)
    SELECT strftime(DATE '2001-01-01' + (g.doy - 1), '%m%d') || '.nc' AS file, CAST(g.cell // 5 AS INTEGER) AS lat_idx, CAST(g.cell % 5 AS INTEGER) AS lon_idx,
           clim_mean AS "Climmean", p90 AS "P90_sst" FROM g LEFT JOIN c ON c.doy = g.doy AND c.cell = g.cell""")
def netcdf_roundtrip(spark, sf_dir):
    """The exact statistics written as one NetCDF file per day, and read back."""
    folder = shared_folder(spark, "fields")
    grid_nc.write_fields(obs.with_grid(clim_exact(spark, sf_dir), N_LON), folder, N_LAT, N_LON, value_type="double")
    return grid_nc.read_fields(spark, f"{folder}/*.nc", ["Climmean", "P90_sst"], "Lat", "Lon", on_error="fail")


@query(f"""WITH {LI}, d AS (SELECT DISTINCT year, doy FROM obs WHERE doy BETWEEN 170 AND 189 AND year >= 1997)
    SELECT d.year, d.doy, CAST(g.cell // 5 AS INTEGER) AS lat_idx, CAST(g.cell % 5 AS INTEGER) AS lon_idx, CAST(o.v AS DOUBLE) AS data
    FROM d CROSS JOIN (SELECT CAST(unnest(generate_series(10, 19)) AS INTEGER) AS cell) g LEFT JOIN obs o ON o.year = d.year AND o.doy = d.doy AND o.cell = g.cell""")
def grid_scan_pruned(spark, sf_dir):
    """A season's archive of daily files, of which the files of some days and the rows of some latitudes are read."""
    folder = shared_folder(spark, "archive")
    grid_nc.write_archive(obs.with_grid(_li(spark, sf_dir).where(F.col("doy").between(147, 248)), N_LON), folder, N_LAT, N_LON)
    rows = grid_source.read_archive(spark, folder, on_error="fail")
    return rows.where("doy between 170 and 189 and year >= 1997 and lat_idx between 2 and 3").select("year", "doy", "lat_idx", "lon_idx", "data")


@query(f"""WITH {LI}, {_clim('c', 'obs')}, g AS (SELECT t AS doy, k.cell FROM {_targets(152, 243)} CROSS JOIN (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS cell) k)
    SELECT f.kind, strftime(DATE '2001-01-01' + (g.doy - 1), '%m%d') || '.nc' AS file, g.doy, CAST(g.cell // 5 AS INTEGER) AS lat_idx, CAST(g.cell % 5 AS INTEGER) AS lon_idx,
           clim_mean AS "Climmean", p90 AS "P90_sst" FROM g CROSS JOIN (VALUES ('netcdf4'), ('netcdf4-compressed')) f(kind) LEFT JOIN c ON c.doy = g.doy AND c.cell = g.cell""")
def netcdf4_roundtrip(spark, sf_dir):
    """The exact statistics as NetCDF-4 files, plain and compressed, and read back from the archive source."""
    rows, out = obs.with_grid(clim_exact(spark, sf_dir), N_LON), None
    for kind in ("netcdf4", "netcdf4-compressed"):
        folder = shared_folder(spark, "fields4")
        grid_nc.write_fields(rows, folder, N_LAT, N_LON, value_type="double", kind=kind)
        again = grid_source.read_archive(spark, folder, ["Climmean", "P90_sst"], "Lat", "Lon", on_error="fail").select(F.lit(kind).alias("kind"), "file", "doy", "lat_idx", "lon_idx", "Climmean", "P90_sst")
        out = again if out is None else out.unionByName(again)
    return out


@query(f"""WITH {LI}, d AS (SELECT DISTINCT year, doy, (year * 365 + doy) % 7 AS fate FROM obs WHERE doy BETWEEN 147 AND 248), g AS (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS cell)
    SELECT CAST(d.year AS INTEGER) AS year, count(*) AS files, count(*) FILTER (fate < 3) AS failed, CAST(sum(CASE WHEN fate >= 3 THEN n END) AS BIGINT) AS present, CAST(sum(CASE WHEN fate >= 3 THEN total END) AS DECIMAL(38,2)) AS total
    FROM d JOIN (SELECT year, doy, count(*) AS n, sum(v) AS total FROM obs GROUP BY ALL) s USING (year, doy) GROUP BY d.year""")
def grid_bad_files(spark, sf_dir):
    """An archive in which three of seven files are cut short, altered or something else: they count as failed, all others are read."""
    folder, broken = shared_folder(spark, "archive"), shared_folder(spark, "broken")
    rows = obs.with_grid(_li(spark, sf_dir).where(F.col("doy").between(147, 248)), N_LON)
    grid_nc.write_archive(rows, folder, N_LAT, N_LON, kind="netcdf4")
    fate, content = (F.col("year") * 365 + F.col("doy")) % 7, F.col("content")
    altered = F.unhex(F.replace(F.hex(content), F.lit("54524545"), F.lit("54524558")))  # no group is found
    spoilt = F.when(fate == 0, F.lit(b"CDF")).when(fate == 1, F.substring(content, 1, 700)).when(fate == 2, altered).otherwise(content)
    files = spark.read.format("binaryFile").load(f"{folder}/*").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content").withColumn("date", F.to_date(F.substring("name", 1, 8), "yyyyMMdd"))
    files = files.select("name", F.year("date").alias("year"), cal.noleap_doy(F.col("date")).alias("doy"), "content")
    grid_nc.store_files(files.select("name", spoilt.alias("content")), broken)
    read = grid_source.read_archive(spark, broken).groupBy("year", "doy").agg(F.count("data").alias("n"), F.sum(F.col("data").cast("decimal(18,2)")).alias("total"))
    every = files.select("year", "doy").join(read.withColumn("good", F.lit(1)), ["year", "doy"], "left")
    return every.groupBy("year").agg(F.count("*").alias("files"), F.count_if(F.col("good").isNull()).alias("failed"), F.sum("n").alias("present"), F.sum("total").cast("decimal(38,2)").alias("total"))


@query(ROUNDED)
def stream_files(spark, sf_dir):
    """The exact statistics from a stream over an archive that grows: half of its days, then the rest, which the stream goes on with."""
    folder, out = shared_folder(spark, "archive"), shared_folder(spark, "stream")
    rows = obs.with_grid(_li(spark, sf_dir), N_LON)
    for days in ((147, 200), (201, 248)):
        grid_nc.write_archive(rows.where(F.col("doy").between(*days)), folder, N_LAT, N_LON)
        found = run_archive(spark, folder, out, N_LON, YEARS, SEASON, tile_cells=10)
    return _rounded(found)


@query(f"""WITH {LI}, {_clim('c', 'obs')} SELECT 'observations' AS stage, count(*) AS "rows", count(v) AS present FROM obs
    UNION ALL SELECT 'statistics', count(*), count(p90) FROM c UNION ALL SELECT 'files', 92 * 25, count(p90) FROM c""")
def stage_report(spark, sf_dir):
    """What each stage from the tables to the files of a season has seen, counted while the stages run."""
    metrics, folder = StageMetrics(), shared_folder(spark, "fields")
    found = metrics.watch("statistics", clim.climatology(metrics.watch("observations", _li(spark, sf_dir), "v"), SEASON), "p90")
    grid_nc.write_fields(obs.with_grid(found, N_LON), folder, N_LAT, N_LON, value_type="double")
    metrics.watch("files", grid_source.read_archive(spark, folder, ["P90_sst"], "Lat", "Lon", on_error="fail"), "P90_sst").write.format("noop").mode("overwrite").save()
    counts = [(stage, *seen.values()) for stage, seen in metrics.report().items()]
    return spark.createDataFrame(counts, "stage string, rows long, present long")
