from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tephra import registry
from tephra.config import ENVELOPE, Region
from tephra.errors import GeometryError, GriddingError, UnknownStrategyError
from tephra.operators import grid as g

D = dt.date
SCHEMA = "time date, iy int, ix int, lat double, lon double, value double"


def _obs(spark, per_day: dict, ny=2, nx=2, lat0=39.7, lon0=118.3, step=0.05):
    rows = [(day, y, x, lat0 - step * y, lon0 + step * x, v[y][x]) for day, v in per_day.items() for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, SCHEMA)


def test_composite_means_and_masks_sparse_periods(spark):
    obs = _obs(spark, {D(2020, 1, 6): [[1.0, 2.0], [3.0, 4.0]], D(2020, 1, 7): [[3.0, None], [5.0, 6.0]], D(2020, 1, 28): [[9.0, None], [None, None]]})
    out = {(r.period, r.iy, r.ix): r for r in g.composite(obs, "W", 1, 0.5).collect()}
    first, last = D(2020, 1, 12), D(2020, 2, 2)
    assert out[first, 0, 0].value == 2.0 and out[first, 0, 1].value == 2.0 and out[first, 0, 1].coverage == 0.5
    assert out[D(2020, 1, 19), 0, 0].value is None and out[D(2020, 1, 19), 0, 0].coverage == 0.0
    assert out[last, 0, 0].value is None and out[last, 0, 0].period_coverage == 0.25  # one of four cells is too little
    kept = {(r.period, r.iy, r.ix): r.value for r in g.composite(obs, "W", 2, 0.0).collect()}
    assert kept[first, 0, 1] is None and kept[first, 1, 1] == 5.0


def _cube(spark, n=4):
    rows = [(D(2020, 1, 5), y, x, 39.7 - 0.05 * y, 118.3 + 0.05 * x, None if (y, x) in ((0, 2), (0, 3), (1, 2), (1, 3)) else 10.0 * y + x, 1.0) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "period date, iy int, ix int, lat double, lon double, value double, coverage double")


def test_coarsen_is_a_block_mean_and_trims(spark):
    out = {(r.iy, r.ix): r.value for r in g.coarsen(_cube(spark), 2, 2).collect()}
    assert out == {(0, 0): 5.5, (0, 1): None, (1, 0): 25.5, (1, 1): 27.5}
    assert {(r.iy, r.ix) for r in g.coarsen(_cube(spark, 5), 2, 2).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_factors_refuse_finer_grids(spark):
    assert g.factors(_cube(spark), 0.10) == (2, 2)
    with pytest.raises(ValueError):
        g.factors(_cube(spark), 0.02)


def _haversine(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))


def test_radius_mask_equals_brute_force_and_ring_is_disjoint(spark):
    cells = [(y, x, 40.4 - 0.1 * y, 117.6 + 0.1 * x) for y in range(16) for x in range(16)]
    grid = spark.createDataFrame(cells, "iy int, ix int, lat double, lon double")
    fac = [("a", 39.61, 118.21, "x", "operating"), ("b", 39.6, 118.2, "x", "operating"), ("c", 39.95, 118.5, "x", "operating pre-retirement"), ("d", 39.1, 117.9, "x", "retired")]
    table = spark.createDataFrame(fac, "name string, latitude double, longitude double, technology string, status string")
    active = g.active(table, ("operating", "operating pre-retirement"))
    assert active.count() == 3
    got = {(r.iy, r.ix) for r in g.radius_mask(grid, active, 15.0).collect()}
    assert got == {(y, x) for y, x, la, lo in cells if min(_haversine(la, lo, f[1], f[2]) for f in fac[:3]) <= 15}
    ring = {(r.iy, r.ix) for r in g.ring_mask(grid, g.radius_mask(grid, active, 15.0), active, 25.0, 60.0).collect()}
    assert ring and not ring & got
    with pytest.raises(GeometryError):
        g.checked_masks(grid, active.limit(0), 15, 25, 60)
    with pytest.raises(GeometryError):
        g.checked_masks(grid, active, 15, 4000, 4001)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _distances_join(df):
    """For each join by distance in a plan: whether its cells and its facilities are made distinct before it."""
    joins = [n for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and "LeftSemi" in n.toString().split("\n")[0] and "ASIN" in n.toString().split("\n")[0]]
    return [tuple(any(n.nodeName() == "Aggregate" for n in _nodes(n.children().apply(side))) for side in (0, 1)) for n in joins]


def test_radius_mask_measures_a_cell_and_a_place_once(spark):
    """The planner moved the join below the distinct of the cells, where it measured every observation anew."""
    obs = _obs(spark, {D(2020, 1, 6): [[1.0, 2.0], [3.0, 4.0]], D(2020, 1, 7): [[1.0, 2.0], [3.0, 4.0]]})
    fac = spark.createDataFrame([(f"f{i}", 39.7 - 0.05 * (i % 2), 118.3) for i in range(40)], "name string, latitude double, longitude double")
    mask = g.radius_mask(g.cells(obs), fac, 1.0)
    assert _distances_join(mask) == [(True, True)]
    assert sorted((r.iy, r.ix) for r in mask.collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("name", ["footprint_normalise", "footprint_mask", "footprint_subtract", "radius_sweep"])
def test_footprint_queries_measure_a_cell_once(spark, sf_dir, name):
    found = _distances_join(registry.QUERIES[name](spark, sf_dir))
    assert found and set(found) == {(True, True)}


def test_footprint_modes(spark):
    cube, cells = _cube(spark), g.cells(_cube(spark))
    fp, bg = cells.where("iy = 3"), cells.where("iy = 0 and ix < 2")
    row = g.footprint_signal(cube, fp, bg).first()
    assert (row.no2_footprint, row.no2_bg, row.no2_corrected) == (31.5, 0.5, 31.0)
    assert g.footprint_signal(cube, fp, bg, "normalise").first().no2_corrected == 63.0
    assert g.footprint_signal(cube, fp, cells.where("iy = 0 and ix = 0"), "normalise").first().no2_corrected is None
    with pytest.raises(UnknownStrategyError):
        g.footprint_signal(cube, fp, bg, "divide")


def test_gap_periods_survive_the_mask(spark):
    cells = g.cells(_cube(spark))
    row = g.footprint_signal(_cube(spark), cells.where("iy < 2 and ix > 1"), cells.where("iy = 3")).first()
    assert row.no2_footprint is None and row.no2_corrected is None


def test_clip_and_shapes(spark):
    with pytest.raises(GriddingError):
        g.checked_clip(_cube(spark), Region("far", 0, 0, 1, 1))
    assert g.checked_clip(_cube(spark), ENVELOPE).count() == 16
    obs = _obs(spark, {D(2020, 1, 6): [[1.0, 2.0], [3.0, 4.0]]}).union(_obs(spark, {D(2020, 1, 7): [[1.0, 2.0, 3.0]]}, ny=1, nx=3))
    with pytest.raises(GriddingError):
        g.uniform_shape(obs)


def test_hours_fall_back_to_all(spark):
    t = spark.sql("select timestamp '2020-01-01 05:00:00' as time union all select timestamp '2020-01-01 12:00:00'")
    assert g.overpass_hours(t).count() == 1
    assert g.overpass_hours(t.where("hour(time) = 12")).count() == 1
    assert g.request_hours() == ["04:00", "05:00", "06:00"]


def test_region():
    r = Region("r", 0, 0, 1, 1).buffered(0.5)
    assert r.bbox == (-0.5, -0.5, 1.5, 1.5) and r.contains(1.5, -0.5) and not r.contains(1.6, 0)
    assert g.adaptive_radii(1.0) == (15.0, 25.0, 60.0) and g.adaptive_radii(20.0) == (30.0, 40.0, 75.0)


def test_regrid_takes_the_nearest_cell(spark):
    src = spark.createDataFrame([(D(2020, 1, 1), y, x, 40.0 - y, 118.0 + x, float(10 * y + x)) for y in range(2) for x in range(2)], "time date, iy int, ix int, lat double, lon double, blh double")
    dst = spark.createDataFrame([(0, 0, 39.9, 118.4), (0, 1, 39.9, 118.7), (1, 0, 39.2, 118.4), (1, 1, 39.2, 118.7)], "iy int, ix int, lat double, lon double")
    out = {(r.iy, r.ix): r.blh for r in g.regrid_nearest(src, dst, ["blh"]).collect()}
    assert out == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 10.0, (1, 1): 11.0}
