"""Gridded observations as long rows: (time, iy, ix, lat, lon, value, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.config import ENVELOPE, BUFFER_DEG, Region
from tephra.errors import GeometryError, GriddingError, UnknownStrategyError
from tephra.functions.calendar import period_key
from tephra.functions.geo import haversine_km, in_region
from tephra.operators.series import with_gaps

CELL = ("iy", "ix")


def cells(grid: DataFrame) -> DataFrame:
    """The distinct cells of a grid with their centres."""
    return grid.select("iy", "ix", "lat", "lon").distinct()


def clip(grid: DataFrame, region: Region) -> DataFrame:
    return grid.where(in_region(F.col("lon"), F.col("lat"), region))


def checked_clip(grid: DataFrame, region: Region) -> DataFrame:
    """A clip that refuses to be empty."""
    out = clip(grid, region)
    if out.isEmpty():
        raise GriddingError(f"no cell lies in region {region.name} {region.bbox}")
    return out


def composite(observations: DataFrame, freq: str = "W", min_cell_obs: int = 1, min_period_coverage: float = 0.25) -> DataFrame:
    """Mean over the valid observations of each cell and period, with coverage; gaps stay.

    A cell without `min_cell_obs` valid observations is NULL; a period with too small a share of such cells is NULL
    altogether. Empty periods between are rows with coverage 0. A period's total counts its observation times.
    """
    keyed = observations.withColumn("period", period_key(F.col("time"), freq))
    totals = keyed.groupBy("period").agg(F.count_distinct("time").alias("total"))
    by_cell = keyed.groupBy("period", "iy", "ix", "lat", "lon").agg(F.avg("value").alias("value"), F.count("value").alias("valid"))
    by_cell = by_cell.join(totals, "period")  # a row a period, which the planner may broadcast
    by_cell = with_gaps(by_cell, freq, ("iy", "ix", "lat", "lon"), "period")
    valid = F.coalesce("valid", F.lit(0)) >= min_cell_obs
    # a period's share is an aggregate joined back, not a window, which would hold all cells of a period in one task
    share = by_cell.groupBy("period").agg(F.avg(valid.cast("double")).alias("period_coverage"))
    out = by_cell.withColumn("coverage", F.coalesce(F.col("valid") / F.col("total"), F.lit(0.0))).join(share, "period")
    return out.select("period", "iy", "ix", "lat", "lon", F.when(valid & (F.col("period_coverage") >= min_period_coverage), F.col("value")).alias("value"), "coverage", "period_coverage")


def aoi_mean(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over all cells of a period; periods without a value are left out."""
    out = cube.groupBy(*by, F.col("period").alias("date")).agg(F.avg("value").alias("no2_attributed"), F.avg("coverage").alias("valid_coverage"))
    return out.where(F.col("no2_attributed").isNotNull()).withColumn("kind", F.lit("naive_aoi_mean_pre_attribution"))


def spacing(grid: DataFrame, axis: str, index: str) -> DataFrame:
    """Median step between neighbouring coordinates of an axis, whose distinct values one task orders."""
    steps = grid.select(index, axis).distinct().withColumn("step", F.abs(F.col(axis) - F.lag(axis).over(Window.orderBy(index))))
    return steps.agg(F.percentile("step", F.lit(0.5)).alias("spacing"))


def factors(grid: DataFrame, target_deg: float) -> tuple[int, int]:
    """Cells to a block on each axis; refuses a target finer than the grid."""
    own = [spacing(grid, a, i).first()[0] for a, i in (("lon", "ix"), ("lat", "iy"))]
    fx, fy = (round(target_deg / s) if s else 1 for s in own)
    if min(fx, fy) < 1:
        raise ValueError(f"{target_deg} degrees is finer than the grid; interpolation is refused")
    return fx, fy


def coarsen(cube: DataFrame, fx: int, fy: int, keys: Sequence[str] = ("period",), values: Sequence[str] = ("value", "coverage")) -> DataFrame:
    """Means of whole blocks of fx by fy cells, without NULLs; incomplete blocks at the far edges are dropped."""
    # the grid's extent is one row, joined to blocks that the aggregation has made fewer
    extent = cube.agg((F.max("ix") + 1).alias("nx"), (F.max("iy") + 1).alias("ny"))
    bx, by = F.floor(F.col("ix") / fx).cast("int"), F.floor(F.col("iy") / fy).cast("int")
    blocks = cube.groupBy(*keys, by.alias("iy"), bx.alias("ix")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *[F.avg(v).alias(v) for v in values])
    whole = (F.col("ix") < F.floor(F.col("nx") / fx)) & (F.col("iy") < F.floor(F.col("ny") / fy))
    return blocks.crossJoin(F.broadcast(extent)).where(whole).drop("nx", "ny")


def active(facilities: DataFrame, status: Sequence[str]) -> DataFrame:
    return facilities.where(F.col("status").isin(*status))


def envelope(facilities: DataFrame) -> DataFrame:
    return facilities.agg(F.min("longitude").alias("min_lon"), F.min("latitude").alias("min_lat"), F.max("longitude").alias("max_lon"), F.max("latitude").alias("max_lat"))


def radius_mask(grid_cells: DataFrame, facilities: DataFrame, radius_km: float, bucket_deg: float | None = None) -> DataFrame:
    """Cells within a distance of any facility.

    Cells and facilities meet by buckets of latitude at least as tall as the radius (each cell looks into three of
    them), so the join has an equality and its work doesn't grow as cells times facilities over the whole globe.
    Facilities in one place are one position. The buckets are made of the cells, not of the facilities, as the planner
    would otherwise move the join below a distinct of the cells and measure every observation of a cell anew.
    """
    tall = bucket_deg or max(radius_km / 111.0, 0.01)
    bucket = F.floor(F.col("lat") / tall)
    own = grid_cells.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = facilities.select(F.col("latitude").alias("__flat"), F.col("longitude").alias("__flon")).distinct().withColumn("__fb", F.floor(F.col("__flat") / tall))
    within = (F.col("__b") == F.col("__fb")) & (haversine_km(F.col("lat"), F.col("lon"), F.col("__flat"), F.col("__flon")) <= radius_km)
    return own.join(near, within, "left_semi").drop("__b").distinct()


def centroid(facilities: DataFrame) -> DataFrame:
    return facilities.agg(F.avg("longitude").alias("clon"), F.avg("latitude").alias("clat"))


def ring_mask(grid_cells: DataFrame, footprint: DataFrame, facilities: DataFrame | None, inner_km: float, outer_km: float, region: Region | None = None) -> DataFrame:
    """Cells between two distances of the centroid, outside the footprint and inside the region."""
    middle = centroid(facilities) if facilities is not None else footprint.agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    region = region or ENVELOPE.buffered(BUFFER_DEG)
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    ring = clip(grid_cells, region).crossJoin(F.broadcast(middle)).where(distance.between(inner_km, outer_km)).drop("clon", "clat")  # the centroid is one row
    return ring.join(footprint.select("iy", "ix"), list(CELL), "left_anti")


def checked_masks(grid_cells: DataFrame, facilities: DataFrame, radius_km: float, inner_km: float, outer_km: float, region: Region | None = None) -> tuple[DataFrame, DataFrame]:
    """Footprint and ring, refused where there are no facilities or no cells."""
    if facilities.isEmpty():
        raise GeometryError("no facilities")
    footprint = radius_mask(grid_cells, facilities, radius_km)
    if footprint.isEmpty():
        raise GeometryError(f"no cell within {radius_km} km of a facility")
    ring = ring_mask(grid_cells, footprint, facilities, inner_km, outer_km, region)
    if ring.isEmpty():
        raise GeometryError(f"no cell between {inner_km} and {outer_km} km")
    return footprint, ring


def masked_means(cube: DataFrame, masks: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Mean and coverage under each mask for every period, gap periods included: one pass over the cube.

    Masks are sets of cells; a flag for each is joined to the cells, and one aggregation reads all flags.
    """
    flags = None
    for name, mask in masks.items():
        part = mask.select(*CELL).distinct().withColumn("__mask", F.lit(name))
        flags = part if flags is None else flags.unionByName(part)
    flags = flags.groupBy(*CELL).agg(F.collect_set("__mask").alias("__in"))
    joined = cube.join(flags, list(CELL), "left")
    under = {name: F.coalesce(F.array_contains("__in", name), F.lit(False)) for name in masks}
    cols = [F.avg(F.when(u, F.col(c))).alias(f"{name}_{c}") for name, u in under.items() for c in ("value", "coverage")]
    return joined.groupBy(*by, F.col("period").alias("date")).agg(*cols)


_CORRECTION = {
    "subtract": lambda f, b: f - b,
    "normalise": lambda f, b: f / F.nullif(b, F.lit(0.0)),
}


def footprint_signal(cube: DataFrame, footprint: DataFrame, ring: DataFrame, mode: str = "subtract", by: Sequence[str] = ()) -> DataFrame:
    """Footprint against background by period."""
    if mode not in _CORRECTION:
        raise UnknownStrategyError("correction", mode, _CORRECTION)
    means = masked_means(cube, {"fp": footprint, "bg": ring}, by)
    fp, bg = F.col("fp_value"), F.col("bg_value")
    return means.select(*by, "date", fp.alias("no2_footprint"), bg.alias("no2_bg"), _CORRECTION[mode](fp, bg).alias("no2_corrected"), F.col("fp_coverage").alias("valid_coverage"))


def adaptive_radii(diagonal_km: float, radius: float = 15.0, inner: float = 25.0, outer: float = 60.0) -> tuple[float, float, float]:
    """Radius and ring that grow with the cells."""
    r = max(radius, 1.5 * diagonal_km)
    i = max(inner, r + 0.5 * diagonal_km)
    return r, i, max(outer, i + 35.0)


def nearest_axis(source: DataFrame, target: DataFrame, coord: str, index: str) -> DataFrame:
    """For each target coordinate the index of the nearest source coordinate (the smaller of two as near).

    Both axes are ordered together and each target coordinate looks at the source before and after it. One task orders
    them, as their sizes are those of an edge, not of the grid.
    """
    own = source.where(F.col(coord).isNotNull()).groupBy(F.col(coord).alias("c")).agg(F.min(index).alias("from")).select("c", "from", F.lit(0).alias("side"), F.lit(None).alias("to"))
    wanted = target.where(F.col(coord).isNotNull()).select(F.col(coord).alias("c"), F.lit(None).alias("from"), F.lit(1).alias("side"), F.col(index).alias("to")).distinct()
    here = F.when(F.col("side") == 0, F.struct("c", "from"))
    look = lambda c: F.last(here, ignorenulls=True).over(Window.orderBy(c, "side").rowsBetween(Window.unboundedPreceding, 0))
    found = own.unionByName(wanted).withColumn("below", look(F.asc("c"))).withColumn("above", look(F.desc("c"))).where("side = 1")
    away = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("c") - F.col(f"{s}.c")).alias("d"), F.col(f"{s}.from").alias("from")))
    return found.groupBy("to").agg(F.min(F.least(away("below"), away("above"))).alias("n")).select("to", F.col("n.from").alias("from"))


def regrid_nearest(source: DataFrame, target: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time",)) -> DataFrame:
    """Values of the nearest source cell, axis by axis, on the cells of the target."""
    ys = nearest_axis(source, target, "lat", "iy").select(F.col("to").alias("iy"), F.col("from").alias("__sy"))
    xs = nearest_axis(source, target, "lon", "ix").select(F.col("to").alias("ix"), F.col("from").alias("__sx"))
    mapped = cells(target).join(ys, "iy").join(xs, "ix")  # the planner broadcasts an axis by its measured size
    return source.select(*keys, F.col("iy").alias("__sy"), F.col("ix").alias("__sx"), *values).join(mapped, ["__sy", "__sx"]).drop("__sy", "__sx")


def overpass_hours(df: DataFrame, time: str = "time", first: int = 4, last: int = 6) -> DataFrame:
    """Rows in a window of hours, or all rows if no row is in it."""
    within = F.hour(time).between(first, last)
    some = df.agg(F.max(within).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(within | ~F.coalesce("__some", F.lit(False))).drop("__some")  # one row


def request_hours(first: int = 4, last: int = 6) -> list[str]:
    return [f"{h:02d}:00" for h in range(first, last + 1)]


def uniform_shape(observations: DataFrame) -> None:
    """Refuses observations whose grids differ in shape."""
    shapes = observations.groupBy("time").agg(F.count_distinct("iy").alias("ny"), F.count_distinct("ix").alias("nx")).select("ny", "nx").distinct().limit(2).collect()
    if not shapes:
        raise GriddingError("no observations")
    if len(shapes) > 1:
        raise GriddingError("grids of observations differ in shape")
