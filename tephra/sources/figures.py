"""What a map of one overpass shows, as rows, and as a picture of a bounded number of cells."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.errors import GriddingError
from tephra.sources import files

#: Cells of the largest grid that is drawn; a picture is one small file on the driver.
MOST_CELLS = 250_000
# Low to high, and the marks of facilities.
PALETTE, MARK, EMPTY = np.array([(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)], float), (220, 30, 30), (255, 255, 255)


def map_layers(overpass: DataFrame, facilities: DataFrame) -> DataFrame:
    """(layer, lon, lat, value): the cells of an overpass and the facilities over them."""
    field = overpass.select(F.lit("field").alias("layer"), "lon", "lat", "value")
    return field.unionByName(facilities.select(F.lit("facility").alias("layer"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.lit(None).cast("double").alias("value")))


def png(pixels: np.ndarray) -> bytes:
    """A picture of rows of RGB bytes."""
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def draw(layers: DataFrame, scale: int = 8) -> bytes:
    """The field, north up, with a mark at the cell nearest to each facility; cells without a value stay white."""
    field = layers.where("layer = 'field'").select("lon", "lat", "value")
    if field.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise GriddingError(f"more than {MOST_CELLS} cells; clip or coarsen the grid first")
    rows = field.collect()
    if not rows:
        raise GriddingError("no cell to draw")
    lon, lat = np.unique([r["lon"] for r in rows]), np.unique([r["lat"] for r in rows])[::-1]
    grid = np.full((len(lat), len(lon)), np.nan)
    grid[np.searchsorted(-lat, [-r["lat"] for r in rows]), np.searchsorted(lon, [r["lon"] for r in rows])] = [np.nan if r["value"] is None else r["value"] for r in rows]
    known = grid[~np.isnan(grid)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 1.0)
    place = np.nan_to_num((grid - low) / ((high - low) or 1)) * (len(PALETTE) - 1)
    colours = np.stack([np.interp(place, np.arange(len(PALETTE)), PALETTE[:, c]) for c in range(3)], axis=-1)
    colours[np.isnan(grid)] = EMPTY
    picture = colours.repeat(scale, 0).repeat(scale, 1)
    cells = F.lit(float(lon[0])), F.lit(float(lat[-1]))
    step = [float(np.diff(a).mean()) if len(a) > 1 else 1.0 for a in (lon, lat[::-1])]
    near = layers.where("layer = 'facility'").select(F.round((F.col("lon") - cells[0]) / step[0]).cast("int").alias("x"), F.round((F.col("lat") - cells[1]) / step[1]).cast("int").alias("y"))
    inside = near.where(F.col("x").between(0, len(lon) - 1) & F.col("y").between(0, len(lat) - 1)).distinct()
    for r in inside.collect():  # a row a cell at most
        at, half = ((len(lat) - 1 - r["y"]) * scale, r["x"] * scale), max(1, scale // 4)
        picture[at[0] + half : at[0] + scale - half, at[1] + half : at[1] + scale - half] = MARK
    return png(picture)


def write_map(layers: DataFrame, path: str, scale: int = 8) -> None:
    files.write_bytes(layers.sparkSession, path, draw(layers, scale))
