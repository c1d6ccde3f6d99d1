"""Window grids over rasters, and what follows from a window: corners, centers, coverage, area of interest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.functions import geo


def _starts(length: Column, size: Column, step: Column) -> Column:
    """0, step, 2 step ... as long as a whole window fits; none where the raster is smaller or the step not positive."""
    ok = (length >= size) & (step > 0) & (size > 0)
    return F.when(ok, F.sequence(F.lit(0).cast("long"), (length - size).cast("long"), F.when(step > 0, step.cast("long")).otherwise(F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))


def tile_grid(rasters: DataFrame, size: Column | int, overlap: Column | float = 0.25) -> DataFrame:
    """rasters (with width, height) with col_off, row_off, w, h of each overlapping window; what is left over at the edges drops."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    step = F.floor(size * (1 - overlap)).cast("long")
    rows = rasters.withColumn("row_off", F.explode(_starts(F.col("height"), size, step)))
    cols = rows.withColumn("col_off", F.explode(_starts(F.col("width"), size, step)))
    return cols.withColumn("w", size.cast("long")).withColumn("h", size.cast("long"))


def block_grid(rasters: DataFrame, most_px: Column | int) -> DataFrame:
    """rasters with col_off, row_off, w, h of blocks that cover all; the last of each row and column are cut."""
    most = (most_px if isinstance(most_px, Column) else F.lit(most_px)).cast("long")
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
    cut = rasters.withColumn("row_off", F.explode(starts(F.col("height")))).withColumn("col_off", F.explode(starts(F.col("width"))))
    return cut.withColumn("w", F.least(most, F.col("width") - F.col("col_off"))).withColumn("h", F.least(most, F.col("height") - F.col("row_off")))


def extent_px(extent_m: Column, gsd_m: Column) -> Column:
    """Pixels along an extent: rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(extent_m / gsd_m, 0).cast("int"))


def export_blocks(regions: DataFrame, gsd_m: float = 1.0, most_px: int = 1024) -> DataFrame:
    """The blocks in which a region (lon_min .. lat_max) is exported: pixel windows and their Web Mercator bounds."""
    m = regions.withColumn("x0", geo.mercator_x(F.col("lon_min"))).withColumn("x1", geo.mercator_x(F.col("lon_max"))).withColumn("y0", geo.mercator_y(F.col("lat_min"))).withColumn("y1", geo.mercator_y(F.col("lat_max")))
    sized = m.withColumn("width", extent_px(F.col("x1") - F.col("x0"), F.lit(gsd_m))).withColumn("height", extent_px(F.col("y1") - F.col("y0"), F.lit(gsd_m)))
    px, py = (F.col("x1") - F.col("x0")) / F.col("width"), (F.col("y1") - F.col("y0")) / F.col("height")
    blocks = block_grid(sized, most_px)
    return blocks.select(
        *regions.columns, "width", "height", "col_off", "row_off", "w", "h", (F.col("x0") + F.col("col_off") * px).alias("xmin"), (F.col("y1") - (F.col("row_off") + F.col("h")) * py).alias("ymin"),
        (F.col("x0") + (F.col("col_off") + F.col("w")) * px).alias("xmax"), (F.col("y1") - F.col("row_off") * py).alias("ymax"),
    )


def georeferenced(windows: DataFrame, crs: str = "EPSG:3857") -> DataFrame:
    """windows (a..f of the affine map, col_off, row_off, w, h) with the corners and center of each in degrees.

    Only the upper left and lower right corners are mapped, so a box in a turned raster is an approximation.
    EPSG:3857, EPSG:4326 and UTM zones (EPSG:326xx, EPSG:327xx) are known.
    """
    at = lambda c, r: (F.col("a") * c + F.col("b") * r + F.col("c"), F.col("d") * c + F.col("e") * r + F.col("f"))
    x0, y0 = at(F.col("col_off"), F.col("row_off"))
    x1, y1 = at(F.col("col_off") + F.col("w"), F.col("row_off") + F.col("h"))
    code = int(crs.split(":")[1])

    def degrees(x, y):
        if code == 4326:
            return x, y
        if code == 3857:
            return geo.mercator_lon(x), geo.mercator_lat(y)
        if code // 100 in (326, 327):
            p = geo.utm_to_lonlat(x, y, F.lit(code % 100), F.lit(code // 100 == 327))
            return p["lon"], p["lat"]
        raise ValueError(f"unknown reference system {crs}")

    (lon0, lat0), (lon1, lat1) = degrees(x0, y0), degrees(x1, y1)
    box = windows.select("*", F.least(lon0, lon1).alias("lon_min"), F.least(lat0, lat1).alias("lat_min"), F.greatest(lon0, lon1).alias("lon_max"), F.greatest(lat0, lat1).alias("lat_max"))
    return box.withColumn("center_lon", (F.col("lon_min") + F.col("lon_max")) / 2).withColumn("center_lat", (F.col("lat_min") + F.col("lat_max")) / 2)


def touching(boxes: DataFrame, lon_min, lat_min, lon_max, lat_max) -> DataFrame:
    """Boxes that meet the area of interest; a common border is enough."""
    return boxes.filter(~((F.col("lon_max") < lon_min) | (F.col("lon_min") > lon_max) | (F.col("lat_max") < lat_min) | (F.col("lat_min") > lat_max)))


def box_join(left: DataFrame, right: DataFrame, cell: float = 1.0) -> DataFrame:
    """All pairs of boxes that meet (lon_min .. lat_max in both; right's columns carry the prefix r_).

    Boxes are dealt by the grid cells that they cover, and a pair counts in its first common cell only, so no pair is
    made twice and nothing is compared with everything.
    """
    def cells(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return df.withColumn("__cx", F.explode(span("lon_min", "lon_max"))).withColumn("__cy", F.explode(span("lat_min", "lat_max")))

    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    r = cells(right).withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    met = cells(left).join(r, ["__cx", "__cy"])
    lon0, lat0, lon1, lat1 = (F.col(c) for c in names)
    ok = ~((lon1 < F.col("r_lon_min")) | (lon0 > F.col("r_lon_max")) | (lat1 < F.col("r_lat_min")) | (lat0 > F.col("r_lat_max")))
    first = (F.col("__cx") == F.floor(F.greatest(lon0, F.col("r_lon_min")) / cell)) & (F.col("__cy") == F.floor(F.greatest(lat0, F.col("r_lat_min")) / cell))
    return met.filter(ok & first).drop("__cx", "__cy")


def cut_raster(rasters: DataFrame, size: int = 256, overlap: float = 0.25, min_coverage: float = 0.8, any_band: bool = True, normalize: bool = False) -> DataFrame:
    """Rasters (raster_id, image) cut to windows with enough pixels: (raster_id, col_off, row_off, coverage, image).

    Coverage is the share of pixels with some band over 0, or with a non-zero first (red) band; a window under the
    threshold drops. Bands are stretched window by window if asked.
    """
    from terralens.operators.image import from_struct, stretched, to_struct

    if not 0 <= overlap < 1:
        raise ValueError("overlap lies in [0, 1)")
    step = int(size * (1 - overlap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        names = ["raster_id", "col_off", "row_off", "coverage", "image"]
        for b in batches:
            for key, x in zip(b.column("raster_id").to_pylist(), b.column("image").to_pylist(), strict=True):
                image, out = from_struct(x), []
                bands = image if image.ndim == 3 else image[..., None]
                for r in range(0, bands.shape[0] - size + 1, max(1, step)):
                    for c in range(0, bands.shape[1] - size + 1, max(1, step)):
                        part = bands[r : r + size, c : c + size]
                        filled = (part > 0).any(-1) if any_band else part[..., -1] != 0  # red is the last of BGR
                        if (share := float(filled.mean())) >= min_coverage:
                            cut = stretched(part, flat=0) if normalize else part
                            out.append((key, c, r, share, to_struct(cut if image.ndim == 3 else cut[..., 0], x["origin"])))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("raster_id").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], kind)], names)

    from terralens.operators.image import IMAGE

    id_type = rasters.schema["raster_id"].dataType.simpleString()
    return rasters.select("raster_id", "image").mapInArrow(run, f"raster_id {id_type}, col_off long, row_off long, coverage double, image {IMAGE}")
