"""Windows put together from the blocks that they touch: blocks and windows meet on a key, crops meet by window.

No task holds a mosaic. A window asks for the cells it touches, the join gives it those blocks, the crop of each is cut
out by Spark row by row, and what a window gathers is as large as the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.operators.image import IMAGE, from_struct, to_struct

IMAGE_TYPE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])


def cut(met: DataFrame) -> DataFrame:
    """Windows x, y, w, h beside a block x0, y0, bw, bh, unit (bytes a pixel), data (rows of pixels): the block's part of the window.

    `row` and `col` say where in the window it begins, `lines` are its rows of bytes; pairs that share no pixel drop.
    """
    left, top = F.greatest("x", "x0"), F.greatest("y", "y0")
    right, bottom = F.least(F.col("x") + F.col("w"), F.col("x0") + F.col("bw")), F.least(F.col("y") + F.col("h"), F.col("y0") + F.col("bh"))
    met = met.withColumns({"__l": left, "__t": top, "__r": right, "__b": bottom}).filter("__l < __r and __t < __b")
    line = "substring(data, cast(((k - y0) * bw + __l - x0) * unit + 1 as int), cast((__r - __l) * unit as int))"
    out = met.withColumn("lines", F.expr(f"transform(sequence(__t, __b - 1), k -> {line})"))
    return out.withColumns({"row": F.col("__t") - F.col("y"), "col": F.col("__l") - F.col("x")}).drop("x0", "y0", "bw", "bh", "data", "__l", "__t", "__r", "__b")


def laid(pieces: list[dict], h: int, w: int, unit: int) -> np.ndarray:
    """h x w x unit bytes: the crops at their places, zeros elsewhere."""
    out = np.zeros((h, w, unit), np.uint8)
    for p in pieces:
        part = np.frombuffer(b"".join(p["lines"]), np.uint8).reshape(len(p["lines"]), -1, unit)
        out[p["row"] : p["row"] + part.shape[0], p["col"] : p["col"] + part.shape[1]] = part
    return out


def _blocks(blocks: DataFrame, *more) -> DataFrame:
    size = lambda c: F.col(f"image.{c}").cast("long")
    return blocks.select("raster_id", *more, F.col("col_off").cast("long").alias("x0"), F.col("row_off").cast("long").alias("y0"), size("width").alias("bw"), size("height").alias("bh"), size("nChannels").alias("unit"), F.col("image.data").alias("data"))


def _put_together(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Images of windows from their pieces (null where a window has none): what a window gathers is as large as the window."""
    joined = pieces.groupBy(*key).agg(F.collect_list("piece").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, shares, errors = [], [], []
            for w, h, parts in zip(*(b.column(c).to_pylist() for c in ("w", "h", "pieces")), strict=True):
                units = {p["unit"] for p in parts}
                if len(units) > 1:
                    images.append(None)
                    shares.append(None)
                    errors.append(f"blocks of {sorted(units)} channels")
                    continue
                out = laid(parts, h, w, units.pop() if units else 1)
                images.append(to_struct(out if out.shape[2] > 1 else out[..., 0]))
                shares.append(float(out.any(2).mean()))
                errors.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(images, IMAGE_TYPE), pa.array(shares, pa.float64()), pa.array(errors, pa.string())], [*key, "image", "valid_fraction", "err"])

    kinds = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in key)
    out = joined.mapInArrow(run, f"{kinds}, image {IMAGE}, valid_fraction double, err string")
    return out.withColumnsRenamed({"x": "col_off", "y": "row_off"})


_PIECE = ("row", "col", "lines", "unit")


def mosaic_patches(blocks: DataFrame, windows: DataFrame, block_px: int, *keep: str) -> DataFrame:
    """(raster_id, keep ..., col_off, row_off, w, h, image, valid_fraction, err): each window as it would be cut from the undivided raster.

    blocks (raster_id, col_off, row_off, image) lie on a grid of block_px pixels, the last ones of each row and column cut;
    windows (raster_id, col_off, row_off, w, h and the columns of `keep`) lie anywhere. Blocks and windows meet on the cell
    of that grid; a block that most windows ask for is a skewed side of a plain join, which Spark splits. Pixels of missing
    blocks, or outside, are 0; valid_fraction is the share of pixels that aren't black in all channels. Blocks of one raster
    have equally many channels (else err, and no image); a window that touches no block has one black channel. A window
    that stands twice has one row.
    """
    cells = lambda at, size: F.sequence(F.floor(F.col(at) / block_px), F.floor((F.col(at) + F.col(size) - 1) / block_px))
    asked = windows.select("raster_id", *keep, F.col("col_off").alias("x"), F.col("row_off").alias("y"), F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")).filter("w > 0 and h > 0")
    met = asked.withColumn("bx", F.explode(cells("x", "w"))).withColumn("by", F.explode(cells("y", "h")))
    grid = _blocks(blocks, F.floor(F.col("col_off") / block_px).alias("bx"), F.floor(F.col("row_off") / block_px).alias("by"))
    key = ["raster_id", *keep, "x", "y", "w", "h"]
    found = cut(met.join(grid, ["raster_id", "bx", "by"])).select(*key, F.struct(*_PIECE).alias("piece"))
    # windows without blocks have no piece, but a row
    return _put_together(found.unionByName(asked, allowMissingColumns=True), key)


def grid_patches(blocks: DataFrame, size: int, overlap: float = 0.25) -> DataFrame:
    """The windows of tiling.tile_grid as mosaic_patches gives them, of rasters that come as blocks (raster_id, width, height, col_off, row_off, image).

    width and height are the raster's. A block knows which windows of a regular grid it touches, so nothing is joined and
    only the windows' parts travel. Windows none of whose blocks came are left out.
    """
    step = int(size * (1 - overlap))
    if overlap < 0 or step < 1:
        raise ValueError("windows step on by a pixel at least, and leave none out")

    def starts(at: str, length: str, whole: str):
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(at) - size + 1) / step))
        last = F.floor(F.least(F.col(at) + F.col(length) - 1, F.col(whole).cast("long") - size) / step)
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))

    rows = _blocks(blocks, "width", "height").withColumn("y", F.explode(starts("y0", "bh", "height"))).withColumn("x", F.explode(starts("x0", "bw", "width")))
    key = ["raster_id", "x", "y", "w", "h"]
    parts = cut(rows.withColumns({"w": F.lit(size).cast("long"), "h": F.lit(size).cast("long")}))
    return _put_together(parts.select(*key, F.struct(*_PIECE).alias("piece")), key)


def split_blocks(rasters: DataFrame, block_px: int) -> DataFrame:
    """rasters (raster_id, image) as blocks (raster_id, width, height, col_off, row_off, image), the last of each row and column cut: how an export gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, x in zip(b.column("raster_id").to_pylist(), b.column("image").to_pylist(), strict=True):
                image, rows = from_struct(x), []
                for r in range(0, image.shape[0], block_px):
                    for c in range(0, image.shape[1], block_px):
                        rows.append((key, image.shape[1], image.shape[0], c, r, to_struct(image[r : r + block_px, c : c + block_px], x["origin"])))
                if rows:
                    kinds = (b.schema.field("raster_id").type, *[pa.int64()] * 4, IMAGE_TYPE)
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["raster_id", "width", "height", "col_off", "row_off", "image"])

    id_type = rasters.schema["raster_id"].dataType.simpleString()
    return rasters.select("raster_id", "image").mapInArrow(run, f"raster_id {id_type}, width long, height long, col_off long, row_off long, image {IMAGE}")
