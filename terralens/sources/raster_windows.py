"""Windows of remote tiled rasters: an index of tiles, the byte ranges that windows need, and nothing else read.

    levels, tiles = tile_index(paths)                     # tables; store them once for many windows
    read_windows(meter_windows(points, levels, 1200.0), levels, tiles)

The bytes come from files or HTTP servers that answer range requests, read in the tasks, or from a table of byte blocks in
any store that Spark reads (`byte_blocks`). `tiled_tiff` is the same for one raster as a data source, with a partition for
each run of bytes.
"""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from terralens.functions import geo
from terralens.sources import tables, tiff
from terralens.sources.files import retried

Ranges = Callable[[int, int], bytes]
RUN_BYTES = 4 << 20


def file_or_http(path: str) -> Ranges:
    """get(offset, length) for a local file or a URL; short at the end, as files are. Requests are tried three times."""
    if path.startswith(("http://", "https://")):

        def ask(offset: int, n: int) -> bytes:
            request = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + n - 1}"})
            with urllib.request.urlopen(request, timeout=60) as answer:
                if answer.status == 200 and offset:
                    raise OSError(f"{path} does not answer range requests")
                return answer.read(n)

        return lambda offset, n: retried(lambda: ask(offset, n))
    name = path.removeprefix("file://").removeprefix("file:")

    def get(offset: int, n: int) -> bytes:
        with open(name, "rb") as f:
            return os.pread(f.fileno(), n, offset)

    return get


# --- the index ----------------------------------------------------------------------------------------------------

_LEVEL = "level int, width long, height long, tile_w long, tile_h long, across long, down long, samples int, kind string, packing int, predictor int, apart boolean"
_PLACE = "west double, north double, px double, py double, epsg int"
_INDEX = f"{_LEVEL}, {_PLACE}, offsets array<bigint>, sizes array<bigint>, err string"


def _index_rows(head: Callable[[dict], Ranges]):
    names = [c.split()[0] for c in f"{_LEVEL}, {_PLACE}".split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [pa.string(), *(kinds[c.split()[1]] for c in f"{_LEVEL}, {_PLACE}".split(", ")), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in b.to_pylist():
                try:
                    levels, where = tiff.index(head(row))
                    place = (where["west"], where["north"], *(where["pixel"] or (None, None)), where["epsg"])
                    rows += [(row["path"], k, x.width, x.height, x.tile_w, x.tile_h, x.across, x.down, x.samples, x.kind, x.packing, x.predictor, x.apart, *place, x.offsets.tolist(), x.sizes.tolist(), None) for k, x in enumerate(levels)]
                except Exception as e:  # reported in the row
                    rows.append((row["path"], *[None] * (len(types) - 2), str(e)[:200] or type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", *names, "offsets", "sizes", "err"])

    return run


def tile_index(paths: DataFrame, open_: Callable[[str], Ranges] = file_or_http, blocks: DataFrame | None = None, block: int = 1 << 16, head_blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """levels (path, level, its size, tiles and packing, west, north, px, py, epsg, err) and tiles (path, level, tile, offset, size).

    paths (path). A file that can't be read has one row of levels, with err. Of `blocks` (see byte_blocks) the first ones of
    each file are taken, which must hold the directories, as in files made for remote reading. The tables are written, so
    that files are opened once however often they are used.
    """
    if blocks is None:
        rows = paths.select("path").mapInArrow(_index_rows(lambda row: open_(row["path"])), f"path string, {_INDEX}")
        rows = tables.once(rows)
    else:
        heads = blocks.filter(F.col("begin") < block * head_blocks)
        if head_blocks > 1:
            heads = heads.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("begin", "data"))).alias("b")).select("path", "b.data")
        else:
            heads = heads.select("path", F.array("data").alias("data"))

        def held(row: dict) -> Ranges:
            data = b"".join(row["data"])
            return lambda offset, n: data[offset : offset + n]

        known = tables.once(heads.mapInArrow(_index_rows(held), f"path string, {_INDEX}"))
        asked = paths.select("path").distinct().join(known, "path", "left")
        rows = asked.withColumn("err", F.when(F.col("level").isNull(), F.coalesce("err", F.lit("no such file"))))
    pairs = F.posexplode(F.arrays_zip("offsets", "sizes")).alias("tile", "t")
    tiles = rows.select("path", "level", pairs).select("path", "level", "tile", F.col("t.offsets").alias("offset"), F.col("t.sizes").alias("size"))
    return rows.drop("offsets", "sizes"), tiles


def byte_blocks(files: DataFrame, block: int = 1 << 16) -> DataFrame:
    """files (path, content) as (path, begin, data) in blocks of bytes, so that stores without range requests give parts of files too.

    Write it sorted by path and begin: a read of some blocks then skips the rest by the files' statistics.
    """
    cut = F.expr(f"transform(sequence(0, (octet_length(content) - 1) div {block}), k -> struct(cast(k * {block} as bigint) as begin, substring(content, cast(k * {block} + 1 as int), {block}) as data))")
    return files.filter(F.octet_length("content") > 0).select("path", F.inline(cut))


def as_tiled(images: DataFrame, tile: int = 256, overviews: int = 4, **options) -> DataFrame:
    """(path, content): images (path, image) as tiled TIFF files with overviews; options as of tiff.tiled."""
    from terralens.operators.image import from_struct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, content, size = [], [], 0
            for path, x in zip(b.column("path").to_pylist(), b.column("image").to_pylist(), strict=True):
                paths.append(path)
                content.append(tiff.tiled(from_struct(x), tile, overviews, **options))
                size += len(content[-1])
                if size > RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(content, pa.binary())], ["path", "content"])
                    paths, content, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    return images.select("path", "image").mapInArrow(run, "path string, content binary")


# --- windows ------------------------------------------------------------------------------------------------------


def meter_windows(points: DataFrame, levels: DataFrame, size_m: float) -> DataFrame:
    """points (window_id, path, lon, lat) as pixel windows (window_id, path, x, y, w, h) of size_m meters a side in rasters in degrees."""
    base = levels.filter("level = 0 and err is null").select("path", "west", "north", "px", "py")
    box = points.withColumn("__box", geo.window_around(F.col("lon"), F.col("lat"), F.lit(float(size_m)))).join(base, "path")
    across, down = F.col("__box.lon_max") - F.col("__box.lon_min"), F.col("__box.lat_max") - F.col("__box.lat_min")
    return box.select("window_id", "path", ((F.col("__box.lon_min") - F.col("west")) / F.col("px")).alias("x"), ((F.col("north") - F.col("__box.lat_max")) / F.col("py")).alias("y"), (across / F.col("px")).alias("w"), (down / F.col("py")).alias("h"))


def planned(windows: DataFrame, levels: DataFrame, max_px: int = 2000) -> DataFrame:
    """windows with their output size (out_w, out_h), the level they are read from, and the level's pixels that they need (x0, y0, w0, h0).

    The longer side has max_px pixels at most. The level is the smallest one that still has a pixel for each of the output.
    """
    scale = F.least(F.lit(1.0), max_px / F.greatest("w", "h"))
    sized = windows.select("window_id", "path", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h"))).filter("w > 0 and h > 0")
    sized = sized.withColumns({"out_w": F.greatest(F.lit(1), F.bround(F.col("w") * scale).cast("int")), "out_h": F.greatest(F.lit(1), F.bround(F.col("h") * scale).cast("int"))})
    first = levels.filter("level = 0 and err is null").select("path", F.col("width").alias("width0"), F.col("height").alias("height0"))
    known = levels.filter("err is null").drop("err").join(first, "path")
    fits = (F.col("w") * F.col("width") >= F.col("out_w") * F.col("width0")) & (F.col("h") * F.col("height") >= F.col("out_h") * F.col("height0")) | (F.col("level") == 0)
    met = sized.join(known, "path").filter(fits).groupBy("window_id").agg(F.max_by(F.struct("*"), "level").alias("p")).select("p.*")
    fx, fy = F.col("width") / F.col("width0"), F.col("height") / F.col("height0")
    met = met.withColumns({"x": F.col("x") * fx, "w": F.col("w") * fx, "y": F.col("y") * fy, "h": F.col("h") * fy}).drop("width0", "height0")
    out = met.withColumns({"x0": F.floor(F.col("x") - 0.5), "y0": F.floor(F.col("y") - 0.5)})
    return out.withColumns({"w0": F.ceil(F.col("x") + F.col("w") + 0.5) - F.col("x0"), "h0": F.ceil(F.col("y") + F.col("h") + 0.5) - F.col("y0")})


def touched(plan: DataFrame, tiles: DataFrame) -> DataFrame:
    """(window_id, path, level, tile, offset, size) and how the tile is packed: a row for each tile of a plane that a window needs; none for windows outside."""
    span = lambda at, size, tile, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(at) / F.col(tile))), F.least(F.col(n) - 1, F.floor((F.col(at) + F.col(size) - 1) / F.col(tile))))
    inside = plan.filter("x0 < width and y0 < height and x0 + w0 > 0 and y0 + h0 > 0")
    rows = inside.withColumn("__c", F.explode(span("x0", "w0", "tile_w", "across"))).withColumn("__r", F.explode(span("y0", "h0", "tile_h", "down")))
    rows = rows.withColumn("plane", F.explode(F.when(F.col("apart"), F.sequence(F.lit(0), F.col("samples") - 1)).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("tile", (F.col("plane") * F.col("across") * F.col("down") + F.col("__r") * F.col("across") + F.col("__c")).cast("int"))
    return rows.select("window_id", "path", "level", "tile", "plane", "x0", "y0", "w0", "h0", "width", "height", "tile_w", "tile_h", "across", "down", "samples", "kind", "packing", "predictor", "apart").join(tiles, ["path", "level", "tile"])


_ASKS = 256
#: What a level's tiles have in common.
_PACKED = ("width", "height", "tile_w", "tile_h", "across", "down", "samples", "kind", "packing", "predictor", "apart")


def asked_tiles(near: DataFrame) -> DataFrame:
    """A row for each touched tile and up to some hundred windows that touch it (asks); a tile of very many windows has several."""
    tile = ["path", "level", "tile"]
    many = near.groupBy(*tile).agg(F.count(F.lit(1)).alias("__n"))
    dealt = near.join(many, tile).withColumn("part", F.pmod(F.xxhash64("window_id"), F.ceil(F.col("__n") / _ASKS)))
    about = [F.first(c).alias(c) for c in ("plane", "offset", "size", *_PACKED)]
    return dealt.groupBy(*tile, "part").agg(*about, F.collect_list(F.struct("window_id", "x0", "y0", "w0", "h0")).alias("asks"))


def byte_runs(tiles: DataFrame, most_gap: int = 0) -> DataFrame:
    """(path, level, begin, length, tiles): tiles of a level that follow each other in a file (gaps up to most_gap) as one request, of a few megabytes at most."""
    distinct = tiles.filter("size > 0").withColumn("__near", F.floor(F.col("offset") / RUN_BYTES))
    order = Window.partitionBy("path", "level", "__near", "part").orderBy("offset", "tile")
    end = F.max(F.col("offset") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("offset") > end + most_gap).cast("int"), F.lit(1))
    runs = distinct.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    length = F.max(F.col("offset") + F.col("size")) - F.min("offset")
    about = [F.first(c).alias(c) for c in _PACKED]
    inside = F.collect_list(F.struct("tile", "plane", "offset", "size", "asks"))
    return runs.groupBy("path", "level", "__near", "part", "__run").agg(F.min("offset").alias("begin"), length.alias("length"), *about, inside.alias("tiles")).drop("__near", "__run")


_TILE = "path string, level int, tile int, plane int, x0 long, y0 long, bw long, bh long, unit long, data binary"


def _pixels(run: dict, content: bytes) -> Iterator[tuple[dict, int, int, np.ndarray]]:
    """Each tile of a run with its first column and row and its pixels, cut at the raster's border."""
    across, w, h, width, height = (run[c] for c in ("across", "tile_w", "tile_h", "width", "height"))
    each, kind, packing, predictor, begin = 1 if run["apart"] else run["samples"], run["kind"], run["packing"], run["predictor"], run["begin"]
    for t in run["tiles"]:
        at = t["offset"] - begin
        pixels = tiff.unpacked(content[at : at + t["size"]], w, h, each, kind, packing, predictor)
        r, c = divmod(t["tile"] % (across * run["down"]), across)
        yield t, c * w, r * h, pixels[: height - r * h, : width - c * w]


def _whole_tiles(run: dict, content: bytes) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
    out = [(run["path"], run["level"], t["tile"], t["plane"], c, r, x.shape[1], x.shape[0], x.shape[2] * x.itemsize, np.ascontiguousarray(x).tobytes()) for t, c, r, x in _pixels(run, content)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _TILE.split(", ")])


def _crops(rows: Iterator[tuple[dict, bytes]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(window_id, plane, row, col, h, data): what each window takes of each tile."""
    kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["window_id", "plane", "row", "col", "h", "data"])

    out, size = [], 0
    for run, content in rows:
        for t, c, r, x in _pixels(run, content):
            for ask in t["asks"]:
                top, left = max(r, ask["y0"]), max(c, ask["x0"])
                part = x[top - r : max(0, ask["y0"] + ask["h0"] - r), left - c : max(0, ask["x0"] + ask["w0"] - c)]
                if part.size:
                    out.append((ask["window_id"], t["plane"], top - ask["y0"], left - ask["x0"], len(part), np.ascontiguousarray(part).tobytes()))
                    size += part.nbytes
                    if size > RUN_BYTES:
                        yield batch(out)
                        out, size = [], 0
    if out:
        yield batch(out)


def cropped(runs: DataFrame, id_type: str, open_: Callable[[str], Ranges] = file_or_http, blocks: DataFrame | None = None, block: int = 1 << 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(window_id, plane, row, col, h, data): reads the runs, unpacks their tiles and cuts out what each window asks for.

    From `blocks` only the bytes of runs travel: the list of wanted bytes goes to the blocks while it has broadcast_rows
    rows at most (counted first), else both meet by a shuffle.
    """
    arrow_id = to_arrow_type(_parse_datatype_string(id_type))
    schema = f"window_id {id_type}, plane int, row long, col long, h long, data binary"
    if blocks is None:

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _crops(((row, open_(row["path"])(row["begin"], row["length"])) for row in b.to_pylist()), arrow_id)

        return runs.mapInArrow(fetch, schema)
    runs = tables.once(runs)
    span = F.expr(f"transform(sequence(begin div {block}, (begin + length - 1) div {block}), k -> k * {block})")
    ask = runs.select("path", "level", "part", F.col("begin").alias("first"), "length", F.explode(span).alias("begin"))
    ask = F.broadcast(ask) if ask.count() <= broadcast_rows else ask
    place = F.greatest(F.col("first") - F.col("begin"), F.lit(0))
    held = F.expr("substring(data, cast(__from + 1 as int), cast(least(first + length - begin, octet_length(data)) - __from as int))")
    parts = blocks.join(ask, ["path", "begin"]).withColumn("__from", place).select("path", "level", "part", "first", "begin", held.alias("bytes"))
    got = parts.groupBy("path", "level", "part", "first").agg(F.array_sort(F.collect_list(F.struct("begin", "bytes"))).alias("b")).withColumnRenamed("first", "begin")
    both = runs.join(got, ["path", "level", "part", "begin"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _crops(((row, b"".join(x["bytes"] for x in row["b"])) for row in b.to_pylist()), arrow_id)

    return both.mapInArrow(cut, schema)


def resampled(source: np.ndarray, x: float, y: float, w: float, h: float, out_w: int, out_h: int) -> np.ndarray:
    """Bilinear samples at the centers of out_w x out_h cells of the window (x, y, w, h) of a height x width x samples array; 0 outside."""
    def axis(at: float, size: float, n: int, most: int) -> tuple[np.ndarray, ...]:
        place = at + (np.arange(n) + 0.5) * size / n - 0.5
        low = np.floor(place).astype(int)
        share = place - low
        weights = np.stack([1 - share, share])
        both = np.stack([low, low + 1])
        weights[(both < 0) | (both >= most)] = 0
        return np.clip(both, 0, most - 1), weights

    (r, wr), (c, wc) = axis(y, h, out_h, source.shape[0]), axis(x, w, out_w, source.shape[1])
    if not wr[1].any() and not wc[1].any():  # pixel by pixel
        out = source[r[0][:, None], c[0][None, :]]
        out[wr[0] == 0] = 0
        out[:, wc[0] == 0] = 0
        return out
    out = np.zeros((out_h, out_w, source.shape[2]))
    for i in range(2):
        for j in range(2):
            out += source[r[i][:, None], c[j][None, :]] * (wr[i][:, None] * wc[j][None, :])[..., None]
    return np.rint(out).astype(source.dtype)


def read_windows(windows: DataFrame, levels: DataFrame, tiles: DataFrame, max_px: int = 2000, most_gap: int = 0, open_: Callable[[str], Ranges] = file_or_http, blocks: DataFrame | None = None, block: int = 1 << 16) -> DataFrame:
    """(window_id, path, level, out_w, out_h, n_tiles, tile_bytes, bands, valid_fraction, kind, data): each window's pixels.

    windows (window_id, path, x, y, w, h) in pixels of the first level; fractions are allowed, and what lies outside the
    raster is 0. Pixels are bilinear samples of the level that `planned` takes. valid_fraction is the share of pixels with
    a fourth sample (alpha) over 0, or where there is none, of those not 0 in all samples. data holds out_h x out_w x bands
    samples of the NumPy type `kind`. Windows over unreadable rasters, or of no size, are left out; window ids are distinct.

    Each tile is read and unpacked once, however many windows touch it.
    """
    plan = planned(windows, levels, max_px)
    plan, near = tables.once(plan), tables.once(touched(plan, tiles))  # small, and used several times
    id_type = windows.schema["window_id"].dataType.simpleString()
    pieces = cropped(byte_runs(asked_tiles(near), most_gap), id_type, open_, blocks, block)
    gathered = pieces.groupBy("window_id").agg(F.collect_list(F.struct("plane", "row", "col", "h", "data")).alias("pieces"))  # as large as the window
    counts = near.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("size").alias("tile_bytes"))
    whole = plan.join(gathered, "window_id", "left").join(counts, "window_id", "left")
    whole = whole.select("window_id", "path", "level", "x", "y", "w", "h", "x0", "y0", "w0", "h0", "width", "height", "out_w", "out_h", "samples", "kind", "apart", "pieces", F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"), F.coalesce("tile_bytes", F.lit(0)).alias("tile_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares, data = [], []
            for p in b.to_pylist():
                dtype = np.dtype(p["kind"]).newbyteorder("=")
                planes = range(p["samples"]) if p["apart"] else (0,)
                unit = dtype.itemsize * (1 if p["apart"] else p["samples"])
                parts = np.zeros((len(planes), p["h0"], p["w0"], unit), np.uint8)
                for x in p["pieces"] or ():
                    part = np.frombuffer(x["data"], np.uint8).reshape(x["h"], -1, unit)
                    parts[x["plane"], x["row"] : x["row"] + x["h"], x["col"] : x["col"] + part.shape[1]] = part
                source = np.concatenate([x.view(dtype) for x in parts], 2)
                # zeros beyond the border count as samples, so edges fade out as outside pixels are 0
                out = resampled(source, p["x"] - p["x0"], p["y"] - p["y0"], p["w"], p["h"], p["out_w"], p["out_h"])
                seen = out[..., 3] > 0 if out.shape[2] >= 4 else out.any(2)
                shares.append(float(seen.mean()))
                data.append(out.tobytes())
            kept = [b.column(c) for c in ("window_id", "path", "level", "out_w", "out_h", "n_tiles", "tile_bytes", "samples")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shares, pa.float64()), pa.array([k[1:] for k in b.column("kind").to_pylist()], pa.string()), pa.array(data, pa.binary())], ["window_id", "path", "level", "out_w", "out_h", "n_tiles", "tile_bytes", "bands", "valid_fraction", "kind", "data"])

    return whole.mapInArrow(run, f"window_id {id_type}, path string, level int, out_w int, out_h int, n_tiles long, tile_bytes long, bands int, valid_fraction double, kind string, data binary")


# --- one raster as a data source ----------------------------------------------------------------------------------


class _Run(InputPartition):
    """Tiles of one level that follow each other in the file."""


class _TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.box = [int(options.get(k, -1)) for k in ("col", "row", "width", "height")]
        self.most_gap = int(options.get("most_gap", 0))

    def partitions(self) -> list[InputPartition]:
        levels, _ = tiff.index(file_or_http(self.path))
        x = levels[self.level]
        col, row, w, h = self.box if self.box[2] > 0 else (0, 0, x.width, x.height)
        cols = range(max(0, col // x.tile_w), min(x.across - 1, (col + w - 1) // x.tile_w) + 1)
        rows = range(max(0, row // x.tile_h), min(x.down - 1, (row + h - 1) // x.tile_h) + 1)
        planes = range(x.samples if x.apart else 1)
        about = {c: getattr(x, c) for c in _PACKED}
        runs: list[dict] = []
        found = [(int(x.offsets[t]), int(x.sizes[t]), t, p) for p in planes for r in rows for c in cols for t in [p * x.across * x.down + r * x.across + c] if x.sizes[t]]
        for offset, size, t, p in sorted(found):
            last = runs[-1] if runs else None
            if last is None or offset > last["begin"] + last["length"] + self.most_gap or offset + size - last["begin"] > RUN_BYTES:
                last = {"path": self.path, "level": self.level, "begin": offset, "length": 0, "tiles": [], **about}
                runs.append(last)
            last["length"] = offset + size - last["begin"]
            last["tiles"].append({"tile": t, "plane": p, "offset": offset, "size": size})
        return [_Run(r) for r in runs]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # so Spark asks where there are no partitions
            return
        run = partition.value
        batch = _whole_tiles(run, file_or_http(run["path"])(run["begin"], run["length"]))
        first = [run["length"]] + [0] * (batch.num_rows - 1)  # so that a sum over rows gives the bytes read
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())], [*batch.schema.names, "bytes_read"])


class TileSource(DataSource):
    """format("tiled_tiff"): tiles of `level` (default 0) that touch the pixels col, row, width, height (default: all) of one raster.

    A partition is a run of bytes of at most a few megabytes; tiles without bytes give no row. bytes_read sums to what was read.
    """

    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return f"{_TILE}, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _TileReader(dict(self.options))
