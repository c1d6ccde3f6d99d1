"""Tiled rasters, remote windows and mosaics against crops of the whole pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.operators import overlay, tiling
from terralens.operators.image import from_struct, to_struct
from terralens.sources import raster_windows as rw
from terralens.sources import tiff


def bytes_of(data):
    return lambda offset, n: data[offset : offset + n]


@pytest.mark.parametrize("shape", [(70, 50), (16, 16, 3), (33, 129, 4), (1, 1)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("big", [False, True])
def test_tiled_files_read_back(shape, kind, big):
    x = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    for deflate in (False, True):
        for predictor in (1, 2):
            data = tiff.tiled(x, 16, 2, 10, 20, (0.5, 0.25), 3857, deflate, predictor, big)
            assert (tiff.whole(data) == x).all()
            levels, where = tiff.index(bytes_of(data), first=64)
            assert [(v.width, v.height) for v in levels] == [(w, h) for h, w in (shape[:2], (-(-shape[0] // 2), -(-shape[1] // 2)), (-(-(-(-shape[0] // 2)) // 2), -(-(-(-shape[1] // 2)) // 2)))]
            assert where == {"west": 10, "north": 20, "pixel": (0.5, 0.25), "epsg": 3857}
            half = tiff.halved(x if x.ndim == 3 else x[..., None])
            assert (tiff.whole(data, 1).reshape(half.shape) == half).all()


def test_kinds_that_are_not_read_say_so():
    good = tiff.tiled(np.zeros((4, 4), np.uint8), 16)
    for bad in (b"", b"II*\0", good[:60], b"PK" + good[2:], good.replace((256).to_bytes(2, "little") + b"\4\0", (999).to_bytes(2, "little") + b"\4\0")):
        with pytest.raises((ValueError, TypeError)):
            tiff.index(bytes_of(bad))
    with pytest.raises(ValueError):
        tiff.tiled(np.zeros((4, 4), np.float32))


def planes_apart(x, tile):
    """A big-endian striped file with a plane for each sample, made by hand."""
    import struct

    h, w, n = x.shape
    rows = tile
    strips = [x[r : r + rows, :, k].astype(">u2").tobytes() for k in range(n) for r in range(0, h, rows)]
    at = 8
    body, places = b"", []
    for s in strips:
        places.append(at + len(body))
        body += s
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16] * n), (259, 3, [1]), (273, 4, places), (277, 3, [n]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [2])]
    start = at + len(body)
    beyond, entries, extra = start + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        packed = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        value = packed.ljust(4, b"\0")
        if len(packed) > 4:
            value = struct.pack(">I", beyond + len(extra))
            extra += packed
        entries += struct.pack(">HHI", tag, kind, len(values)) + value
    return b"MM\0*" + struct.pack(">I", start) + body + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0" + extra


def expected(levels, window, max_px):
    """The window's pixels from whole levels: zeros around, bilinear at the centers of the output's cells."""
    x, y, w, h = window
    scale = min(1.0, max_px / max(w, h))
    ow, oh = max(1, round(w * scale)), max(1, round(h * scale))
    h0, w0 = levels[0].shape[:2]
    best = max(k for k, v in enumerate(levels) if k == 0 or (w * v.shape[1] >= ow * w0 and h * v.shape[0] >= oh * h0))
    v = levels[best].astype(float)
    v = v if v.ndim == 3 else v[..., None]
    fx, fy = v.shape[1] / w0, v.shape[0] / h0
    out = np.zeros((oh, ow, v.shape[2]))
    at = lambda r, c: v[r, c] if 0 <= r < v.shape[0] and 0 <= c < v.shape[1] else np.zeros(v.shape[2])
    for i in range(oh):
        for j in range(ow):
            py, px = y * fy + (i + 0.5) * h * fy / oh - 0.5, x * fx + (j + 0.5) * w * fx / ow - 0.5
            r, c = int(np.floor(py)), int(np.floor(px))
            a, b = py - r, px - c
            out[i, j] = (1 - a) * (1 - b) * at(r, c) + (1 - a) * b * at(r, c + 1) + a * (1 - b) * at(r + 1, c) + a * b * at(r + 1, c + 1)
    return best, np.rint(out)


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    """Files by name, and the pixels of all their levels."""
    rng, at = np.random.default_rng(3), tmp_path_factory.mktemp("rasters")
    made = {
        "gray": tiff.tiled(rng.integers(0, 256, (150, 210)).astype(np.uint8), 32, 3, 10.0, 50.0, (0.001, 0.001)),
        "alpha": tiff.tiled(rng.integers(0, 65536, (90, 64, 4)).astype(np.uint16), 16, 1, 20.0, 50.0, (0.001, 0.001), predictor=2, big=True),
        "apart": planes_apart(rng.integers(0, 65536, (40, 33, 3)).astype(np.uint16), 7),
    }
    files, pixels = {}, {}
    for name, data in made.items():
        (at / f"{name}.tif").write_bytes(data)
        files[name] = str(at / f"{name}.tif")
        pixels[files[name]] = [tiff.whole(data, k) for k in range(len(tiff.index(bytes_of(data))[0]))]
    return files, pixels


@pytest.mark.parametrize("store", ["files", "blocks"])
def test_windows_equal_crops_of_the_whole(spark, rasters, store):
    files, pixels = rasters
    rng = np.random.default_rng(4)
    windows = [(100 + k, path, float(a), float(b), float(c), float(d)) for k, (path, a, b, c, d) in enumerate((list(files.values())[i % 3], *rng.uniform(-40, 60, 2).round(int(i % 2)), *rng.uniform(1, 70, 2).round(int(i % 2))) for i in range(24))]
    windows += [(1, files["gray"], 0, 0, 210, 150), (2, files["gray"], 1000, 1000, 5, 5), (3, files["alpha"], 0.0, 0.0, 0.0, 4.0), (4, "nowhere.tif", 0, 0, 3, 3), (5, files["gray"], -50, -50, 400, 400)]
    df = spark.createDataFrame([(i, p, *map(float, r)) for i, p, *r in windows], "window_id long, path string, x double, y double, w double, h double")
    paths = spark.createDataFrame([(p,) for p in [*files.values(), "nowhere.tif"]], "path string")
    more = {}
    if store == "blocks":
        content = spark.createDataFrame([(p, open(p, "rb").read()) for p in files.values()], "path string, content binary")
        more = {"blocks": rw.byte_blocks(content, 512), "block": 512}
    levels, tiles = rw.tile_index(paths, **more, **({"head_blocks": 2000} if more else {}))
    assert levels.filter("err is not null").count() == 1
    got = {r["window_id"]: r for r in rw.read_windows(df, levels, tiles, max_px=48, **more).collect()}
    assert set(got) == {w[0] for w in windows} - {3, 4}
    for i, path, *window in windows:
        if i in got:
            r = got[i]
            level, want = expected(pixels[path], window, 48)
            have = np.frombuffer(r["data"], r["kind"]).reshape(r["out_h"], r["out_w"], r["bands"])
            assert r["level"] == level and have.shape == want.shape
            assert np.abs(have - want).max() <= 1  # halves may round either way
            seen = have[..., 3] > 0 if have.shape[2] == 4 else have.any(2)
            assert r["valid_fraction"] == seen.mean()
    assert got[2]["n_tiles"] == 0 and got[2]["valid_fraction"] == 0
    assert rw.read_windows(df.filter("window_id < 0"), levels, tiles, **more).collect() == []


def test_only_touched_tiles_are_read(spark, rasters, tmp_path):
    files, pixels = rasters
    asked = tmp_path / "asked"
    asked.mkdir()

    def counted(path):
        get = rw.file_or_http(path)

        def ask(offset, n):
            data = get(offset, n)
            (asked / f"{offset}-{n}").write_text(str(len(data)))
            return data

        return ask

    paths = spark.createDataFrame([(files["gray"],)], "path string")
    levels, tiles = (t.cache() for t in rw.tile_index(paths))
    levels.count(), tiles.count()
    one = spark.createDataFrame([(1, files["gray"], 70.0, 70.0, 20.0, 10.0), (2, files["gray"], 75.0, 72.0, 10.0, 10.0)], "window_id long, path string, x double, y double, w double, h double")
    got = rw.read_windows(one, levels, tiles, open_=counted).collect()
    need = {r["tile"]: r["size"] for r in tiles.filter("level = 0").collect() if r["tile"] % 7 == 2 and r["tile"] // 7 == 2}
    assert len(need) == 1 and sum(int(p.read_text()) for p in asked.iterdir()) == sum(need.values())
    assert {r["window_id"]: (r["n_tiles"], r["tile_bytes"]) for r in got} == {1: (1, sum(need.values())), 2: (1, sum(need.values()))}


def test_tiles_as_a_data_source(spark, rasters):
    files, pixels = rasters
    spark.dataSource.register(rw.TileSource)
    read = lambda name, **o: spark.read.format("tiled_tiff").options(path=files[name], **o).load()
    for name, level in (("gray", 0), ("gray", 2), ("alpha", 1), ("apart", 0)):
        want = pixels[files[name]][level]
        want = want if want.ndim == 3 else want[..., None]
        out = np.zeros_like(want)
        for t in read(name, level=level).collect():
            part = np.frombuffer(t["data"], want.dtype).reshape(t["bh"], t["bw"], -1)
            out[t["y0"] : t["y0"] + t["bh"], t["x0"] : t["x0"] + t["bw"], t["plane"] : t["plane"] + part.shape[2]] = part
        assert (out == want).all()
    box = read("gray", col=70, row=70, width=20, height=10)
    sizes = tiff.index(rw.file_or_http(files["gray"]))[0][0].sizes
    assert [r["tile"] for r in box.collect()] == [16] and box.agg(F.sum("bytes_read")).first()[0] == sizes[16]
    assert read("gray", col=900, row=0, width=5, height=5).count() == 0


def test_meter_windows(spark, rasters):
    files, _ = rasters
    levels, _ = rw.tile_index(spark.createDataFrame([(files["gray"],), (files["apart"],)], "path string"))
    p = spark.createDataFrame([(1, files["gray"], 10.1, 49.95)], "window_id long, path string, lon double, lat double")
    r = rw.meter_windows(p, levels, 1200.0).first()
    half = 600 / 111320
    assert abs(r["h"] - 2 * half / 0.001) < 1e-6 and abs(r["w"] - r["h"] / np.cos(np.radians(49.95))) < 1e-6
    assert abs(r["x"] + r["w"] / 2 - 100) < 1e-6 and abs(r["y"] + r["h"] / 2 - 50) < 1e-6


@pytest.mark.parametrize("channels", [1, 3])
def test_patches_across_seams_equal_those_of_the_whole(spark, channels):
    rng = np.random.default_rng(8)
    shapes = [(90, 130), (40, 40), (33, 7), (64, 200)]
    images = [(rng.integers(0, 4, (*s, channels)) * rng.integers(0, 60, (*s, channels))).astype(np.uint8) for s in shapes]
    images = [x[..., 0] if channels == 1 else x for x in images]
    rasters = spark.createDataFrame([(i, to_struct(x)) for i, x in enumerate(images)], "raster_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    shape = spark.createDataFrame([(i, s[1], s[0]) for i, s in enumerate(shapes)], "raster_id long, width long, height long")
    grid = tiling.tile_grid(shape, 32, 0.25).withColumn("name", F.concat_ws("-", "raster_id", "col_off"))
    odd = spark.createDataFrame([(0, -10, -5, 30, 30, "a"), (0, 120, 80, 30, 30, "b"), (0, 500, 500, 8, 8, "c"), (9, 0, 0, 4, 4, "d"), (1, 3, 3, 1, 37, None)], "raster_id long, col_off long, row_off long, w long, h long, name string")
    windows = grid.select("raster_id", "col_off", "row_off", "w", "h", "name").unionByName(odd)
    blocks = overlay.split_blocks(rasters, 40).filter("not (raster_id = 3 and col_off = 80)")  # one is missing
    lost = images[3].copy()
    lost[:, 80:120] = 0
    lost[40:, 80:120] = 0
    whole = {0: images[0], 1: images[1], 2: images[2], 3: lost}
    rows = overlay.mosaic_patches(blocks, windows, 40, "name").collect()
    assert len(rows) == windows.count()
    for r in rows:
        x = whole.get(r["raster_id"])
        wide = np.zeros((700, 700) + ((channels,) if channels > 1 else ()), np.uint8)
        if x is not None:
            wide[100 : 100 + x.shape[0], 100 : 100 + x.shape[1]] = x
        want = wide[100 + r["row_off"] : 100 + r["row_off"] + r["h"], 100 + r["col_off"] : 100 + r["col_off"] + r["w"]]
        have = from_struct(r["image"])
        assert r["err"] is None and have.shape[:2] == want.shape[:2]
        assert (have == want).all() if have.ndim == want.ndim else not have.any() and not want.any()
        assert abs(r["valid_fraction"] - (want if want.ndim == 2 else want.any(2)).astype(bool).mean()) < 1e-12


def test_grid_patches_are_those_of_the_join(spark):
    rng = np.random.default_rng(12)
    shapes = [(90, 131), (40, 40), (33, 7), (31, 300), (64, 200)]
    rasters = spark.createDataFrame([(i, to_struct(rng.integers(0, 256, s).astype(np.uint8))) for i, s in enumerate(shapes)], "raster_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    shape = spark.createDataFrame([(i, s[1], s[0]) for i, s in enumerate(shapes)], "raster_id long, width long, height long")
    for size, overlap, px in ((32, 0.25, 40), (16, 0.0, 7), (6, 0.5, 64)):
        blocks = overlay.split_blocks(rasters, px)
        rows = lambda df: {(r["raster_id"], r["col_off"], r["row_off"]): (r["w"], r["h"], bytes(r["image"]["data"]), r["valid_fraction"]) for r in df.collect()}
        windows = tiling.tile_grid(shape, size, overlap)
        got = rows(overlay.grid_patches(blocks, size, overlap))
        assert got == rows(overlay.mosaic_patches(blocks, windows.select("raster_id", "col_off", "row_off", "w", "h"), px)) and len(got) == windows.count()
    with pytest.raises(ValueError):
        overlay.grid_patches(blocks, 4, 1.0)


def test_blocks_of_different_channels_are_an_error_of_their_windows(spark):
    image = lambda *s: to_struct(np.ones(s, np.uint8))
    blocks = spark.createDataFrame([(1, 0, 0, image(8, 8)), (1, 8, 0, image(8, 8, 3))], "raster_id long, col_off long, row_off long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    windows = spark.createDataFrame([(1, 4, 0, 8, 8), (1, 0, 0, 4, 4)], "raster_id long, col_off long, row_off long, w long, h long")
    got = {r["col_off"]: r for r in overlay.mosaic_patches(blocks, windows, 8).collect()}
    assert got[4]["image"] is None and "channels" in got[4]["err"] and got[0]["err"] is None
