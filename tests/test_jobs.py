"""Whole jobs, and what they lean on: wide whitening, reports, rasters with coordinates, links and repeated downloads."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.functions import fields
from terralens.operators import catalog, evaluate, image, matching
from terralens.operators.encoders import VladEncoder, Whitening
from terralens.operators.knn import VectorIndex
from terralens.plans import pipelines
from terralens.settings import Settings
from terralens.sources import catalog_pages, files, tables

RNG = np.random.default_rng(11)


def textured(seed, h=96, w=96):
    r = np.random.default_rng(seed)
    return np.clip(image.gaussian(r.integers(0, 256, (h, w)).astype(float), 1.5) * 3 - 250, 0, 255).astype(np.uint8)


def pictures(spark, n, key="patch_id"):
    return spark.createDataFrame([(i, image.to_struct(textured(i))) for i in range(n)], f"{key} long, image {image.IMAGE}")


def test_wide_whitening_equals_exact_axes(spark):
    base = np.linalg.qr(RNG.normal(size=(1500, 1500)))[0][:12]
    x = (RNG.normal(size=(120, 12)) * np.linspace(9, 1, 12)) @ base + RNG.normal(size=(120, 1500)) * 0.01 + 3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3)
    wide, exact = Whitening.fit(df, 8), Whitening.fit(df, 8, exact_up_to=2000)
    assert wide.axes.shape == (8, 1500) and np.allclose(wide.variance, exact.variance, rtol=1e-6)
    assert np.allclose(np.abs((wide.axes * exact.axes).sum(1)), 1, atol=1e-6) and np.allclose(wide.mean, x.mean(0))


def test_vlad_learns_at_its_default_width(spark):
    rng = np.random.default_rng(0)
    bags = spark.createDataFrame([(i, (rng.random((80, 128)) * 255).tolist()) for i in range(24)], "patch_id long, descs array<array<float>>")
    model = VladEncoder(restarts=1).fit(bags)
    assert model.whitening.axes.shape[1] == 64 * 128 and len(model.whitening.axes) <= 24
    v = np.array([r["vec"] for r in model.transform(bags).collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)


def test_flat_index_is_saved_in_several_files(spark, tmp_path, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("patch_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.rand(3).cast("float")).alias("vec"))
    index = VectorIndex(flat=True).train(rows).add(rows)
    index.save(str(tmp_path / "i"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    assert again.stats() == index.stats() and again.lists.count() == 500


def test_descriptor_lists_become_matrices(spark):
    import pyarrow as pa

    col = pa.array([[[1.0, 2.0], [3.0, 4.0]], None, [], [[1.0], [2.0, 3.0]]], pa.list_(pa.list_(pa.float32())))
    assert matching.nested(col, 0).tolist() == [[1, 2], [3, 4]] and matching.nested(col, 1).shape == matching.nested(col, 2).shape == (0, 0)
    assert matching.nested(col.slice(0, 1), 0).shape == (2, 2)
    with pytest.raises(ValueError):
        matching.nested(col, 3)
    rows = spark.createDataFrame([(1, 1, [[1.0, 2.0]] * 5, [[1.0], [2.0, 1.0]], [[1.0, 2.0]] * 5, [[1.0, 2.0]] * 5)], "query_id long, patch_id long, q_xy array<array<float>>, q_descs array<array<float>>, c_xy array<array<float>>, c_descs array<array<float>>")
    assert matching.Verifier().verify(rows).first()["err"]


def test_report_marks_the_truth(spark):
    rows = spark.createDataFrame([(1, i, float(9 - i)) for i in range(9)], "query_id long, patch_id long, score double")
    got = matching.top_report(rows, spark.createDataFrame([(1, 2), (1, 8)], "query_id long, patch_id long")).orderBy("rank").collect()
    assert [(r["rank"], r["patch_id"], r["is_truth"]) for r in got] == [(k + 1, k, k == 2) for k in range(5)]


def test_random_rows_and_expected_ids(spark):
    df = spark.range(100).withColumnRenamed("id", "patch_id")
    a, b = ([r[0] for r in catalog.random_rows(df, "patch_id", 3, s).collect()] for s in (1, 1))
    assert a == b and len(set(a)) == 3 and catalog.random_rows(df.limit(0), "patch_id").count() == 0
    got = spark.range(3).select(fields.is_expected(F.col("id"), F.lit("2, 0")).alias("e"), fields.is_expected(F.col("id"), F.lit(None).cast("string")).alias("n")).collect()
    assert [r["e"] for r in got] == [True, False, True] and all(r["n"] is None for r in got)


def test_links_expire_and_are_signed(spark):
    url = fields.expiring_url("http://x/b", F.lit("a/c.png"), F.lit(100).cast("long"), "key")
    r = spark.range(1).select(
        url.alias("u"), fields.link_valid(url, "http://x/b", F.lit(99), "key").alias("ok"), fields.link_valid(url, "http://x/b", F.lit(100), "key").alias("late"),
        fields.link_valid(F.regexp_replace(url, "c.png", "d.png"), "http://x/b", F.lit(1), "key").alias("other"), fields.expiring_url("http://x", F.lit(""), F.lit(1), "key").alias("none"),
    ).first()
    assert r["u"].startswith("http://x/b/a/c.png?expires=100&signature=") and (r["ok"], r["late"], r["other"], r["none"]) == (True, False, False, None)


def test_geotiff_round_trip():
    for shape, epsg in (((5, 7), 4326), ((6, 4, 3), 32637)):
        a = RNG.integers(0, 256, shape).astype(np.uint8)
        pixels, where = image.geotiff_decode(image.geotiff_encode(a, 36.5, 50.25, (0.001, 0.002), epsg))
        assert np.array_equal(pixels, a) and where == {"west": 36.5, "north": 50.25, "pixel": (0.001, 0.002), "epsg": epsg}
    for bad in (b"text", b"II*\0" + b"\x08\0\0\0" + b"\0" * 8):
        with pytest.raises(ValueError):
            image.geotiff_decode(bad)
    assert image.valid_fraction(np.array([[0, 1], [2, 0]], np.uint8)) == 0.5


def test_stored_downloads_are_not_repeated(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "path string")
    got = files.fetched(todo, lambda r: r["path"].encode(), 2, stored=spark.createDataFrame([("a",)], "path string")).collect()
    assert [(r["path"], bytes(r["content"])) for r in got] == [("b", b"b")]


def test_box_and_days_reach_the_catalogs_client():
    q = catalog_pages.CatalogQuery({("start", "min"): datetime(2024, 5, 1), ("start", "below"): datetime(2024, 6, 1), ("lon_max", "min"): 3.0})
    assert q.admits({"start": "2024-05-31T23:59:59Z", "lon_max": 3.0}) and not q.admits({"start": "2024-06-01T00:00:00Z", "lon_max": 3.0})
    assert not q.admits({"start": "2024-05-02T00:00:00Z", "lon_max": 2.9}) and not q.admits({"start": None, "lon_max": 9.0})
    assert q.odata() == "lon_max ge 3.0 and start lt 2024-06-01T00:00:00.000Z and start ge 2024-05-01T00:00:00.000Z"


def test_self_check_sweep_and_photometric_localization(spark):
    images = pictures(spark, 4)
    settings = Settings(coarse_method="vlad", vlad_centroids=4, vlad_pca=False, vlad_restarts=1, sift_contrast=0.01, photometric=True, mutual=True, exhaustive=True)
    features = tables.once(pipelines.described(images, settings))
    assert features.filter("err is not null").count() == 0 and features.filter("size(descs) = 0").count() == 0
    places = images.select("patch_id", F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")).alias("center"), F.struct(*(F.lit(0.0).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))).alias("bbox"), F.lit("p").alias("path"))
    engine = pipelines.Engine.build(places, features, settings)
    assert engine.encoder.n_centroids == 4 and engine.encoder.whitening is None
    found = engine.localize(features.withColumnRenamed("patch_id", "query_id"), top_n=1).collect()
    assert [(r["query_id"], r["patch_id"]) for r in sorted(found, key=lambda r: r["query_id"])] == [(i, i) for i in range(4)]
    assert all(r["photometric_score"] > 0.99 for r in found)  # equal images correlate
    checked = pipelines.self_check(spark, images, engine, crop=0.9, degrees=5.0).collect()
    assert sum(r["rank"] == 1 for r in checked) >= 3
    truth = spark.createDataFrame([(i, i) for i in range(4)], "query_id long, patch_id long")
    swept = pipelines.preprocessing_sweep(images.withColumnRenamed("patch_id", "query_id"), images, truth, [{}, {"normalize": True, "clahe": True, "scale": 0.9}]).collect()
    assert {(r["config"], r["rank"]) for r in swept} == {(0, 1), (1, 1)}


def test_recall_report_and_latency(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(m, i, rng.random(4).tolist()) for m in ("a", "b") for i in range(30)], "method string, patch_id long, vec array<float>")
    q = v.withColumnRenamed("patch_id", "query_id").filter("query_id < 5")
    truth = spark.createDataFrame([(i, i) for i in range(5)], "query_id long, patch_id long")
    got = {(r["method"], r["k"]): r["recall"] for r in pipelines.recall_report(q, v, truth, [1, 3]).collect()}
    assert got == {(m, k): 1.0 for m in ("a", "b") for k in (1, 3)}
    assert pipelines.search_latency(lambda x: x, q, repeats=2) > 0


def test_png_tables_and_backbone_input(spark, tmp_path):
    encoded = image.encode_png(pictures(spark, 3)).select("patch_id", F.col("png").alias("content"), F.concat(F.lit("x/f"), F.col("patch_id"), F.lit("/"), F.col("patch_id"), F.lit(".png")).alias("path"))
    back = image.decode_png(encoded.unionByName(spark.createDataFrame([(9, bytearray(b"no"), "x/f/9.png")], encoded.schema)))
    got = {r["patch_id"]: r for r in back.collect()}
    assert got[9]["image"] is None and got[9]["err"] and all(np.array_equal(image.from_struct(got[i]["image"].asDict()), textured(i)) for i in range(3))
    tables.write_blobs(encoded.select("path", "content"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
    x = image.backbone_input(np.full((30, 40, 3), 255, np.uint8), 16)
    assert x.shape == (3, 16, 16) and np.allclose(x[0], (1 - 0.485) / 0.229, atol=1e-4)


@pytest.mark.parametrize("method", ["vlad", "bovw", "dino"])
def test_a_stored_engine_answers_in_another_session(spark, tmp_path, method):
    rng = np.random.default_rng(6)
    places = spark.createDataFrame([(i, (30.0 + i, 50.0), (29.5, 49.5, 30.5, 50.5), f"p/{i}.png") for i in range(12)], "patch_id long, center struct<lon:double,lat:double>, bbox struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>, path string")
    bag = lambda i: (rng.random((40, 2)) * 200, np.random.default_rng(i).random((40, 16)))
    rows = [(i, *(x.tolist() for x in bag(i))) for i in range(12)]
    features = spark.createDataFrame(rows, "patch_id long, xy array<array<float>>, descs array<array<float>>")
    settings = Settings(coarse_method=method, vlad_centroids=4, vlad_restarts=1, vlad_pca_dim=8, bovw_words=16, bovw_restarts=1, n_lists=2, n_probe=2, coarse_top_n=5, token_top_k=5)
    tokens = features.select("patch_id", "descs")
    engine = pipelines.Engine.build(places, features, settings, tokens=tokens)
    engine.save(str(tmp_path / "e"))
    queries = features.withColumnRenamed("patch_id", "query_id")
    asked = lambda e: sorted((r["query_id"], r["rank"], r["patch_id"], r["score"]) for r in e.localize(queries, query_tokens=queries.select("query_id", "descs")).collect())
    again = pipelines.Engine.load(spark.newSession(), str(tmp_path / "e"))
    assert again.settings == settings and again.method == method
    first = asked(engine)
    assert first and asked(again) == first and all(q == p for q, rank, p, _ in first if rank == 1)


def test_regions_are_cut_across_exported_blocks(spark):
    from terralens.sources import tiff

    regions = spark.createDataFrame([(1, 10.0, 50.0, 10.001, 50.0007), (2, -20.0, 0.0, -19.9995, 0.0004)], "region_id long, lon_min double, lat_min double, lon_max double, lat_max double")
    world = lambda x, y: ((np.floor(x) * 7 + np.floor(y) * 13) % 251 + 1).astype(np.uint8)

    def render(row):
        if row["region_id"] == 2 and row["col_off"] == 0 and row["row_off"] == 0:
            raise OSError("no such block")
        w, h = row["w"], row["h"]
        x = row["xmin"] + (np.arange(w) + 0.5) * (row["xmax"] - row["xmin"]) / w
        y = row["ymax"] - (np.arange(h) + 0.5) * (row["ymax"] - row["ymin"]) / h
        gray = world(x[None], y[:, None])
        return tiff.tiled(np.stack([gray, gray // 2, gray // 3 + 1], 2), 16)

    settings = Settings(gsd_m=1.0, patch_size=32, overlap=0.25, min_coverage=0.5)
    patches, failed = pipelines.region_patches(regions, render, settings, block_px=40, workers=3)
    rows = {(r["region_id"], r["col_off"], r["row_off"]): r for r in patches.collect()}
    bad = failed.collect()
    assert [(r["region_id"], r["col_off"], r["row_off"]) for r in bad] == [(2, 0, 0)] and "no such block" in bad[0]["err"]
    radius = 6378137.0
    for region, lon0, lat0, lon1, lat1 in ((1, 10.0, 50.0, 10.001, 50.0007), (2, -20.0, 0.0, -19.9995, 0.0004)):
        mx = lambda v: radius * np.radians(v)
        my = lambda v: radius * np.log(np.tan(np.pi / 4 + np.radians(v) / 2))
        w, h = round(mx(lon1) - mx(lon0)), round(my(lat1) - my(lat0))
        x = mx(lon0) + (np.arange(w) + 0.5) * (mx(lon1) - mx(lon0)) / w
        y = my(lat1) - (np.arange(h) + 0.5) * (my(lat1) - my(lat0)) / h
        whole = world(x[None], y[:, None])
        if region == 2:
            whole[:40, :40] = 0
        want = {(region, c, r) for r in range(0, h - 31, 24) for c in range(0, w - 31, 24) if (whole[r : r + 32, c : c + 32] > 0).mean() >= 0.5}
        assert want and want == {k for k in rows if k[0] == region}
        for key in want:
            r, cut = rows[key], whole[key[2] : key[2] + 32, key[1] : key[1] + 32]
            have = image.from_struct(r["image"])
            off = (have[..., 0].astype(int) != cut).mean()
            assert off < 0.1  # pixels that fall on a whole meter may round to either side
            assert abs(r["lon_min"] - (lon0 + key[1] * (lon1 - lon0) / w)) < 1e-9 and abs(r["valid_fraction"] - (cut > 0).mean()) < 1e-9
