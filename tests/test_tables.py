"""Catalog changes, tiling, geography, sources, jobs and streams on small tables."""

import io
import json
import math
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens import schemas
from terralens.functions import fields, geo
from terralens.operators import catalog, evaluate, image, tiling
from terralens.plans import numbering, pipelines
from terralens.settings import Settings
from terralens.sources import catalog_pages, files, tables
from terralens.streaming import ingest as stream


def test_merge_keeps_what_updates_leave_null(spark):
    tasks = spark.createDataFrame([("a", "pending", None, 1), ("b", "pending", "x", 1)], "id string, status string, error string, updated_at int")
    updates = spark.createDataFrame([("a", "running", None, 2), ("a", None, "boom", 3), ("z", "lost", None, 3)], "id string, status string, error string, updated_at int")
    got = {r["id"]: (r["status"], r["error"], r["updated_at"]) for r in catalog.merge_status(tasks, updates).collect()}
    assert got == {"a": ("running", "boom", 3), "b": ("pending", "x", 1)}


def test_repeated_loads_add_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "product_id string, v int"
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], schema)
    assert tables.append_new(rows, path, "product_id", schema) == 2
    assert tables.append_new(rows, path, "product_id", schema) == 0
    left = catalog.without(tables.read(spark, path, schema), "product_id", "p")
    tables.replace(left, path)
    assert [r["product_id"] for r in tables.read(spark, path, schema).collect()] == ["q"]


def test_upload_codes_and_health(spark):
    rows = spark.createDataFrame([("image/png", bytearray(b"x")), ("text/plain", bytearray(b"x")), (None, bytearray(b"x")), ("image/png", None), ("image/png", bytearray(3 * 1024 * 1024))], "content_type string, data binary")
    assert [r["code"] for r in catalog.uploads(rows, most_mb=2).collect()] == [200, 415, 415, 422, 413]
    assert catalog.health(spark.createDataFrame([("a", "ok"), ("b", "error: x")], "name string, status string")).first()["status"] == "degraded"


def test_patch_faults(spark):
    box = {"lon_min": 1.0, "lat_min": 1.0, "lon_max": 2.0, "lat_max": 2.0}
    row = lambda i, **x: {"patch_id": i, "source_tile_id": "t", "center": {"lon": 1.5, "lat": 1.5}, "bbox": box, "path": "p", "patch_size": 256, "gsd_m": 10.0, "created_at": None} | x
    rows = [row(1), row(2, gsd_m=0.0), row(3, bbox=box | {"lon_max": 0.5}), row(4, patch_size=0, source_tile_id=None)]
    got = sorted((r["patch_id"], r["fault"]) for r in schemas.patch_faults(spark.createDataFrame(rows, schemas.PATCHES)).collect())
    assert got == [(2, "gsd_m"), (3, "bbox"), (4, "patch_size"), (4, "source_tile_id")]


def test_field_functions(spark):
    r = spark.range(1).select(
        fields.id_list(F.lit(" 3,1, x,3,")).alias("ids"), fields.content_range_total(F.lit("bytes 0-9/1234")).alias("n"), fields.is_uuid(F.lit("0" * 8 + "-0000-0000-0000-" + "0" * 12)).alias("u"),
        fields.is_uuid(fields.stable_id(F.lit("a"), F.lit("b"))).alias("s"), fields.iso_day(F.lit("2024-05-01 10:00:00").cast("timestamp")).alias("d"), fields.url_of("http://x/", F.lit("a/b")).alias("url"),
    ).first()
    assert (r["ids"], r["n"], r["u"], r["s"], r["d"], r["url"]) == ([1, 3], 1234, True, True, "2024-05-01", "http://x/a/b")


def test_tile_grid_edges(spark):
    r = spark.createDataFrame([(1, 256, 256), (2, 255, 999), (3, 448, 256)], "id int, width int, height int")
    got = sorted((x["id"], x["col_off"], x["row_off"]) for x in tiling.tile_grid(r, 256, 0.25).collect())
    assert got == [(1, 0, 0), (3, 0, 0), (3, 192, 0)]
    assert tiling.tile_grid(r, 256, 1.0).count() == 0


def test_blocks_cover_the_region(spark):
    r = spark.createDataFrame([(10.0, 50.0, 10.03, 50.02)], "lon_min double, lat_min double, lon_max double, lat_max double")
    b = tiling.export_blocks(r, 1.0, 1024).collect()
    assert sum(x["w"] * x["h"] for x in b) == b[0]["width"] * b[0]["height"]
    assert max(x["w"] for x in b) == 1024


def test_box_join_equals_brute_force(spark):
    r = np.random.default_rng(4)
    def make(n):
        out = []
        for i in range(n):
            x, y = r.uniform(-10, 10, 2)
            out.append((i, float(x), float(y), float(x + r.uniform(0, 3)), float(y + r.uniform(0, 3))))
        return out
    a, b = make(60), make(70)
    names = ["id", "lon_min", "lat_min", "lon_max", "lat_max"]
    got = sorted((x["id"], x["r_id"]) for x in tiling.box_join(spark.createDataFrame(a, names), spark.createDataFrame(b, names)).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if not (p[3] < q[1] or p[1] > q[3] or p[4] < q[2] or p[2] > q[4]))


def test_utm_inverse(spark):
    # the central meridian of zone 33 at the equator, and a point of known coordinates
    r = spark.range(1).select(geo.utm_to_lonlat(F.lit(500000.0), F.lit(0.0), F.lit(33), F.lit(False)).alias("a"), geo.utm_to_lonlat(F.lit(448251.795), F.lit(5411932.678), F.lit(31), F.lit(False)).alias("b")).first()
    assert abs(r["a"]["lon"] - 15) < 1e-9 and abs(r["a"]["lat"]) < 1e-9
    assert abs(r["b"]["lon"] - 2.2945) < 1e-4 and abs(r["b"]["lat"] - 48.8582) < 1e-4


def haversine(a, b):
    (lon0, lat0), (lon1, lat1) = np.radians(a), np.radians(b)
    h = np.sin((lat1 - lat0) / 2) ** 2 + np.cos(lat0) * np.cos(lat1) * np.sin((lon1 - lon0) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(min(1.0, h)))


def test_nearest_point_equals_all_pairs(spark):
    r = np.random.default_rng(6)
    around = lambda lon, lat, n, s: np.stack([(r.normal(lon, s, n) + 180) % 360 - 180, np.clip(r.normal(lat, s, n), -90, 90)], 1)
    sets = {
        "even": (np.stack([r.uniform(-180, 180, 300), r.uniform(-90, 90, 300)], 1), np.stack([r.uniform(-180, 180, 200), r.uniform(-90, 90, 200)], 1)),
        "clusters": (np.concatenate([around(30, 50, 900, 0.2), around(-70, -20, 50, 3)]), np.concatenate([around(30, 50, 80, 0.3), around(100, 0, 40, 60)])),
        "date line and poles": (np.concatenate([around(180, 10, 60, 2), around(0, 90, 60, 1), around(0, -90, 5, 1)]), np.concatenate([around(-179.5, 10, 60, 3), around(90, 89.5, 40, 1), around(10, -89, 10, 2)])),
        "one place": (np.array([[5.0, 5.0]]), around(0, 0, 30, 50)),
        "one spot": (np.array([[5.0, 5.0]] * 200 + [[6.0, 5.0]]), around(5, 5, 50, 2)),
        "ties": (np.array([[x, y] for x in range(-5, 6) for y in range(-5, 6)], float), np.array([[x + 0.5, 0.0] for x in range(-5, 5)])),
    }
    for name, (places, points) in sets.items():
        p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "p long, lon double, lat double")
        q = spark.createDataFrame([(1000 - i, float(a), float(b)) for i, (a, b) in enumerate(places)], "q long, lon double, lat double")
        want = [(i, *min((round(haversine(x, y), 9), 1000 - j) for j, y in enumerate(places))) for i, x in enumerate(points)]
        for leaf in (2, 32):
            got = sorted((x["p"], x["dist_km"], x["q"]) for x in evaluate.nearest_point(p, q, "p", "q", per_leaf=leaf).collect())
            assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 3e-9 for g, w in zip(got, want, strict=True)), name
            assert all(g[2] == w[2] or abs(haversine(points[g[0]], places[1000 - g[2]]) - w[1]) < 3e-9 for g, w in zip(got, want, strict=True)), name
        few = sorted((x["p"], x["dist_km"]) for x in evaluate.nearest_point(p, q, "p", "q", per_leaf=1, most_leaves=16, sample=len(places) // 3).collect())
        assert all(a[0] == w[0] and abs(a[1] - w[1]) < 3e-9 for a, w in zip(few, want, strict=True)), name


def test_few_pairs_of_a_point_lie_within_its_bound():
    r = np.random.default_rng(8)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(r.normal(size=(n, 3)))
    places, points = unit(2048), unit(1000)
    tree = evaluate.SphereTree.of(places, 64)
    rows, leaf, bound = tree.reach(points)
    held = tree.leaf(places)
    pairs = sum(int((((places[held == k] - points[i]) ** 2).sum(1) <= bound[i]).sum()) for i, k in zip(rows, leaf, strict=True))
    assert len(points) <= pairs < 3 * len(points)


def test_points_are_dealt_to_tasks_by_number(spark):
    p = spark.range(1000).coalesce(1).selectExpr("id p", "id * 37 % 360 - 180.0 lon", "id * 53 % 170 - 85.0 lat")
    q = spark.range(100).selectExpr("id q", "id * 17 % 360 - 180.0 lon", "id * 29 % 170 - 85.0 lat")
    run = lambda **most: evaluate.nearest_point(p, q, "p", "q", **most)
    dealt = run(most_points=100)
    assert "10), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, run().collect())) and dealt.count() == 1000


def test_nearest_point_without_places_or_coordinates(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0)], "p long, lon double, lat double")
    none = spark.createDataFrame([], "q string, lon double, lat double")
    assert evaluate.nearest_point(p, none, "p", "q").collect() == []
    some = spark.createDataFrame([("b", 1.0, 0.0), ("a", 1.0, 0.0), ("z", None, 0.0)], "q string, lon double, lat double")
    assert [tuple(x)[:2] for x in evaluate.nearest_point(p, some, "p", "q").collect()] == [(1, "a")]
    assert evaluate.nearest_point(p.filter("p > 9"), some, "p", "q").collect() == []


def test_truth_too_far_is_an_error(spark):
    t = spark.createDataFrame([(1, 2.0)], "p long, dist_km double")
    assert evaluate.truth_within(t, 3).count() == 1
    with pytest.raises(Exception, match="2.000 km"):
        evaluate.truth_within(t, 1).collect()


def test_numbering_in_one_order(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("x"))
    assert all(r["row"] == r["x"] for r in numbering.numbered(df, [F.col("x")]).collect())
    assert {r["batch"] for r in numbering.batches(df, [F.col("x")], 256).collect()} == {0, 1, 2, 3}


def test_rank_curve_cuts_exactly(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(1, 31)], "i int, near boolean")
    got = {r["n"]: r["rank"] for r in evaluate.rank_curve(rows, [F.col("i")], F.col("near"), [1, 10, 30, 99]).collect()}
    assert got == {1: 1, 10: 4, 30: 11}


def test_band_files_prefer_the_resolution(spark):
    p = ["x/A.SAFE/G/R10m/T_B02_10m.jp2", "x/A.SAFE/G/R20m/T_B02_20m.jp2", "x/A.SAFE/G/T_B03.jp2", "x/A.SAFE/G/R10m/T_B04_10m.jp2"]
    r = files.band_files(spark.createDataFrame([(x,) for x in p], "path string")).first()
    assert (r["product"], r["B02"], r["B03"], r["B04"]) == ("A", p[0], p[2], p[3])
    with pytest.raises(Exception, match="no B04"):
        files.band_files(spark.createDataFrame([(x,) for x in p[:3]], "path string")).collect()


def test_unzip_and_folder_listing(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("A.SAFE/x.txt", "hi")
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "b.PNG").write_bytes(image.png_encode(np.zeros((2, 2), np.uint8)))
    z = files.blobs(spark, str(tmp_path)).filter(F.col("path").endswith(".zip"))
    assert [(r["name"], bytes(r["content"])) for r in files.unzipped(z).collect()] == [("A.SAFE/x.txt", b"hi")]
    assert [r["name"] for r in files.patch_files(spark, str(tmp_path)).collect()] == ["b.PNG"]
    rows = spark.createDataFrame([(f"file:{tmp_path}/a.zip",), ("gone",)], "path string")
    assert sorted(r["exists"] for r in files.existing(rows, files.blobs(spark, str(tmp_path))).collect()) == [False, True]


def test_fetch_retries_and_reports(spark):
    waits = []
    assert files.retried(lambda: 1 if len(waits) == 2 else 1 / 0, 3, 1.0, waits.append) == 1 and waits == [1.0, 2.0]
    rows = spark.createDataFrame([(1,), (0,)], "k int")
    got = {r["k"]: (r["content"], r["err"]) for r in files.fetched(rows, lambda x: b"%d" % (10 // x["k"]), 2, tries=1).collect()}
    assert bytes(got[1][0]) == b"10" and "zero" in got[0][1]


def test_catalog_search(spark, tmp_path):
    day = lambda i, **x: {"product_id": f"p{i}", "name": f"n{i}", "collection": "S2", "product_type": "L2A", "start": f"2024-05-{i:02d}T10:00:00", "cloud_cover": 5.0 * i, "lon_min": 1.0, "lat_min": 1.0, "lon_max": 2.0, "lat_max": 2.0} | x
    for k, products in enumerate([[day(2), day(1)], [day(3, lon_min=5.0, lon_max=6.0), day(4, cloud_cover=90.0), day(9)]]):
        (tmp_path / f"page-{k}.json").write_text(json.dumps(products))
    found = catalog_pages.search(spark, str(tmp_path), (0, 0, 1, 1), "2024-05-01", "2024-05-09", cloud_max=50)
    assert [r["product_id"] for r in found.collect()] == ["p1", "p2", "p9"]
    assert catalog_pages.CatalogQuery({("cloud_cover", "max"): 20.0, ("collection", "is"): "S2"}).odata() == "cloud_cover le 20.0 and collection eq 'S2'"
    now = [0.0]
    token = catalog_pages.Token(lambda: (f"t{now[0]}", 100), lambda: now[0])
    first = token.get()
    now[0] = 60
    assert token.get() == first
    now[0] = 71
    assert token.get() != first


def test_ingest_is_idempotent(spark, tmp_path):
    pic = np.random.default_rng(1).integers(1, 255, (80, 112, 3)).astype(np.uint8)
    pic[:, 70:] = 0
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    affine = (10.0, 0.0, 1e6, 0.0, -10.0, 5e6)
    rows = spark.createDataFrame([(1, "prod", *affine, image.to_struct(pic))], f"raster_id long, product_id string, a double, b double, c double, d double, e double, f double, image {kind}")
    s = Settings(patch_size=32, overlap=0.0, min_coverage=0.5)
    assert pipelines.ingest(rows, str(tmp_path / "db"), s) == {"patches_created": 4, "skipped": 0}
    assert pipelines.ingest(rows, str(tmp_path / "db"), s)["skipped"] == 1
    assert spark.read.parquet(str(tmp_path / "db/patches")).count() == 4


def test_stream_drops_repeats_and_counts_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"path": p, "ts": t, "event_type": "x", "value": 1.0}) for p, t in [("a", "2024-01-01T00:10:00"), ("a", "2024-01-01T00:12:00"), ("b", "2024-01-01T00:50:00"), ("c", "2024-01-01T01:10:00")]))
    read = spark.readStream.schema("path string, ts timestamp, event_type string, value double").json(str(src))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert sorted(r["path"] for r in run(stream.once(read, "path", "ts"), "once")) == ["a", "b", "c"]
    got = {r["start"]: r["n"] for r in run(stream.activity(read), "activity", "complete")}
    assert got == {datetime(2024, 1, 1, 0): 3, datetime(2024, 1, 1, 1): 1}
    q = stream.into_lists(read, lambda b: b.select("path"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_haversine_against_the_sphere(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("q"), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("h")).first()
    assert abs(r["q"] - 6371 * math.pi / 2) < 1e-6 and abs(r["h"] - 6371000 * math.pi) < 1e-3
