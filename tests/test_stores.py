"""Snapshot tables, the file sink, the catalog stream and stored boxes."""

import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.operators.image import geotiff_decode, to_struct
from terralens.sources import blob_sink, boxes, catalog_pages
from terralens.sources.snapshots import SnapshotTable

SCHEMA = "id long, name string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, "id")


def test_changes_by_key_equal_a_dictionary(spark, table):
    rng, want = np.random.default_rng(5), {}
    assert table.read().collect() == [] and table.snapshot().version == 0 and table.compact() is None
    for step in range(7):
        keys = [int(k) for k in rng.choice(30, 12, replace=False)]
        if step % 3 == 2:
            table.delete(spark.createDataFrame([(k, "x") for k in keys], "id long, other string"))
            for k in keys:
                want.pop(k, None)
        else:
            made = [(k, f"{step}-{k}" if k % 4 else None, step) for k in keys]
            table.put(spark.createDataFrame([(n, i, m, "extra") for i, m, n in made], "n int, id long, name string, more string"))
            want |= {r[0]: r for r in made}
        if step == 4:
            assert table.compact() == table.snapshot().version and table.snapshot().changes == ()
        assert rows_of(table.read()) == sorted(want.values(), key=str)
    for broadcast_rows in (0, 10**6):
        again = SnapshotTable(spark, table.path, SCHEMA, "id", broadcast_rows)
        assert rows_of(again.read()) == sorted(want.values(), key=str)
    assert table.read(1).count() == 12
    assert table.vacuum() > 0 and rows_of(table.read()) == sorted(want.values(), key=str)
    with pytest.raises(ValueError):
        table.read(1)


def test_keys_that_repeat_or_are_null(spark, table):
    table.put(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, None, 9)], SCHEMA))
    assert rows_of(table.read()) == [(1, "b", 1)]
    before = table.versions()
    with pytest.raises(Exception, match="a null id"):
        table.put(spark.createDataFrame([(None, "a", 2)], SCHEMA))
    table.delete(spark.createDataFrame([(7,)], "id long"))
    assert rows_of(table.read()) == [(1, "b", 1)] and len(table.versions()) == len(before) + 1


def test_readers_keep_their_version_during_merges_and_after_a_killed_one(spark, table):
    table.put(spark.createDataFrame([(i, "old", i) for i in range(50)], SCHEMA))
    held = table.read()
    # a writer that dies before it publishes
    table._publish, publish = lambda s: (_ for _ in ()).throw(KeyboardInterrupt()), table._publish
    with pytest.raises(KeyboardInterrupt):
        table.put(spark.createDataFrame([(1, "lost", 1)], SCHEMA))
    table._publish = publish
    assert rows_of(table.read()) == rows_of(held)
    # readers all the while another thread merges and compacts
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            names = {r["name"] for r in table.read().collect()}
            seen.append(names)

    t = threading.Thread(target=read)
    t.start()
    for k in range(3):
        table.put(spark.createDataFrame([(i, f"new{k}", i) for i in range(50)], SCHEMA))
        table.compact()
    done.set()
    t.join()
    assert seen and all(len(s) == 1 for s in seen)  # never half of a merge, never no table
    assert {r["name"] for r in held.collect()} == {"old"} and {r["name"] for r in table.read().collect()} == {"new2"}


def test_two_writers_lose_nothing(spark, table):
    stale = table.snapshot
    table.put(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    first = table.snapshot()
    calls = iter([first.__class__(0, None, ())])  # as if it had looked before the first writer published

    def look(version=None):
        return next(calls, None) or stale(version)

    table.snapshot = look
    table.put(spark.createDataFrame([(2, "b", 2)], SCHEMA))
    table.snapshot = stale
    assert rows_of(table.read()) == [(1, "a", 1), (2, "b", 2)]


def test_files_come_all_or_none(spark, tmp_path):
    out = str(tmp_path / "blobs")
    df = spark.createDataFrame([(f"a/{i}.bin", bytes([i]) * i) for i in range(20)] + [("null.bin", None)], "path string, content binary").repartition(4)
    blob_sink.write_files(df, out)
    files = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(out) for f in names}
    assert files == {**{f"a/{i}.bin": bytes([i]) * i for i in range(20)}, "null.bin": b""}

    boom = F.when(F.col("path") == "a/7.bin", F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.lit(b"new"))
    for bad in (df.withColumn("content", boom), df.unionByName(df.limit(1)), df.withColumn("path", F.concat(F.lit("../"), "path"))):
        with pytest.raises(Exception):  # noqa: B017
            blob_sink.write_files(bad, out)
    again = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(out) for f in names}
    assert again == files and not [n for n in os.listdir(out) if n.startswith("_")]
    blob_sink.write_files(df.filter("path = 'a/3.bin'").withColumn("content", F.lit(b"other")), out)
    assert open(f"{out}/a/3.bin", "rb").read() == b"other"


def test_geotiff_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (9, 7, 3)).astype(np.uint8)
    df = spark.createDataFrame([("x.tif", to_struct(x), 10.0, 50.0, 0.5, 0.25, 4326), ("none.tif", None, 0.0, 0.0, 1.0, 1.0, 4326)], "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, west double, north double, px double, py double, epsg int")
    blob_sink.write_files(blob_sink.geotiffs(df), str(tmp_path))
    assert os.listdir(tmp_path) == ["x.tif"]
    image, where = geotiff_decode((tmp_path / "x.tif").read_bytes())
    assert (image == x).all() and where["west"] == 10.0 and where["epsg"] == 4326


def product(i, day, cloud=5.0):
    return {"product_id": f"p{i:03d}", "name": f"n{i}", "collection": "S2", "product_type": "L2A", "start": f"2024-05-{day:02d}T10:00:00Z", "cloud_cover": cloud, "lon_min": 0.0, "lat_min": 0.0, "lon_max": 1.0, "lat_max": 1.0}


def pages(at, products, size=4):
    at.mkdir(exist_ok=True)
    for k in range(0, len(products), size):
        (at / f"page-{k // size}.json").write_text(json.dumps(products[k : k + size]))


def test_pages_until_the_catalog_ends(tmp_path):
    made = [product(i, 1 + i % 20) for i in range(23)]
    pages(tmp_path / "c", made)
    client, query = catalog_pages.PageClient({"root": str(tmp_path / "c")}), catalog_pages.CatalogQuery()
    order = [p["product_id"] for p in sorted(made, key=catalog_pages.place_of)]
    for top in (1, 5, 23, 100):
        assert [p["product_id"] for p in catalog_pages.paged(client, query, top=top)] == order
        assert [p["product_id"] for p in catalog_pages.paged(client, query, None, 7, top)] == order[:7]
    last = catalog_pages.place_of(sorted(made, key=catalog_pages.place_of)[9])
    assert [p["product_id"] for p in catalog_pages.paged(client, query, last, top=4)] == order[10:]


def test_stream_of_products_since_the_last_run(spark, tmp_path):
    root, out, check = tmp_path / "c", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = catalog_pages.arrivals(spark, str(root), cloud_max=50, per_page=3, per_batch=5).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["product_id"] for r in spark.read.parquet(out).collect())

    made = [product(i, 1 + i, 90.0 if i == 4 else 5.0) for i in range(11)]
    pages(root, made)
    got = run()
    while len(got) < 10:  # a run takes what one look at the catalog finds
        before, got = got, run()
        assert len(got) > len(before)
    assert got == [f"p{i:03d}" for i in range(11) if i != 4]
    assert run() == got
    pages(root, [*made, product(11, 11), product(12, 12)])
    assert run() == [*got, "p011", "p012"]


def test_boxes_are_skipped_by_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-179, 179, 4000), rng.uniform(-89, 89, 4000)
    made = [(i, float(a), float(b), float(a + 0.5), float(b + 0.5), "x") for i, (a, b) in enumerate(zip(lon, lat, strict=True))]
    made += [(5000 + i, 10.0, 10.0, 10.1, 10.1, "hot") for i in range(1500)] + [(9000, None, None, None, None, None)]
    df = spark.createDataFrame(made, "id long, lon_min double, lat_min double, lon_max double, lat_max double, __note string")
    path = str(tmp_path / "boxes")
    boxes.write_boxes(df, path, 40)
    files = len({r[0] for r in spark.read.parquet(f"{path}/bounds").select("file").collect()})
    assert files > 20
    for box in ((0, 0, 9, 9), (9, 9, 11, 11), (170, -90, 180, 90), (-180, -90, 180, 90), (10.1, 10.1, 10.1, 10.1)):
        a, b, c, d = box
        want = {r[0] for r in made if r[1] is not None and r[3] >= a and r[1] <= c and r[4] >= b and r[2] <= d}
        assert {r["id"] for r in boxes.read_box(spark, path, box).collect()} == want
    small = boxes.files_in(spark, path, (-60, -60, -55, -55))
    assert 0 < len(small) <= files // 5
    assert boxes.read_box(spark, path, (500, 500, 501, 501)).columns == df.columns and boxes.read_box(spark, path, (500, 500, 501, 501)).count() == 0


def test_curve_keeps_near_places_near(spark):
    got = spark.createDataFrame([(0.0, 0.0), (0.001, 0.001), (179.999, 89.999), (-180.0, -90.0), (None, 1.0)], "lon double, lat double").select(boxes.curve(F.col("lon"), F.col("lat")).alias("z")).collect()
    z = [r["z"] for r in got]
    assert abs(z[0] - z[1]) <= 3 and z[2] == 2**32 - 1 and z[3] == 0 and z[4] is None
