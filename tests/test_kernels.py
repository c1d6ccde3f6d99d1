"""Kernels against small independent computations."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.functions import vectors as V
from terralens.operators import image, matching
from terralens.operators.encoders import BovwEncoder, TokenPoolEncoder, TokenVladEncoder, VladEncoder, Whitening, encoder
from terralens.operators.knn import VectorIndex, distractors
from terralens.settings import Settings

RNG = np.random.default_rng(5)


def textured(h=96, w=96, seed=3):
    r = np.random.default_rng(seed)
    return np.clip(image.gaussian(r.integers(0, 256, (h, w)).astype(float), 1.5) * 3 - 250, 0, 255).astype(np.uint8)


def test_png_round_trip():
    for shape in ((7, 9), (5, 4, 3)):
        a = RNG.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(image.png_decode(image.png_encode(a)), a)


def test_png_rejects_other_files():
    with pytest.raises(ValueError):
        image.png_decode(b"text")


def test_spark_reads_our_png(spark, tmp_path):
    a = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(image.png_encode(a))
    from terralens.sources.files import images

    r = images(spark, str(tmp_path)).first()["image"]
    assert np.array_equal(image.from_struct(r.asDict()), a)


def test_resize_by_area_keeps_the_mean_and_is_a_no_op_at_one():
    a = RNG.integers(0, 256, (40, 60)).astype(np.uint8)
    assert abs(float(image.resize(a, 20, 30).mean()) - float(a.mean())) < 1
    assert (image.resize(a, *image.wanted_size(40, 60)) == a).all()
    assert image.resize(a, *image.wanted_size(40, 60, Settings(query_gsd_m=5.0).query_scale())).shape == (20, 30)
    assert image.wanted_size(40, 60, 0.001) == (1, 1) and image.wanted_size(3, 5, 0.5) == (2, 2)
    for bad in (lambda: image.wanted_size(4, 4, 0), lambda: Settings(query_gsd_m=0.0).query_scale()):
        with pytest.raises(ValueError):
            bad()
    assert image.cap_long_side(np.zeros((2000, 1001), np.uint8)).shape == (1024, 512)


def test_stretch_of_flat_and_empty_channels():
    assert image.stretched(np.zeros((4, 4), np.uint8)).max() == 0
    assert (image.stretched(np.full((4, 4), 9, np.uint8)) == 128).all()
    assert (image.stretched(np.full((4, 4), 9, np.uint8), flat=0) == 0).all()
    for kind, shape in ((np.uint8, (40, 30)), (np.uint8, (20, 20, 3)), (np.uint16, (20, 30, 2))):
        a = (RNG.integers(0, np.iinfo(kind).max // 2, shape) * (RNG.random(shape) < 0.8)).astype(kind)
        got = image.stretched(a)
        for k in range(1 if a.ndim == 2 else shape[2]):
            band, out = (a, got) if a.ndim == 2 else (a[..., k], got[..., k])
            lo, hi = np.percentile(band[band > 0], [2, 98])
            assert np.abs(out.astype(int) - np.clip((band - lo) / (hi - lo) * 255, 0, 255).astype(int)).max() <= (0 if kind is np.uint8 else 1)
            assert (out[band == 0] == 0).all()


def test_gaussian_keeps_constants_and_local_contrast_maps_them_to_the_middle():
    flat = np.full((20, 24), 77, np.uint8)
    assert np.allclose(image.gaussian(flat, 2.0), 77)
    assert set(np.unique(image.local_contrast(flat))) <= {127, 128}
    assert image.clahe(textured()).std() > 0


def test_sift_matches_a_turned_view_and_skips_blank_images():
    p, d = image.sift(np.zeros((64, 64), np.uint8))
    assert len(p) == 0 and d.shape == (0, 128)
    a = textured(128, 128)
    p, d = image.sift(a, contrast=0.02)
    assert len(p) > 10 and d.dtype == np.float32
    view = image.query_view(a, 0.9, 10)
    q, e = image.sift(view, contrast=0.02)
    good, inliers, _ = matching.Verifier(lowe_ratio=0.8).one(q[:, :2].astype(float), e.astype(float), p[:, :2].astype(float), d.astype(float))
    assert good >= inliers >= 4


def test_ransac_finds_the_inliers_of_a_known_transform():
    src = RNG.uniform(0, 200, (60, 2))
    z = (src[:, 0] + 1j * src[:, 1]) * (0.9 + 0.3j) + (12 - 7j)
    dst = np.stack([z.real, z.imag], 1)
    dst[40:] = RNG.uniform(0, 200, (20, 2)) + 500
    ok, (m, t) = matching.ransac_similarity(src, dst, 3.0)
    assert ok[:40].all() and not ok[40:].any()
    assert abs(m - (0.9 + 0.3j)) < 1e-6 and abs(t - (12 - 7j)) < 1e-4


def test_ransac_has_no_degenerate_models():
    src = RNG.uniform(0, 200, (20, 2))
    ok, model = matching.ransac_similarity(src, np.full((20, 2), 50.0), 5.0)
    assert not ok.any() and model is None


def test_ncc_and_photometric_regimes():
    a = textured(50, 50).astype(float)
    assert matching.ncc(a, 2 * a + 3) == pytest.approx(1)
    assert matching.ncc(a, np.full_like(a, 4)) == 0
    same = (1 + 0j, 0j)
    assert matching.photometric_score(a, a, same) == pytest.approx(1)
    assert matching.photometric_score(a, 255 - a, same) == 0
    assert matching.photometric_score(a, a, (1 + 0j, 45 + 0j)) == 0  # too little overlap


def test_verifier_regimes():
    v = matching.Verifier()
    none = np.zeros((0, 128))
    assert v.one(np.zeros((0, 2)), none, np.zeros((0, 2)), none) == (0, 0, 1.0)
    d = RNG.uniform(0, 1, (30, 128))
    xy = RNG.uniform(0, 256, (30, 2))
    assert v.one(xy, d, xy, d) == (30, 30, 1.0)


def bags(spark, n=20, m=30, dim=16):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(i, (r.random((m, dim)) * 255).tolist()) for i in range(n)] + [(n, [])], "patch_id long, descs array<array<float>>")


@pytest.mark.parametrize("make", [lambda: VladEncoder(n_centroids=4, pca_dim=8, restarts=1), lambda: VladEncoder(n_centroids=4, pca_dim=None, restarts=1), lambda: BovwEncoder(words=8, restarts=1), lambda: TokenVladEncoder(n_centroids=4, restarts=1)])
def test_encoders_give_unit_vectors_and_survive_saving(spark, tmp_path, make):
    b, e = bags(spark), make()
    with pytest.raises(RuntimeError):
        e.transform(b)
    e.fit(b)
    got = {r["patch_id"]: np.array(r["vec"]) for r in e.transform(b).collect()}
    assert all(abs(np.linalg.norm(v) - (k < 20)) < 1e-4 for k, v in got.items())
    e.save(spark, str(tmp_path / "m"))
    again = type(e).load(spark, str(tmp_path / "m"))
    for r in again.transform(b).collect():
        assert np.allclose(r["vec"], got[r["patch_id"]])


def test_encoder_errors(spark):
    with pytest.raises(ValueError):
        encoder("other")
    with pytest.raises(ValueError):
        VladEncoder(n_centroids=2).fit(spark.createDataFrame([(1, [])], "patch_id long, descs array<array<float>>"))


def test_pooling_matches_numpy(spark):
    b = bags(spark, 3, 5, 4)
    d = {r["patch_id"]: np.array(r["descs"]) for r in b.collect() if r["descs"]}
    for pooling, f in (("cls", lambda x: x[0]), ("mean", lambda x: x.mean(0)), ("gem", lambda x: (np.maximum(x, 1e-6) ** 3).mean(0) ** (1 / 3))):
        for r in TokenPoolEncoder(pooling).transform(b).collect():
            want = f(d[r["patch_id"]])
            assert np.allclose(r["vec"], want / np.linalg.norm(want), atol=1e-5)


def test_whitening_gives_unit_variance(spark):
    x = np.random.default_rng(2).normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    w = Whitening.fit(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>"), 4)
    y = (x - w.mean) @ w.axes.T / np.sqrt(w.variance)
    assert np.allclose(np.cov(y.T), np.eye(4), atol=1e-6)
    assert not w.apply(np.zeros((1, 6))).any()


def vectors(spark, n, dim=16):
    x = np.random.default_rng(0).random((n, dim)).astype(np.float32)
    return spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(x)], "patch_id long, vec array<float>")


def test_index_finds_itself_and_survives_saving(spark, tmp_path):
    v = vectors(spark, 100)
    q = v.filter("patch_id < 1005").withColumnRenamed("patch_id", "query_id")
    index = VectorIndex(n_lists=8, n_probe=4)
    with pytest.raises(RuntimeError):
        index.add(v)
    with pytest.raises(RuntimeError):
        index.search(q, 3)
    index.train(v).add(v)
    first = index.search(q, 5).filter("rank = 1").collect()
    assert len(first) == 5 and all(r["query_id"] == r["patch_id"] and r["distance"] < 1e-9 for r in first)
    index.save(str(tmp_path / "i"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    assert again.stats() == index.stats() == {"ntotal": 100, "dim": 16, "n_lists": 8, "n_probe": 4}
    key = lambda rows: sorted((r["query_id"], r["rank"], r["patch_id"]) for r in rows)
    assert key(again.search(q, 5).collect()) == key(index.search(q, 5).collect())


def test_index_shrinks_its_lists_for_few_vectors_and_flat_reports_none(spark):
    v = vectors(spark, 10)
    assert VectorIndex(n_lists=256, n_probe=4).train(v).n_lists == 2
    flat = VectorIndex.chosen(10, "dino").train(v).add(v)
    assert flat.stats() == {"ntotal": 10, "dim": 16, "n_lists": 0, "n_probe": 0}
    assert not VectorIndex.chosen(60_000, "dino").flat and not VectorIndex.chosen(10, "vlad").flat


def test_distractors_are_unit_and_repeatable(spark):
    base = spark.createDataFrame([(i, np.eye(8)[i].tolist()) for i in range(8)], "row long, vec array<double>")
    a = sorted((r["patch_id"], tuple(r["vec"])) for r in distractors(base, 50).collect())
    assert a == sorted((r["patch_id"], tuple(r["vec"])) for r in distractors(base, 50).collect())
    assert len(a) == 50 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for _, v in a)


def test_what_scales_a_vector_is_computed_once(spark):
    def seconds(n):
        v = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: F.sqrt(x.cast("double")))
        rows = spark.createDataFrame([(n,)], "n int").repartition(1)  # not folded by the optimizer
        began = time.perf_counter()
        got = rows.select(V.l2_normalize(v).alias("a"), V.l2_normalize_if(v).alias("b"), V.rootsift(v).alias("c")).first()
        want = np.sqrt(np.arange(1, n + 1))
        for x, y in zip(got, (want / np.linalg.norm(want), want / np.linalg.norm(want), np.sqrt(want / want.sum())), strict=True):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-9)
        return time.perf_counter() - began

    seconds(10)
    assert seconds(6_000) < 8  # for each element again it is 36 million steps, several times


def test_scaled_vectors_keep_null_and_empty(spark):
    v = spark.createDataFrame([(0, None), (1, []), (2, [0.0, 0.0]), (3, [3.0, None])], "i int, v array<double>")
    for f in (V.l2_normalize, V.l2_normalize_if, V.rootsift):
        got = [r["x"] for r in v.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]
        assert got[:3] == [None, [], [0.0, 0.0]] and got[3][1] is None and len(got) == 4, f.__name__


def test_large_bags_match_in_little_memory():
    import tracemalloc

    x = RNG.normal(size=(3000, 8))
    y = np.concatenate([x[::-1], x[:1]])  # the first one has two equals and so no match
    tracemalloc.start()
    found = matching.two_nearest(x, y, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(i, 2999 - i) for i in range(1, 3000)]
    assert peak < 40e6  # all distances at once are 72 MB


def test_few_images_of_a_batch_are_objects_at_once(spark):
    x = np.zeros((4, 4), np.uint8)
    df = spark.createDataFrame([(i, image.to_struct(x)) for i in range(150)], f"patch_id long, image {image.IMAGE}").coalesce(1)
    seen = image.map_images(df, lambda y: y + 1)
    assert seen.count() == 150 and {bytes(r["image"]["data"]) for r in seen.collect()} == {bytes([1] * 16)}
    assert image.PIECE <= 64
