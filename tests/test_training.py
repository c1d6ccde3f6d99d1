"""Mini-batch k-means, exact quantiles and search by lists with bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralens.operators import knn, minibatch, quantiles


def test_minibatch_cost_is_near_lloyds(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("embedding").alias("vec"))
    centers = knn.kmeans(v, 8, restarts=3)
    book = spark.createDataFrame(list(enumerate(centers)), "cid int, vec array<double>")
    lloyd = knn.assign(v, book).agg(F.sum("distance")).first()[0]
    for batch in (10_000, 250):
        got, cost = minibatch.minibatch_kmeans(v, 8, batch=batch)
        assert got.shape == (8, 64) and cost <= 1.02 * lloyd
        own = knn.assign(v, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(got)], "cid int, vec array<double>")).agg(F.sum("distance")).first()[0]
        assert abs(own - cost) < 1e-6 * cost


def test_minibatch_of_few_equal_or_no_rows(spark):
    of = lambda rows: spark.createDataFrame([(r,) for r in rows], "vec array<float>")
    rng = np.random.default_rng(1)
    blobs = of((rng.normal(size=(600, 3)) + np.repeat(np.eye(3) * 20, 200, 0)).tolist() + [None])
    a, b = (minibatch.minibatch_kmeans(blobs, 3, batch=100, seed=5) for _ in range(2))
    assert (a[0] == b[0]).all() and a[1] == b[1] and a[1] < 600 * 3 * 1.3
    assert len(minibatch.minibatch_kmeans(of([[1.0, 2.0]] * 9), 4)[0]) == 1
    with pytest.raises(ValueError):
        minibatch.minibatch_kmeans(of([]), 2)


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_equal_numpys(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.uniform(-5, 5, 900), "heavy": np.exp(rng.normal(0, 12, 700)) * rng.choice([-1, 1], 700), "one": np.array([4.25]), "same": np.full(400, 7.0), "two": np.array([1.0] * 300 + [2.0] * 100),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0]), None: rng.integers(0, 9, 500).astype(float),
    }
    rows = [(k, float(x), 1) for k, xs in groups.items() for x in xs] + [("odd", float("nan"), 1), ("odd", None, 1), ("one", float("inf"), 1)]
    df = spark.createDataFrame(rows, "band string, v double, lo int").repartition(5)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    for bins, broadcast in ((4, 10**6), (1024, 0)):
        got = {r["band"]: r for r in quantiles.exact_quantiles(df, ["band"], "v", shares, bins, few, broadcast).collect()}
        assert set(got) == set(groups)
        for k, xs in groups.items():
            want = np.quantile(xs, shares) if k != "wide" else np.array([-1.7e308, -1.7e308 * 0.92, 1.0, 1.7e308 * 0.92, 1.7e308])
            assert got[k]["n"] == len(xs) and np.allclose(got[k]["quantiles"], want, rtol=1e-12, atol=0), k
    assert quantiles.exact_quantiles(df.filter("v > 1e300 and v < 1e301"), ["band"], "v", shares).collect() == []
    whole = quantiles.exact_quantiles(df.filter("band = 'even'"), [], "v", [0.5]).collect()
    assert np.allclose(whole[0]["quantiles"], np.quantile(groups["even"], 0.5))
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, [], "v", [2.0])


def test_lists_with_bounds_lose_no_neighbour(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 1, 16)) * 4 + rng.normal(size=(12, 100, 16))).reshape(-1, 16)
    base = spark.createDataFrame([(i, v.tolist(), i // 100) for i, v in enumerate(x)], "patch_id long, vec array<double>, list_id int")
    centers = spark.createDataFrame([(k, x[k * 100 : k * 100 + 100].mean(0).tolist()) for k in range(12)], "list_id int, vec array<double>")
    queries = base.filter("patch_id % 50 = 0").select(F.col("patch_id").alias("query_id"), "vec")
    want = {(r["query_id"], r["patch_id"], r["rank"]) for r in knn.flat_knn_blocks(queries, base, 10).collect()}
    for n_probe, list_rows in ((1, 30), (3, 10**6), (12, 10**6)):
        got = {(r["query_id"], r["patch_id"], r["rank"]) for r in knn.ivf_knn_exact(queries, base, centers, 10, n_probe, list_rows).collect()}
        assert got == want
    few = base.filter("patch_id < 4")  # fewer rows than neighbours
    assert knn.ivf_knn_exact(queries, few, centers, 10, 1).count() == 4 * queries.count()


def test_probing_recalls_all_on_the_larger_table(spark):
    from terralens.plans.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    place = lambda name: {(r["query_id"], r["rank"], r["patch_id"]) for r in QUERIES[name](spark, sf).collect()}
    assert place("ivf_probe_knn") == place("flat_knn_blocks")
