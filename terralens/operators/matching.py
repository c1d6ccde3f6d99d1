"""Descriptor matching and geometric verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.vectors import squared_l2
from terralens.operators.knn import matrix, products


def nested(column: pa.Array, row: int) -> np.ndarray:
    """A list of equally long lists of numbers as a matrix, without a Python object for each; null and empty ones have no rows."""
    if not column[row].is_valid:
        return np.zeros((0, 0))
    inner = column[row].values
    if len(inner) == 0:
        return np.zeros((0, 0))
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    if inner.null_count or len(flat) % len(inner) or (np.diff(inner.offsets.to_numpy()) * len(inner) != len(flat)).any():
        raise ValueError("rows of different lengths")
    return flat.reshape(len(inner), -1)


def pair_distances(query: DataFrame, cand: DataFrame, group: str) -> DataFrame:
    """(group, q_idx, c_idx, distance): each query descriptor with each candidate descriptor of its group.

    query (group, q_idx, q), cand (group, c_idx, c).
    """
    return query.join(cand, group).select(group, "q_idx", "c_idx", F.sqrt(squared_l2(F.col("q"), F.col("c"))).alias("distance"))


def ratio_matches(pairs: DataFrame, group: str, ratio: float = 0.75, by: str = "q_idx", other: str = "c_idx", digits: int = 9) -> DataFrame:
    """Best match of each `by` descriptor whose distance is strictly under ratio times the second best's.

    Descriptors with one neighbour only have no second best and drop out.
    """
    d = F.round("distance", digits)
    w = Window.partitionBy(group, by).orderBy(d, other)
    two = pairs.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    best = two.groupBy(group, by).agg(F.min(F.struct("r", other, "distance")).alias("b"), F.max(F.when(F.col("r") == 2, F.col("distance"))).alias("second"))
    return best.filter(F.col("b.distance") < F.lit(ratio) * F.col("second")).select(group, by, f"b.{other}", "b.distance", "second")


def _two_of_block(digits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The two nearest candidates of each query descriptor of a block: products find some, differences rank them."""
        q, c = (matrix(t.column(n).combine_chunks()) for t, n in ((left, "q"), (right, "c")))
        ids, other = left.column("q_idx").to_numpy(), right.column("c_idx").to_numpy()
        n = min(8, len(c))
        rows: list[tuple] = []
        if len(q) and n:
            about = (c * c).sum(1)[None] - 2 * q @ c.T
            near = np.argpartition(about, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(q), 1))
            exact = np.sqrt(((q[:, None] - c[near]) ** 2).sum(2))
            order = np.lexsort((other[near], np.round(exact, digits)), axis=1)[:, :2]
            best, d = np.take_along_axis(other[near], order, 1), np.take_along_axis(exact, order, 1)
            rows = [(np.repeat(ids, order.shape[1]), best.ravel(), d.ravel())]
        q_idx, c_idx, distance = rows[0] if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        g = left.column("g").slice(0, 1) if left.num_rows else pa.chunked_array([pa.nulls(0, left.schema.field("g").type)])
        spoken = pa.array(g.to_pylist() * len(q_idx), left.schema.field("g").type)
        return pa.table({"g": spoken, "q_idx": pa.array(q_idx, pa.int64()), "c_idx": pa.array(c_idx, pa.int64()), "distance": pa.array(distance, pa.float64())})

    return run


def nearest_two(query: DataFrame, cand: DataFrame, group: str, chunk: int = 2048, digits: int = 9) -> DataFrame:
    """(group, q_idx, c_idx, distance): the two nearest candidates of each query descriptor in its group, or the one there is.

    query (group, q_idx, q), cand (group, c_idx, c), ids of longs. Both sides of a group are cut into chunks by a hash and
    every pair of chunks is a matrix product, so no task holds a group; two rows a descriptor and chunk meet for the rest.
    Which come first in a chunk is decided by products, which differ from distances by rounding only.
    """
    most = [max(1, -(-(df.groupBy(group).count().agg(F.max("count")).first()[0] or 0) // chunk)) for df in (query, cand)]
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = query.select(F.col(group).alias("g"), "q_idx", "q", mine("q_idx", most[0]).alias("i")).withColumn("j", all_of(most[1]))
    right = cand.select(F.col(group).alias("g"), "c_idx", "c", mine("c_idx", most[1]).alias("j")).withColumn("i", all_of(most[0]))
    kind = query.schema[group].dataType.simpleString()
    found = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(_two_of_block(digits), f"g {kind}, q_idx long, c_idx long, distance double")
    return found.withColumnRenamed("g", group)


def mutual_of(query: DataFrame, cand: DataFrame, group: str, ratio: float = 0.75) -> DataFrame:
    """Matches that pass the ratio test in both directions, from descriptors."""
    forward = ratio_matches(nearest_two(query, cand, group), group, ratio)
    turned = nearest_two(cand.withColumnsRenamed({"c_idx": "q_idx", "c": "q"}), query.withColumnsRenamed({"q_idx": "c_idx", "q": "c"}), group)
    back = ratio_matches(turned, group, ratio).select(group, F.col("c_idx").alias("q_idx"), F.col("q_idx").alias("c_idx"))
    return forward.join(back, [group, "q_idx", "c_idx"], "left_semi")


def mutual_matches(pairs: DataFrame, group: str, ratio: float = 0.75) -> DataFrame:
    """Matches that pass the ratio test in both directions."""
    forward = ratio_matches(pairs, group, ratio)
    back = ratio_matches(pairs, group, ratio, by="c_idx", other="q_idx").select(group, "q_idx", "c_idx")
    return forward.join(back, [group, "q_idx", "c_idx"], "left_semi")


# --- kernels ----------------------------------------------------------------------------------------------------


def two_nearest(q: np.ndarray, c: np.ndarray, ratio: float) -> list[tuple[int, int]]:
    """(query, candidate) pairs that pass the ratio test; needs two candidates at least."""
    if len(q) == 0 or len(c) < 2:
        return []
    good = []
    for at, d in products(q, c):  # some rows at a time: two large bags have more distances than memory holds
        best, two = d.argmin(1), np.sqrt(np.partition(d, 1, 1)[:, :2])
        for i in np.flatnonzero(two[:, 0] < ratio * two[:, 1]).tolist():
            good.append((at + i, int(best[i])))
    return good


def _similarity(src: np.ndarray, dst: np.ndarray) -> tuple[complex, complex]:
    """Least-squares z -> m z + t over complex points."""
    a, b = src - src.mean(), dst - dst.mean()
    power = float((np.abs(a) ** 2).sum())
    m = complex((b * a.conj()).sum() / power) if power > 1e-12 else 0j
    return m, complex(dst.mean() - m * src.mean())


def ransac_similarity(src: np.ndarray, dst: np.ndarray, threshold: float = 5.0, trials: int = 2000, confidence: float = 0.99, seed: int = 0) -> tuple[np.ndarray, tuple[complex, complex] | None]:
    """Inliers and model of the rotation, scale and shift that most point pairs agree on.

    Two pairs make a hypothesis; the number of trials shrinks as the inlier share grows; the best is fitted anew to its
    inliers. Models whose scale is not strictly within 1e-3 and 1e3 are degenerate and have no inliers.
    """
    n = len(src)
    none = np.zeros(n, bool)
    if n < 2:
        return none, None
    z, w = src[:, 0] + 1j * src[:, 1], dst[:, 0] + 1j * dst[:, 1]
    rng = np.random.default_rng(seed)
    best, model, need, done = none, None, trials, 0
    while done < need:
        i, j = rng.choice(n, 2, replace=False)
        done += 1
        if abs(z[i] - z[j]) < 1e-9:
            continue
        m = (w[i] - w[j]) / (z[i] - z[j])
        if not 1e-3 < abs(m) < 1e3:
            continue
        t = w[i] - m * z[i]
        ok = np.abs(m * z + t - w) <= threshold
        if ok.sum() > best.sum():
            best, model = ok, (complex(m), complex(t))
            miss = 1 - (best.sum() / n) ** 2
            need = min(trials, done if miss <= 0 else int(np.log(1 - confidence) / np.log(miss)) + 1 if miss < 1 else trials)
    if model is None:
        return none, None
    refit = _similarity(z[best], w[best]) if best.sum() >= 2 else model
    if 1e-3 < abs(refit[0]) < 1e3:
        ok = np.abs(refit[0] * z + refit[1] - w) <= threshold
        if ok.sum() >= best.sum():
            best, model = ok, refit
    return best, model


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalized cross-correlation; 0 where either is flat."""
    a, b = a - a.mean(), b - b.mean()
    scale = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / scale) if scale >= 1e-6 else 0.0


def warped(image: np.ndarray, model: tuple[complex, complex], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The gray image under the similarity, sampled bilinearly on a grid of `shape`, and where it has pixels."""
    m, t = model
    y, x = np.mgrid[: shape[0], : shape[1]]
    z = (x + 1j * y - t) / m
    u, v = z.real, z.imag
    h, w = image.shape
    inside = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    i, j = np.minimum(v.astype(int), max(0, h - 2)), np.minimum(u.astype(int), max(0, w - 2))
    i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    dv, du = v - i, u - j
    f = image.astype(np.float64)
    return f[i, j] * (1 - dv) * (1 - du) + f[i, j2] * (1 - dv) * du + f[i2, j] * dv * (1 - du) + f[i2, j2] * dv * du, inside


def photometric_score(query: np.ndarray, cand: np.ndarray, model: tuple[complex, complex], min_overlap: float = 0.3) -> float:
    """Correlation on the overlap of the warped query and the candidate; 0 for too little overlap or a negative one."""
    image, inside = warped(query, model, cand.shape)
    if inside.mean() < min_overlap:
        return 0.0
    return max(0.0, ncc(image[inside], cand[inside].astype(np.float64)))


@dataclass(frozen=True)
class Verifier:
    """Scores candidates by matching, RANSAC and, if asked, correlation."""

    lowe_ratio: float = 0.75
    ransac_px: float = 5.0
    min_good: int = 4
    photometric: bool = False
    min_overlap: float = 0.3
    mutual: bool = False
    seed: int = 0

    def one(self, q_xy: np.ndarray, q: np.ndarray, c_xy: np.ndarray, c: np.ndarray, q_gray=None, c_gray=None) -> tuple[int, int, float]:
        """(good matches, inliers, photometric factor)."""
        if len(c) < self.min_good or not len(q):
            return 0, 0, 1.0
        good = two_nearest(q, c, self.lowe_ratio)
        if self.mutual:
            back = {(i, j) for j, i in two_nearest(c, q, self.lowe_ratio)}
            good = [p for p in good if p in back]
        if len(good) < self.min_good:
            return len(good), 0, 1.0
        i, j = np.array(good).T
        inliers, model = ransac_similarity(q_xy[i], c_xy[j], self.ransac_px, seed=self.seed)
        factor = 1.0
        if self.photometric and model is not None and q_gray is not None and c_gray is not None:
            factor = photometric_score(q_gray, c_gray, model, self.min_overlap)
        return len(good), int(inliers.sum()), factor

    def verify(self, candidates: DataFrame) -> DataFrame:
        """(query_id, patch_id, good, inliers, inlier_ratio, confidence, photometric, score, err) of each candidate.

        candidates hold q_xy, q_descs, c_xy, c_descs and may hold q_gray and c_gray (height, width, data). Candidates
        without inliers drop out; rows that fail keep their message in err.
        """
        gray = "q_gray" in candidates.columns
        verifier = self

        def picture(x) -> np.ndarray | None:
            return None if x is None else np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["query_id", "patch_id", "good", "inliers", "photometric", "err"]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            for b in batches:
                out = []
                ids = zip(b.column("query_id").to_pylist(), b.column("patch_id").to_pylist(), strict=True)
                for i, (query, patch) in enumerate(ids):
                    try:
                        parts = [nested(b.column(k), i).astype(np.float64) for k in ("q_xy", "q_descs", "c_xy", "c_descs")]
                        out.append((query, patch, *verifier.one(*parts, *((picture(b.column(k)[i].as_py()) for k in ("q_gray", "c_gray")) if gray else ())), None))
                    except Exception as e:  # a broken row is reported, the others go on
                        out.append((query, patch, 0, 0, 1.0, str(e)[:200]))
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        found = candidates.mapInArrow(run, "query_id long, patch_id long, good int, inliers int, photometric double, err string")
        return scored(found.filter("inliers > 0 or err is not null"))


def scored(found: DataFrame) -> DataFrame:
    """found with inlier_ratio, confidence and score, each rounded as results are."""
    ratio = F.when(F.col("good") > 0, F.col("inliers") / F.col("good")).otherwise(F.lit(0.0))
    return found.select(
        *found.columns, F.round(ratio, 4).alias("inlier_ratio"), F.round(F.least(F.col("inliers") / F.lit(50.0), F.lit(1.0)), 4).alias("confidence"),
        F.round(F.col("inliers") * ratio * F.col("photometric"), 4).alias("score"),
    )


def top_report(verified: DataFrame, truth: DataFrame, n: int = 5, *ties: str) -> DataFrame:
    """top_results with `is_truth`, whether a row is its query's (query_id, patch_id) in truth."""
    marked = truth.select("query_id", "patch_id").distinct().withColumn("is_truth", F.lit(True))
    return top_results(verified, n, *ties).join(marked, ["query_id", "patch_id"], "left").withColumn("is_truth", F.coalesce("is_truth", F.lit(False)))


def top_results(verified: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n best of each query by rounded score, ties by coarse rank where it is known, then by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties, "patch_id")
    return verified.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
