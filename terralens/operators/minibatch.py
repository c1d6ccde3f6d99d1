"""k-means by mini-batches: each center moves towards its share of a batch by a rate that falls with all it has had.

Batches are seeded random parts of the vectors, written once. All restarts go through the same batches side by side, one
small job a batch, and the restart with the least cost over all vectors wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.operators.knn import matrix
from terralens.sources import tables


def spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn by its squared distance to those before, the best of a few draws."""
    out = [x[rng.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(1)
    tries = 2 + int(np.log(k))
    for _ in range(k - 1):
        total = near.sum()
        draws = rng.choice(len(x), tries, p=near / total) if total > 0 else rng.integers(len(x), size=tries)
        each = [np.minimum(near, ((x - x[d]) ** 2).sum(1)) for d in draws]
        best = int(np.argmin([e.sum() for e in each]))
        out.append(x[draws[best]])
        near = each[best]
    return np.stack(out)


def _parts(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each restart and center of restarts x k x dim: how many rows are nearest, their cost and their sum."""
    for b in batches:
        x = matrix(b.column("vec"))
        if not len(x):
            continue
        rows = []
        for r, c in enumerate(centers):
            d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
            near = d.argmin(1)
            n, cost = np.bincount(near, minlength=len(c)), np.bincount(near, d[np.arange(len(x)), near], len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            rows += [(r, i, int(n[i]), float(cost[i]), sums[i].tolist()) for i in np.flatnonzero(n).tolist()]
        columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["restart", "cid", "n", "cost", "sum"])


def _assigned(vectors: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, costs and sums over the vectors, added up by Spark in partial sums; restarts x k rows come back."""
    found = vectors.select("vec").mapInArrow(lambda it: _parts(it, centers), "restart int, cid int, n long, cost double, sum array<double>")
    total = found.groupBy("restart", "cid").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector(F.col("sum")))).alias("sum"))
    n, cost, sums = np.zeros(centers.shape[:2]), np.zeros(centers.shape[:2]), np.zeros(centers.shape)
    for row in total.collect():
        at = row["restart"], row["cid"]
        n[at], cost[at], sums[at] = row["n"], row["cost"], row["sum"]
    return n, cost, sums


def minibatch_kmeans(vectors: DataFrame, k: int, restarts: int = 3, seed: int = 42, column: str = "vec", batch: int = 10_000, epochs: int = 12, max_steps: int = 300, patience: int = 10, tolerance: float = 1e-4, least_share: float = 0.01) -> tuple[np.ndarray, float]:
    """(centers, cost): the best of `restarts` runs by the squared distances of all vectors to their nearest centers.

    There are epochs over batches of about `batch` rows, but max_steps batches at most, so with many vectors a run sees a
    random part of max_steps * batch of them. It ends early when the batches' smoothed cost has not fallen by a share of
    `tolerance` for `patience` batches. A center that has had less than least_share of the largest one's rows starts again
    at a random row. Centers are as many as the first batch has different rows, at most k. Null vectors are left out; no
    vectors raise ValueError. One seed, one result, given the same rows in the same partitions.
    """
    data = vectors.select(F.col(column).cast("array<double>").alias("vec")).filter("vec is not null")
    total = data.count()
    if not total:
        raise ValueError("no vectors to train on")
    slots = max(1, total // batch)
    used = min(slots, max_steps)
    parted = data.withColumn("slot", F.floor(F.rand(seed) * slots).cast("int")).filter(F.col("slot") < used)
    parted = tables.once(parted.repartition("slot"), "slot")
    first = parted.filter("slot = 0").select("vec").limit(batch).toArrow()
    start = np.unique(matrix(first.column("vec").combine_chunks()), axis=0) if first.num_rows else None
    if start is None:  # an empty first batch
        start = np.unique(matrix(data.limit(batch).toArrow().column("vec").combine_chunks()), axis=0)
    k = min(k, len(start))
    rng = [np.random.default_rng([seed, r]) for r in range(restarts)]
    centers = np.stack([spread_out(start, k, g) for g in rng])
    had = np.zeros(centers.shape[:2])
    smooth, best, since, decay = None, np.inf, 0, min(1.0, 2 * batch / (total + 1))
    for step in range(min(max_steps, epochs * slots)):
        n, cost, sums = _assigned(parted.filter(F.col("slot") == step % used), centers)
        rows = n.sum() / restarts
        if not rows:
            continue
        had += n
        rate = np.divide(n, had, out=np.zeros_like(n), where=had > 0)[..., None]
        mean = np.divide(sums, n[..., None], out=centers.copy(), where=n[..., None] > 0)
        centers = centers + rate * (mean - centers)
        if slots == 1:
            had[:] = 0  # a batch of all rows is a step of Lloyd's
        else:
            for r, g in enumerate(rng):
                low = np.flatnonzero(had[r] < least_share * had[r].max())
                if step % 10 == 9 and len(low):
                    centers[r, low] = start[g.integers(len(start), size=len(low))]
                    had[r, low] = had[r].max() * least_share
        now = float(cost.sum(1).min()) / rows
        smooth = now if smooth is None else smooth + decay * (now - smooth)
        since = 0 if smooth < best * (1 - tolerance) else since + 1
        best = min(best, smooth)
        if since >= patience:
            break
    _, cost, _ = _assigned(data, centers)
    top = int(cost.sum(1).argmin())
    return centers[top], float(cost[top].sum())
