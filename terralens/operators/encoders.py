"""Coarse encoders: visual words with tf-idf, residual vectors (VLAD) with whitening, and pooled tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions import vectors as V
from terralens.operators.knn import assign, kmeans, matrix
from terralens.operators.matching import nested
from terralens.sources import tables


def sample_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """At most n rows of each group, in a repeatable order (a hash of the row's key, for a random one)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def word_counts(words: DataFrame, doc: str, word: str) -> DataFrame:
    """(doc, word, n): how often each document has each word, written once. It is all that document frequencies and term shares need."""
    return tables.once(words.groupBy(doc, word).agg(F.count(F.lit(1)).alias("n")))


def idf(counts: DataFrame, doc: str, word: str) -> DataFrame:
    """(word, df, idf): ln(N / (df + 1)) + 1 over the documents that have words, from word_counts."""
    n = counts.agg(F.countDistinct(doc).alias("n_docs"))
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select(word, "df", (F.ln(F.col("n_docs") / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame, doc: str, word: str) -> DataFrame:
    """(doc, word, tf, weight): term shares times idf, each document of unit length if its norm exceeds 1e-8, from word_counts."""
    per = Window.partitionBy(doc)
    h = counts.join(weights.select(word, "idf"), word).withColumn("tf", F.col("n") / F.sum("n").over(per)).withColumn("h", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("h") * F.col("h")).over(per))
    return h.withColumn("norm", norm).select(doc, word, "tf", F.when(F.col("norm") > 1e-8, F.col("h") / F.col("norm")).otherwise(F.col("h")).alias("weight"))


def residual_sums(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(bag, cid, pos, r): for each bag and centroid the sum of its descriptors' residuals, by dimension.

    rows (bag, cid, vec), centroids (cid, vec). A descriptor stays one row; sums of vectors are partial before the shuffle.
    """
    book = centroids.select("cid", F.col("vec").cast("array<double>").alias("__c"))
    off = F.zip_with(F.col("vec").cast("array<double>"), "__c", lambda x, c: x - c)
    sums = rows.join(F.broadcast(book), "cid").groupBy("bag", "cid").agg(Summarizer.sum(array_to_vector(off)).alias("s"))
    return sums.select("bag", "cid", F.posexplode(vector_to_array("s")).alias("pos", "r"))


def vlad_components(residuals: DataFrame) -> DataFrame:
    """(bag, cid, pos, v): block norms, signed square roots, then the whole vector's norm."""
    block, whole = Window.partitionBy("bag", "cid"), Window.partitionBy("bag")
    b = residuals.withColumn("b", F.col("r") / (F.sqrt(F.sum(F.col("r") * F.col("r")).over(block)) + F.lit(1e-12)))
    p = b.withColumn("p", F.signum("b") * F.sqrt(F.abs("b")))
    return p.select("bag", "cid", "pos", (F.col("p") / (F.sqrt(F.sum(F.col("p") * F.col("p")).over(whole)) + F.lit(1e-12))).alias("v"))


def gem_pool(rows: DataFrame, group: str, p: float = 3.0) -> DataFrame:
    """(group, pos, v): generalized mean of each dimension."""
    xs = rows.select(group, F.posexplode("vec").alias("pos", "x"))
    return xs.groupBy(group, "pos").agg(F.pow(F.avg(V.gem_term(F.col("x"), p)), F.lit(1.0 / p)).alias("v"))


def mean_pool(rows: DataFrame, group: str) -> DataFrame:
    xs = rows.select(group, F.posexplode("vec").alias("pos", "x"))
    return xs.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))


def _added(vectors: DataFrame, column: str, of: Callable[[np.ndarray], np.ndarray], levels: tuple[int, ...] = (2048, 64, 8)) -> tuple[int, np.ndarray]:
    """How many vectors there are and the sum of `of` over blocks of them; tasks add up the tasks' sums, level by level."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, None
        for b in batches:
            for k in range(0, b.num_rows, 512):
                x = matrix(b.column(column).slice(k, 512))
                if len(x):
                    part = of(x)
                    n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part", "n", "total"])

    def merged(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group.column("total"))
        return pa.table({"part": pa.array([group.column("part")[0].as_py()]), "n": pa.array([sum(group.column("n").to_pylist())]), "total": pa.array([total.tobytes()], pa.binary())})

    kinds = "part long, n long, total binary"
    rows = vectors.select(column).mapInArrow(sums, kinds)
    for many in levels:
        rows = rows.groupBy(F.pmod("part", F.lit(many)).alias("g")).applyInArrow(merged, kinds)
    found = sorted((r["part"], r["n"], r["total"]) for r in rows.collect())
    return sum(n for _, n, _ in found), sum((np.frombuffer(t) for _, _, t in found), np.zeros(1))


@dataclass
class Whitening:
    """Centers, rotates to principal axes and scales to unit variance; then L2."""

    mean: np.ndarray
    axes: np.ndarray  # components x dim
    variance: np.ndarray

    @staticmethod
    def fit(vectors: DataFrame, dim: int, column: str = "vec", exact_up_to: int = 1024, extra: int = 32, rounds: int = 4, seed: int = 42) -> Whitening:
        """The principal axes of the vectors, which are read several times.

        Up to `exact_up_to` numbers a vector, from sums of outer products. Wider ones by a randomized range finder: dim +
        extra directions go through the covariance `rounds` times, so tasks send width x (dim + extra) numbers, never a
        square of the width. Sums of tasks are added up in tasks.
        """
        n, mean = _added(vectors, column, lambda x: x.sum(0))
        if n < 2:
            raise ValueError("whitening needs two vectors")
        mean = mean / n
        width, keep = len(mean), min(dim, n, len(mean))
        if width <= exact_up_to:
            base = np.eye(width)
            small = _added(vectors, column, lambda x: (x - mean).T @ (x - mean))[1].reshape(width, width)
        else:
            many = min(width, keep + extra)
            base = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, many)))[0]
            for _ in range(rounds):
                through = _added(vectors, column, lambda x, q=base: (x - mean).T @ ((x - mean) @ q))[1]
                base = np.linalg.qr(through.reshape(width, many))[0]
            small = _added(vectors, column, lambda x, q=base: (y := (x - mean) @ q).T @ y)[1].reshape(many, many)
        values, turned = np.linalg.eigh(small / (n - 1))
        best = np.argsort(values)[::-1][:keep]
        axes = (base @ turned[:, best]).T
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]  # a fixed sign
        return Whitening(mean, axes, np.maximum(values[best], 1e-12))

    def apply(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes.T / np.sqrt(self.variance)
        y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
        y[~x.any(1)] = 0.0  # nothing in, nothing out
        return y


def _descriptors(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [nested(batch.column("descs"), i) for i in range(batch.num_rows)]


@dataclass
class _Encoder:
    """What encoders share: a codebook, and encoding of (patch_id, descs array<array<float>>) to (patch_id, vec)."""

    centroids: np.ndarray | None = field(default=None, init=False)

    def _codebook(self, bags: DataFrame, k: int, sample: int, restarts: int, seed: int, root: bool) -> DataFrame:
        rows = bags.filter(F.size("descs") > 0).select("patch_id", F.posexplode("descs").alias("idx", "desc"))
        kept = sample_per_group(rows, "patch_id", [F.xxhash64("patch_id", "idx", F.lit(seed)), F.col("idx")], sample)
        kept = kept.withColumn("vec", V.rootsift(F.col("desc")) if root else F.col("desc").cast("array<double>")).select("patch_id", "idx", "vec")
        if kept.isEmpty():
            raise ValueError("no descriptors to learn from")
        self.centroids = np.array(kmeans(kept, k, restarts, seed))
        return kept

    def _encode(self, descs: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def transform(self, bags: DataFrame) -> DataFrame:
        if self.centroids is None:
            raise RuntimeError("fit the encoder first")
        shared = bags.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [shared.value._encode(d).astype(np.float32) for d in _descriptors(b)]
                yield pa.RecordBatch.from_arrays([b.column("patch_id"), pa.array(out, pa.list_(pa.float32()))], ["patch_id", "vec"])

        return bags.select("patch_id", "descs").mapInArrow(run, "patch_id long, vec array<float>")

    def save(self, spark, path: str) -> None:
        """Arrays as one Parquet row each; nothing is pickled."""
        if self.centroids is None:
            raise RuntimeError("fit the encoder first")
        rows = [(name, list(map(int, a.shape)), a.astype(np.float64).ravel().tolist()) for name, a in self._arrays().items()]
        rows.append(("type:" + type(self).__name__, [0], []))
        spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str):
        rows = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
        if f"type:{cls.__name__}" not in rows:
            raise ValueError(f"not a {cls.__name__}: {path}")
        out = cls()
        out._restore(rows)
        return out

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"centroids": self.centroids}

    def _restore(self, arrays: dict[str, np.ndarray]) -> None:
        self.centroids = arrays["centroids"]


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@dataclass
class BovwEncoder(_Encoder):
    """Histogram of visual words, weighted by idf over the sampled patches."""

    words: int = 1024
    sample: int = 50
    restarts: int = 10
    idf: np.ndarray | None = field(default=None, init=False)

    def fit(self, bags: DataFrame, seed: int = 42) -> BovwEncoder:
        kept = self._codebook(bags, self.words, self.sample, self.restarts, seed, root=False)
        spark = bags.sparkSession
        book = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cid int, vec array<double>")
        rows = assign(kept, book).select("patch_id", "cid")
        n = kept.select("patch_id").distinct().count()
        self.idf = np.full(len(self.centroids), np.log(n) + 1)
        for r in idf(word_counts(rows, "patch_id", "cid"), "patch_id", "cid").collect():  # one row a word
            self.idf[r["cid"]] = r["idf"]
        return self

    def _encode(self, d: np.ndarray) -> np.ndarray:
        if not len(d):
            return np.zeros(len(self.centroids))
        h = np.bincount(_near(d.astype(np.float64), self.centroids), minlength=len(self.centroids)) / len(d) * self.idf
        n = np.linalg.norm(h)
        return h / n if n > 1e-8 else h

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"centroids": self.centroids, "idf": self.idf}

    def _restore(self, arrays: dict[str, np.ndarray]) -> None:
        super()._restore(arrays)
        self.idf = arrays["idf"]


@dataclass
class VladEncoder(_Encoder):
    """Residual sums of RootSIFT descriptors, normalized by block, by root and as a whole; whitened if asked."""

    n_centroids: int = 64
    sample: int = 100
    restarts: int = 3
    pca_dim: int | None = 256
    root: bool = True
    whitening: Whitening | None = field(default=None, init=False)

    def fit(self, bags: DataFrame, seed: int = 42) -> VladEncoder:
        self.whitening = None
        self._codebook(bags, self.n_centroids, self.sample, self.restarts, seed, self.root)
        if self.pca_dim:
            raw = self.transform(bags.filter(F.size("descs") > 0)).persist(StorageLevel.DISK_ONLY)
            self.whitening = Whitening.fit(raw, self.pca_dim)
            raw.unpersist()
        return self

    def _encode(self, d: np.ndarray) -> np.ndarray:
        k, dim = self.centroids.shape
        v = np.zeros((k, dim))
        if len(d):
            x = d.astype(np.float64)
            if self.root:
                x = np.sqrt(x / (x.sum(1, keepdims=True) + 1e-7))
            near = _near(x, self.centroids)
            np.add.at(v, near, x - self.centroids[near])
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
            v = np.sign(v) * np.sqrt(np.abs(v))
        v = v.ravel() / (np.linalg.norm(v) + 1e-12)
        return self.whitening.apply(v[None])[0] if self.whitening else v

    def _arrays(self) -> dict[str, np.ndarray]:
        out = {"centroids": self.centroids, "root": np.array([float(self.root)])}
        return out | ({"mean": self.whitening.mean, "axes": self.whitening.axes, "variance": self.whitening.variance} if self.whitening else {})

    def _restore(self, arrays: dict[str, np.ndarray]) -> None:
        super()._restore(arrays)
        self.root = bool(arrays["root"][0])
        self.whitening = Whitening(arrays["mean"], arrays["axes"], arrays["variance"]) if "mean" in arrays else None


@dataclass
class TokenVladEncoder(VladEncoder):
    """The same over encoder tokens: no RootSIFT, no whitening."""

    n_centroids: int = 32
    pca_dim: int | None = None
    root: bool = False


@dataclass
class TokenPoolEncoder:
    """Pools tokens (patch_id, descs) to one unit vector: cls (the first), mean, or gem."""

    pooling: str = "gem"
    p: float = 3.0

    def fit(self, bags: DataFrame, seed: int = 42) -> TokenPoolEncoder:
        return self

    def transform(self, bags: DataFrame) -> DataFrame:
        size = F.size("descs")
        dims = F.sequence(F.lit(0), F.size(F.get("descs", F.lit(0))) - 1)

        def along(term, final):
            mean = lambda i: F.aggregate("descs", F.lit(0.0), lambda s, t: s + term(F.get(t, i))) / size
            return F.transform(dims, lambda i: final(mean(i)))

        if self.pooling == "cls":
            pooled = F.get("descs", F.lit(0)).cast("array<double>")
        elif self.pooling == "mean":
            pooled = along(lambda x: x.cast("double"), lambda m: m)
        else:
            pooled = along(lambda x: V.gem_term(x, self.p), lambda m: F.pow(m, F.lit(1.0 / self.p)))
        return bags.filter(size > 0).select("patch_id", V.l2_normalize(pooled).cast("array<float>").alias("vec"))


#: Methods by name, and what they read: local descriptors or an image encoder's tokens.
ENCODERS = {"bovw": (BovwEncoder, "descriptors"), "vlad": (VladEncoder, "descriptors"), "dino": (TokenPoolEncoder, "tokens"), "dino_vlad": (TokenVladEncoder, "tokens")}


def encoder(method: str, **params):
    if method not in ENCODERS:
        raise ValueError(f"unknown coarse method {method}; one of {', '.join(ENCODERS)}")
    return ENCODERS[method][0](**params)
