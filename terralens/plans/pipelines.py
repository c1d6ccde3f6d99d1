"""Whole jobs: ingest, index build, localization, evaluation."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens import schemas
from terralens.functions import fields, geo
from terralens.operators import catalog, evaluate, image, overlay, tiling
from terralens.operators.encoders import ENCODERS, TokenPoolEncoder, encoder
from terralens.operators.knn import VectorIndex, distractors, flat_knn_blocks
from terralens.operators.matching import Verifier, top_results
from terralens.settings import Settings
from terralens.sources import files, tables, tiff


# --- ingest -----------------------------------------------------------------------------------------------------


def ingest(rasters: DataFrame, root: str, settings: Settings, aoi: tuple[float, float, float, float] | None = None, normalize: bool = False, max_patches: int | None = None) -> dict[str, int]:
    """Cuts rasters into patches and stores them: (raster_id, product_id, a..f, crs columns, image) to root/patches.

    Products that are stored already are skipped. Patches are written before their tile's row, so a run that fails is
    simply run again. Gives the numbers of patches, of skipped products and of windows under the coverage.
    """
    spark = rasters.sparkSession
    stored = tables.read(spark, f"{root}/source_tiles", schemas.SOURCE_TILES)
    todo = catalog.new_rows(rasters, stored, "product_id").withColumn("tile_id", fields.stable_id(F.col("product_id"))).persist()
    skipped = rasters.select("product_id").distinct().count() - todo.count()
    cut = tiling.cut_raster(todo, settings.patch_size, settings.overlap, settings.min_coverage, normalize=normalize)
    placed = tiling.georeferenced(cut.join(todo.drop("image"), "raster_id").withColumn("w", F.lit(settings.patch_size)).withColumn("h", F.lit(settings.patch_size)))
    if aoi is not None:
        placed = tiling.touching(placed, *aoi)
    if max_patches is not None:
        placed = placed.orderBy("raster_id", "row_off", "col_off").limit(max_patches)
    window = [F.col(c).cast("string") for c in ("tile_id", "row_off", "col_off")]
    rows = placed.select(
        F.abs(F.xxhash64(*window)).alias("patch_id"), F.col("tile_id").alias("source_tile_id"), F.struct(F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat")).alias("center"),
        F.struct("lon_min", "lat_min", "lon_max", "lat_max").alias("bbox"), fields.patch_key(F.col("tile_id"), fields.stable_id(*window)).alias("path"),
        F.lit(settings.patch_size).alias("patch_size"), F.lit(settings.gsd_m).alias("gsd_m"), F.current_timestamp().alias("created_at"), "image",
    )
    rows.write.mode("append").partitionBy("source_tile_id").parquet(f"{root}/patches")
    done = spark.read.parquet(f"{root}/patches").join(todo.select(F.col("tile_id").alias("source_tile_id")), "source_tile_id", "left_semi")
    boxes = done.groupBy("source_tile_id").agg(*(f(f"bbox.{c}").alias(c) for c, f in (("lon_min", F.min), ("lat_min", F.min), ("lon_max", F.max), ("lat_max", F.max))), F.count(F.lit(1)).alias("n"))
    made = todo.join(boxes, todo["tile_id"] == boxes["source_tile_id"], "left").select(
        F.col("tile_id").alias("id"), "product_id", F.struct("lon_min", "lat_min", "lon_max", "lat_max").alias("bbox"), F.lit(None).cast("timestamp").alias("date_acq"),
        F.lit(None).cast("double").alias("cloud_cover"), F.lit(None).cast("string").alias("path"), F.lit("processed").alias("status"), F.current_timestamp().alias("created_at"),
    )
    tables.append(made, f"{root}/source_tiles")
    created = done.count()
    todo.unpersist()
    return {"patches_created": created, "skipped": skipped}


def region_patches(regions: DataFrame, fetch, settings: Settings, block_px: int = 1024, workers: int = 8, decode=None) -> tuple[DataFrame, DataFrame]:
    """Patches of regions that come as exported blocks, and the blocks that failed.

    regions (region_id, lon_min, lat_min, lon_max, lat_max). A region is asked for in blocks of block_px pixels at most;
    fetch(row) gives the encoded image of a block from its xmin .. ymax (Web Mercator), w and h, in the tasks; decode turns
    it into pixels (default: TIFF). Patches of the overlapping grid are put together across the blocks' seams, and those
    with too few pixels go: (region_id, col_off, row_off, image, valid_fraction, lon_min, lat_min, lon_max, lat_max).
    A block that failed, or has another size than was asked for, is black in its patches and stands in the second table
    (region_id, col_off, row_off, err). No task holds a region.
    """
    decode = decode or tiff.whole
    blocks = tiling.export_blocks(regions, settings.gsd_m, block_px)
    got = files.fetched(blocks, fetch, workers)
    kinds = f"region_id {regions.schema['region_id'].dataType.simpleString()}, width long, height long, col_off long, row_off long, image {image.IMAGE}, err string"

    def run(batches):
        for b in batches:
            images, errors = [], []
            for row in b.to_pylist():
                try:
                    if row["err"]:
                        raise ValueError(row["err"])
                    x = decode(row["content"])
                    if x.shape[:2] != (row["h"], row["w"]):
                        raise ValueError(f"{x.shape[1]} x {x.shape[0]} pixels instead of {row['w']} x {row['h']}")
                    images.append(image.to_struct(x))
                    errors.append(None)
                except Exception as e:  # reported in the row
                    images.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
            names = ["region_id", "width", "height", "col_off", "row_off"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(images, overlay.IMAGE_TYPE), pa.array(errors, pa.string())], [*names, "image", "err"])

    wanted = got.select("region_id", *(F.col(c).cast("long").alias(c) for c in ("width", "height", "col_off", "row_off", "w", "h")), "content", "err")
    ready = tables.once(wanted.mapInArrow(run, kinds))  # fetched once
    shapes = blocks.groupBy("region_id", "lon_min", "lat_min", "lon_max", "lat_max").agg(F.max("width").cast("long").alias("width"), F.max("height").cast("long").alias("height"))
    cut = overlay.grid_patches(ready.filter("err is null").withColumnRenamed("region_id", "raster_id"), settings.patch_size, settings.overlap)
    cut = cut.filter((F.col("err").isNull()) & (F.col("valid_fraction") >= settings.min_coverage)).drop("err").withColumnRenamed("raster_id", "region_id")
    x0, x1, y0, y1 = geo.mercator_x(F.col("lon_min")), geo.mercator_x(F.col("lon_max")), geo.mercator_y(F.col("lat_min")), geo.mercator_y(F.col("lat_max"))
    affine = shapes.select("region_id", ((x1 - x0) / F.col("width")).alias("a"), F.lit(0.0).alias("b"), x0.alias("c"), F.lit(0.0).alias("d"), ((y0 - y1) / F.col("height")).alias("e"), y1.alias("f"))
    placed = tiling.georeferenced(cut.join(affine, "region_id"), "EPSG:3857")
    return placed.drop("a", "b", "c", "d", "e", "f", "w", "h"), ready.filter("err is not null").select("region_id", "col_off", "row_off", "err")


# --- index ------------------------------------------------------------------------------------------------------


@dataclass
class Engine:
    """A fitted encoder with its index, and the patches that it searches."""

    method: str
    encoder: object
    index: VectorIndex
    patches: DataFrame  # (patch_id, center, bbox, path)
    features: DataFrame  # (patch_id, xy, descs)
    settings: Settings

    @staticmethod
    def build(patches: DataFrame, features: DataFrame, settings: Settings | None = None, tokens: DataFrame | None = None, **params) -> Engine:
        """Fits the encoder of settings.coarse_method, encodes all patches and builds the index.

        features (patch_id, xy, descs) are computed once and stored by the caller; tokens (patch_id, descs) are needed
        by the methods that read an image encoder's tokens.
        """
        settings = settings or Settings()
        params = settings.encoder_params() | params
        reads = ENCODERS[settings.coarse_method][1]
        bags = tokens if reads == "tokens" else features.select("patch_id", "descs")
        if bags is None:
            raise ValueError(f"{settings.coarse_method} needs tokens")
        if bags.isEmpty():
            raise ValueError("no patches to index")
        model = encoder(settings.coarse_method, **params).fit(bags)
        vectors = tables.once(model.transform(bags))  # encoded once for training, lists and searches
        index = VectorIndex.chosen(vectors.count(), settings.coarse_method, settings.flat_below, n_lists=settings.n_lists, n_probe=settings.n_probe)
        index.train(vectors).add(vectors)
        return Engine(settings.coarse_method, model, index, patches, features, settings)

    def save(self, path: str) -> None:
        """Encoder, index, patches, features and settings as tables under a path; features by patch, so candidates are found in few files."""
        spark = self.patches.sparkSession
        if isinstance(self.encoder, TokenPoolEncoder):
            spark.createDataFrame([(self.encoder.pooling, self.encoder.p)], "pooling string, p double").write.mode("overwrite").parquet(f"{path}/encoder")
        else:
            self.encoder.save(spark, f"{path}/encoder")
        self.index.save(f"{path}/index")
        self.patches.write.mode("overwrite").parquet(f"{path}/patches")
        self.features.repartitionByRange("patch_id").sortWithinPartitions("patch_id").write.mode("overwrite").parquet(f"{path}/features")
        spark.createDataFrame([(self.method, json.dumps(asdict(self.settings)))], "method string, settings string").write.mode("overwrite").parquet(f"{path}/engine")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Engine:
        """An engine that answers as the saved one does, in any session."""
        method, settings = spark.read.parquet(f"{path}/engine").first()
        kind = ENCODERS[method][0]
        if kind is TokenPoolEncoder:
            model = TokenPoolEncoder(*spark.read.parquet(f"{path}/encoder").select("pooling", "p").first())
        else:
            model = kind.load(spark, f"{path}/encoder")
        patches, features = spark.read.parquet(f"{path}/patches"), spark.read.parquet(f"{path}/features")
        return Engine(method, model, VectorIndex.load(spark, f"{path}/index"), patches, features, Settings(**json.loads(settings)))

    def localize(self, queries: DataFrame, top_n: int | None = None, query_tokens: DataFrame | None = None) -> DataFrame:
        """Ranked places of many queries (query_id, xy, descs): coarse search, then verification of the candidates.

        With settings.exhaustive every patch is a candidate. Queries without descriptors have no result. The photometric
        factor needs a column `gray` (height, width, data) of both queries and features; without it it is 1.
        """
        s = self.settings
        q = queries.filter(F.size("descs") > 0)
        if s.exhaustive:
            hits = q.select("query_id").crossJoin(self.patches.select("patch_id")).withColumn("rank", F.lit(0))
        else:
            bags = (query_tokens if query_tokens is not None else q).select(F.col("query_id").alias("patch_id"), "descs")
            vectors = self.encoder.transform(bags).withColumnRenamed("patch_id", "query_id")
            hits = self.index.search(vectors, s.token_top_k if ENCODERS[self.method][1] == "tokens" else s.coarse_top_n)
        pairs = hits.select("query_id", "patch_id", F.col("rank").alias("coarse_rank"))
        pairs = tables.once(pairs)
        # only ids meet the stored features; a query's descriptors join the candidates that are left
        gray = s.photometric and "gray" in q.columns and "gray" in self.features.columns
        side = lambda df, key, k: df.select(key, F.col("xy").alias(f"{k}_xy"), F.col("descs").alias(f"{k}_descs"), *([F.col("gray").alias(f"{k}_gray")] if gray else []))
        wanted = self.features.join(pairs.select("patch_id").distinct(), "patch_id", "left_semi")
        both = pairs.select("query_id", "patch_id").join(side(wanted, "patch_id", "c"), "patch_id").join(side(q, "query_id", "q"), "query_id")
        verifier = Verifier(s.lowe_ratio, s.ransac_px, s.min_good_matches, s.photometric, s.photometric_min_overlap, s.mutual)
        # bags are large rows: their pairs are dealt to tasks by number, not by what their ids weigh
        both = both.repartition(max(1, min(pairs.count(), 2000)), "query_id", "patch_id")
        verified = verifier.verify(both).filter("err is null").join(pairs, ["query_id", "patch_id"])
        best = top_results(verified, top_n or s.result_top_n, "coarse_rank")
        placed = catalog.by_ids(catalog.patch_meta(self.patches), best)
        return placed.select(
            "query_id", "rank", "patch_id", F.round("center_lon", 6).alias("lon"), F.round("center_lat", 6).alias("lat"), F.transform("bbox", lambda x: F.round(x, 6)).alias("bbox"),
            "confidence", F.col("inliers").alias("inlier_count"), "inlier_ratio", F.round("photometric", 4).alias("photometric_score"), "score", "path",
        )


# --- evaluation -------------------------------------------------------------------------------------------------


def described(images: DataFrame, settings: Settings, key: str = "patch_id", query: bool = False) -> DataFrame:
    """(key, xy, descs, gray, err): preprocessing and local features of images (key, image) as the settings say.

    Queries and patches have scales of their own. Broken images have no features and a message.
    """
    s = settings
    scale = s.query_scale() if query else s.patch_scale()
    kernel = lambda x: image.preprocess(x, scale, s.normalize, s.clahe, s.lcn)
    ready = image.map_images(images.select(key, "image"), kernel)
    found = image.describe(ready.select(key, "image"), key, most=s.sift_features, contrast=s.sift_contrast, edge=s.sift_edge, sigma=s.sift_sigma)
    gray = ready.select(key, F.struct(F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data")).alias("gray"), F.col("err").alias("broken"))
    return found.join(gray, key).select(key, "xy", "descs", "gray", F.coalesce("broken", "err").alias("err"))


def recall_report(queries: DataFrame, vectors: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(method, k, recall): vectors (method, patch_id, vec), queries (method, query_id, vec), truth (query_id, patch_id)."""
    out = None
    for method in [r[0] for r in vectors.select("method").distinct().orderBy("method").collect()]:
        q, v = queries.filter(F.col("method") == method), vectors.filter(F.col("method") == method)
        hits = flat_knn_blocks(q, v, max(ks)).join(truth, ["query_id", "patch_id"], "right").select("query_id", "rank")
        part = evaluate.recall_at(hits, ks).select(F.lit(method).alias("method"), "k", "recall")
        out = part if out is None else out.unionByName(part)
    return out


def preprocessing_sweep(queries: DataFrame, patches: DataFrame, truth: DataFrame, grid: list[dict]) -> DataFrame:
    """(config, query_id, rank): the truth's rank after verification under each preprocessing; images come as structs."""
    out = None
    for k, config in enumerate(grid):
        kernel = lambda x, c=config: image.preprocess(x, c.get("scale", 1.0), c.get("normalize", False), c.get("clahe", False), c.get("lcn", False))
        q = image.describe(image.map_images(queries.select("query_id", "image"), kernel).filter("err is null").drop("err"), "query_id")
        p = image.describe(image.map_images(patches.select("patch_id", "image"), kernel).filter("err is null").drop("err"), "patch_id")
        both = q.select("query_id", F.col("xy").alias("q_xy"), F.col("descs").alias("q_descs")).crossJoin(p.select("patch_id", F.col("xy").alias("c_xy"), F.col("descs").alias("c_descs")))
        ranked = top_results(Verifier().verify(both), 2**31 - 1).join(truth, ["query_id", "patch_id"]).select(F.lit(k).alias("config"), "query_id", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def scale_curve(base: DataFrame, query: DataFrame, truth_id: int, steps: list[int], noise: float = 0.02, seed: int = 42) -> DataFrame:
    """(n, rank): the truth's rank as distractors are added to the real vectors base (row, patch_id, vec)."""
    from terralens.functions.vectors import squared_l2

    n = base.count()
    made = distractors(base.select("row", "vec"), max(0, max(steps) - n), noise, seed)
    real = base.select("patch_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("kind"))
    q = query.select(F.col("vec").alias("q"))
    # written once: the truth's distance, the sample for ranges and the ranges themselves read them
    rows = tables.once(real.unionByName(made.withColumn("kind", F.lit(1))).crossJoin(F.broadcast(q)).select("patch_id", "kind", squared_l2(F.col("q"), F.col("vec")).alias("d")))
    d0 = rows.filter((F.col("kind") == 0) & (F.col("patch_id") == truth_id)).select(F.col("d").alias("d0"))
    return evaluate.rank_curve(rows.crossJoin(F.broadcast(d0)), [F.col("kind"), F.abs("patch_id")], F.col("d") < F.col("d0"), steps)


def search_latency(search, queries: DataFrame, repeats: int = 20) -> float:
    """Mean seconds of a search over all queries, after one for warmth."""
    search(queries).count()
    began = time.perf_counter()
    for _ in range(repeats):
        search(queries).count()
    return (time.perf_counter() - began) / repeats


def window_eval(points: DataFrame, places: DataFrame, sizes_km: list[float]) -> DataFrame:
    """(point_id, size_km, n): places inside windows around each point (point_id, lon, lat; patch_id, p_lon, p_lat)."""
    grid = points.withColumn("size_km", F.explode(F.array(*map(F.lit, sizes_km))))
    boxed = grid.withColumn("box", geo.window_around(F.col("lon"), F.col("lat"), F.col("size_km") * 1000)).select("point_id", "size_km", "box.*")
    spots = places.select("patch_id", F.col("p_lon").alias("lon_min"), F.col("p_lat").alias("lat_min"), F.col("p_lon").alias("lon_max"), F.col("p_lat").alias("lat_max"))
    inside = tiling.box_join(boxed, spots).groupBy("point_id", "size_km").agg(F.count(F.lit(1)).alias("n"))
    return grid.select("point_id", "size_km").join(inside, ["point_id", "size_km"], "left").select("point_id", "size_km", F.coalesce("n", F.lit(0)).alias("n"))


def self_check(spark: SparkSession, patches: DataFrame, engine: Engine, crop: float = 0.7, degrees: float = 12.0) -> DataFrame:
    """(query_id, rank): the rank of each patch (patch_id, image) when a turned crop of itself is the query."""
    views = image.map_images(patches.select(F.col("patch_id").alias("query_id"), "image"), lambda x: image.query_view(x, crop, degrees)).drop("err")
    found = engine.localize(image.describe(views, "query_id").drop("err"), top_n=10)
    return found.filter(F.col("query_id") == F.col("patch_id")).select("query_id", "rank")
