"""A product catalog that is served in pages, as a Python data source with one partition a page.

A client gives a page's products for a query. The one here reads pages from JSON files (page-0.json, ...); clients of
remote catalogs subclass PageClient. Filters on cloud cover, box, dates and collection go to the client, and Spark checks
them again. Pages are asked for five times before a failure counts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from terralens.sources.files import retried

SCHEMA = "product_id string, name string, collection string, product_type string, start timestamp, cloud_cover double, lon_min double, lat_min double, lon_max double, lat_max double"

PUSHED = ("cloud_cover", "collection", "product_type", "start", "lon_min", "lat_min", "lon_max", "lat_max")


def moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "")).replace(tzinfo=None)


@dataclass
class CatalogQuery:
    limits: dict = field(default_factory=dict)  # (column, 'min' | 'max' | 'below' | 'is') -> value

    def admits(self, product: dict) -> bool:
        for (column, how), limit in self.limits.items():
            value = product.get(column)
            if isinstance(limit, datetime) and isinstance(value, str):
                value, limit = moment(value), limit.replace(tzinfo=None)
            if value is None or (how == "min" and value < limit) or (how == "max" and value > limit) or (how == "below" and value >= limit) or (how == "is" and value != limit):
                return False
        return True

    def odata(self) -> str:
        """The same conditions as an OData filter."""
        sign = {"min": "ge", "max": "le", "below": "lt", "is": "eq"}
        show = lambda v: f"'{v}'" if isinstance(v, str) else v.strftime("%Y-%m-%dT%H:%M:%S.000Z") if isinstance(v, datetime) else str(v)
        return " and ".join(f"{c} {sign[how]} {show(v)}" for (c, how), v in sorted(self.limits.items()))


class PageClient:
    """Pages by number; subclasses fetch them from where the catalog is.

    Besides pages of files, `after` gives products in the order of (start, product_id), as catalogs do with $orderby, $skip and $top.
    """

    def __init__(self, options: dict) -> None:
        self.root = options["root"]

    def pages(self) -> int:
        return sum(n.startswith("page-") and n.endswith(".json") for n in os.listdir(self.root))

    def page(self, number: int, query: CatalogQuery) -> list[dict]:
        with open(os.path.join(self.root, f"page-{number}.json"), encoding="utf-8") as f:
            return [p for p in json.load(f) if query.admits(p)]

    def after(self, last: tuple[str, str] | None, query: CatalogQuery, skip: int, top: int) -> list[dict]:
        """`top` products behind (start, product_id) = last, the first `skip` of them left out; fewer at the end."""
        found = [p for k in range(self.pages()) for p in self.page(k, query) if p.get("start") and (last is None or place_of(p) > tuple(last))]
        return sorted(found, key=place_of)[skip : skip + top]


def place_of(product: dict) -> tuple[str, str]:
    """Where a product stands in the order of starts; ISO times in one form sort as text."""
    return moment(product["start"]).isoformat(timespec="microseconds"), product.get("product_id") or ""


def paged(client: PageClient, query: CatalogQuery, last: tuple[str, str] | None = None, most: int | None = None, top: int = 100, first_wait: float = 1.0) -> Iterator[dict]:
    """Products in order, page by page until one is short or `most` are there: the number of pages is not known before."""
    given = 0
    while most is None or given < most:
        n = top if most is None else min(top, most - given)
        page = retried(lambda n=n: client.after(last, query, given, n), 5, first_wait)  # noqa: B023
        yield from page
        given += len(page)
        if len(page) < n:
            return


class _Page(InputPartition):
    pass


def _row(p: dict) -> tuple:
    start = moment(p["start"]) if p.get("start") else None
    return (p.get("product_id"), p.get("name"), p.get("collection"), p.get("product_type"), start, p.get("cloud_cover"), *(p.get(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.client, self.query = PageClient(options), CatalogQuery()
        self.first_wait = float(options.get("first_wait", 1.0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            how = {GreaterThanOrEqual: "min", LessThanOrEqual: "max", LessThan: "below", EqualTo: "is"}.get(type(f))
            if how and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.query.limits[f.attribute[0], how] = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(self.client.pages())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for p in retried(lambda: self.client.page(partition.value, self.query), 5, self.first_wait):
            yield _row(p)


class _Arrivals(DataSourceStreamReader):
    """Products behind the last one seen, in the order of (start, product_id): an offset is that pair.

    Options: cloud_max, collection; per_batch, the most products of a micro-batch; per_page, those of a page, a partition each.
    A product that appears later with an earlier start than the offset is not seen, as the catalog's order says nothing of it.
    """

    def __init__(self, options: dict) -> None:
        self.client, self.query = PageClient(options), CatalogQuery()
        if "cloud_max" in options:
            self.query.limits["cloud_cover", "max"] = float(options["cloud_max"])
        if "collection" in options:
            self.query.limits["collection", "is"] = options["collection"]
        self.per_batch, self.per_page = int(options.get("per_batch", 1000)), int(options.get("per_page", 100))
        self.first_wait = float(options.get("first_wait", 1.0))
        self.known: tuple[str, str] | None = None

    @staticmethod
    def _last(offset: dict) -> tuple[str, str] | None:
        return (offset["start"], offset["product_id"]) if offset.get("start") else None

    def initialOffset(self) -> dict:
        return {"start": "", "product_id": ""}

    def latestOffset(self) -> dict:
        for p in paged(self.client, self.query, self.known, self.per_batch, self.per_page, self.first_wait):
            self.known = place_of(p)
        return {"start": self.known[0], "product_id": self.known[1]} if self.known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        last, until = self._last(start), self._last(end)
        self.known = self.known or until  # a restarted stream goes on behind what it had planned
        n = 0
        for p in paged(self.client, self.query, last, None, self.per_page, self.first_wait):
            if until is None or place_of(p) > until:
                break
            n += 1
        return [_Page((last, until, skip, min(self.per_page, n - skip))) for skip in range(0, n, self.per_page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        last, until, skip, top = partition.value
        for p in retried(lambda: self.client.after(last, self.query, skip, top), 5, self.first_wait):
            if place_of(p) <= tuple(until):
                yield _row(p)

    def commit(self, end: dict) -> None:
        self.known = max(filter(None, (self.known, self._last(end))), default=None)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(dict(self.options))


def arrivals(spark: SparkSession, root: str, **options) -> DataFrame:
    """A stream of the catalog's products, those since the last run when its query has a checkpoint; see _Arrivals for options."""
    spark.dataSource.register(CatalogSource)
    return spark.readStream.format("catalog_pages").options(root=root, **options).load()


def search(spark: SparkSession, root: str, bbox: tuple[float, float, float, float], date_from: str, date_to: str, cloud_max: float = 20.0, collection: str | None = None, product_type: str | None = None, max_results: int = 100) -> DataFrame:
    """Products that meet the box (borders count) in a closed range of days, the oldest first."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    df = spark.read.format("catalog_pages").option("root", root).load().filter(F.col("cloud_cover") <= cloud_max)
    if collection is not None:
        df = df.filter(F.col("collection") == collection)
    if product_type is not None:
        df = df.filter(F.col("product_type") == product_type)
    a, b, c, d = bbox
    met = (F.col("lon_max") >= a) & (F.col("lon_min") <= c) & (F.col("lat_max") >= b) & (F.col("lat_min") <= d)
    days = (F.col("start") >= F.lit(date_from).cast("timestamp")) & (F.col("start") < F.lit(date_to).cast("timestamp") + F.expr("interval 1 day"))
    return df.filter(met & days).orderBy("start", "product_id").limit(max_results)


@dataclass
class Token:
    """An access token that is renewed half a minute before it ends; `fetch` gives (token, seconds it lasts)."""

    fetch: object
    clock: object
    value: str | None = None
    until: float = 0.0

    def get(self) -> str:
        if self.value is None or self.clock() >= self.until - 30:
            self.value, lasts = self.fetch()
            self.until = self.clock() + lasts
        return self.value
