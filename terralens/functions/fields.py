"""String, JSON and bookkeeping functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_list(csv: Column) -> Column:
    """Distinct ids of a comma-separated list, ascending; blanks and other text are left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(csv, ","), lambda x: F.trim(x).try_cast("long")))))


def is_expected(patch_id: Column, csv: Column) -> Column:
    """Whether the id is in the comma-separated list; null where there is no list."""
    return F.array_contains(id_list(csv), patch_id)


def source_id(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column, gsd: Column, label: Column) -> Column:
    """The name of an ingested region: its rounded box and resolution, and a label if there is one."""
    named = F.format_string("esri:%.4f,%.4f,%.4f,%.4f@%s", lon_min, lat_min, lon_max, lat_max, gsd.cast("string"))
    return F.when(label.isNotNull() & (label != ""), F.concat(named, F.lit(":"), label)).otherwise(named)


def patch_key(tile_id: Column, patch_id: Column) -> Column:
    return F.concat(F.concat_ws("/", F.lit("patches"), tile_id.cast("string"), patch_id.cast("string")), F.lit(".png"))


def stable_id(*natural: Column) -> Column:
    """A UUID-shaped identifier that depends on the natural key alone, so runs can be repeated."""
    h = F.md5(F.concat_ws("\u0001", *natural))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def is_uuid(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def iso_day(ts: Column) -> Column:
    return F.substring(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 1, 10)


def content_range_total(header: Column) -> Column:
    """The number after the slash of a Content-Range header; null where there is none."""
    return F.element_at(F.split(header, "/"), -1).try_cast("long")


def attribute(attributes: Column, name: str) -> Column:
    """Value of the first of array<struct<Name, Value>> with that name."""
    return F.get(F.filter(attributes, lambda a: a["Name"] == name), F.lit(0))["Value"]


def url_of(prefix: str, path: Column) -> Column:
    return F.when(path.isNotNull(), F.concat(F.lit(prefix.rstrip("/") + "/"), path))


def expiring_url(prefix: str, path: Column, expires: Column, secret: str) -> Column:
    """A link to the path that names when it ends (seconds since 1970) and is signed; null without a path or an end."""
    name = F.when(F.trim(path) != "", path)
    sign = F.sha2(F.concat_ws("\n", F.lit(secret), name, expires.cast("string")), 256)
    return F.when(name.isNotNull() & expires.isNotNull(), F.concat(F.lit(prefix.rstrip("/") + "/"), name, F.lit("?expires="), expires.cast("string"), F.lit("&signature="), sign))


def link_valid(url: Column, prefix: str, now: Column, secret: str) -> Column:
    """Whether an expiring_url is signed with the secret and has not ended."""
    path = F.regexp_extract(F.substring_index(url, "?expires=", 1), "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in prefix.rstrip("/")) + "/(.*)$", 1)
    expires = F.regexp_extract(url, r"\?expires=(\d+)&signature=", 1).try_cast("long")
    return F.coalesce((url == expiring_url(prefix, path, expires, secret)) & (now < expires), F.lit(False))
