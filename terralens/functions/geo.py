"""Geographic functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0
METERS_PER_DEGREE = 111_320.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return 1000 * haversine_km(lon1, lat1, lon2, lat2)


def mercator_x(lon: Column) -> Column:
    return MERCATOR_M * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_M * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / MERCATOR_M)))


def window_around(lon: Column, lat: Column, size_m: Column) -> Column:
    """The box of size_m meters a side around a point, as a struct of four corners."""
    half_lat = size_m / METERS_PER_DEGREE / 2
    half_lon = size_m / (METERS_PER_DEGREE * F.cos(F.radians(lat))) / 2
    return F.struct((lon - half_lon).alias("lon_min"), (lat - half_lat).alias("lat_min"), (lon + half_lon).alias("lon_max"), (lat + half_lat).alias("lat_max"))


def in_box(lon: Column, lat: Column, box: Column) -> Column:
    """Closed: points on the border are inside."""
    return lon.between(box["lon_min"], box["lon_max"]) & lat.between(box["lat_min"], box["lat_max"])


def boxes_touch(a: Column, b: Column) -> Column:
    """Closed intersection of two boxes."""
    return ~((a["lon_max"] < b["lon_min"]) | (a["lon_min"] > b["lon_max"]) | (a["lat_max"] < b["lat_min"]) | (a["lat_min"] > b["lat_max"]))


def box_wkt(box: Column) -> Column:
    """The box as a closed WKT polygon, from its lower left corner on."""
    a, b, c, d = (box[x].cast("string") for x in ("lon_min", "lat_min", "lon_max", "lat_max"))
    corner = lambda x, y: F.concat(x, F.lit(" "), y)
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", corner(a, b), corner(c, b), corner(c, d), corner(a, d), corner(a, b)), F.lit("))"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int"))


def utm_to_lonlat(easting: Column, northing: Column, zone: Column, south: Column) -> Column:
    """WGS84 longitude and latitude of UTM coordinates, by the series in the third flattening (under a millimeter off)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    scale = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))) / (0.9996 * scale)
    eta = (easting - 500000.0) / (0.9996 * scale)
    xi1, eta1 = xi, eta
    for k, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + zone * 6 - 183
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))
