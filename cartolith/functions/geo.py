"""Distances, boxes, projections and the radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Earth radii in metres: of the de-duplication, and of the evidence joins.
DEDUP_R, EVIDENCE_R = 6_371_000.0, 6_371_008.8
DEGREE_M = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = DEDUP_R) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """x, y on an equirectangular plane around (lat0, lon0)."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * DEGREE_M, (lat - lat0) * DEGREE_M


def centroid_to_bbox(lat: Column, lon: Column, buffer_m: float) -> dict[str, Column]:
    dlat = F.lit(buffer_m / DEGREE_M)
    dlon = F.lit(buffer_m) / (F.cos(F.radians(lat)) * DEGREE_M)
    return {"minx": lon - dlon, "miny": lat - dlat, "maxx": lon + dlon, "maxy": lat + dlat}


def bbox_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Planar area of the intersection of two boxes, 0 if they are disjoint."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def in_boxes(lat: Column, lon: Column, boxes) -> Column:
    """Whether a point lies in any (lat low, lat high, lon low, lon high)."""
    hit = F.lit(False)
    for la, lb, oa, ob in boxes:
        hit = hit | (lat.between(la, lb) & lon.between(oa, ob))
    return hit


#: Contiguous United States, Alaska, Hawaii, Puerto Rico.
US_BOXES = ((24.0, 50.0, -125.0, -66.0), (51.0, 72.0, -170.0, -129.0), (18.8, 22.4, -160.5, -154.6), (17.8, 18.6, -67.4, -65.2))

# Equal Earth (published polynomial) on the authalic latitude of WGS84.
_A1, _A2, _A3, _A4 = 1.340264, -0.081106, 0.000893, 0.003796
_MAJOR, _F = 6_378_137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sin_phi):
    log = math.log if isinstance(sin_phi, float) else F.log
    return (1 - _E2) * (sin_phi / (1 - _E2 * sin_phi * sin_phi) - log((1 - _E * sin_phi) / (1 + _E * sin_phi)) / (2 * _E))


_QP = _q(1.0)
_RQ = _MAJOR * math.sqrt(_QP / 2)


AUTHALIC_R = _RQ


def authalic_sine(lat: Column) -> Column:
    """Sine of the latitude on the sphere whose areas are those of the ellipsoid."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(F.sin(F.radians(lat))) / _QP))


def equal_earth(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in metres of the Equal Earth projection."""
    beta = F.asin(authalic_sine(lat))
    t = F.asin(math.sqrt(3) / 2 * F.sin(beta))
    t2 = t * t
    t6 = t2 * t2 * t2
    x = 2 * math.sqrt(3) * _RQ * F.radians(lon) * F.cos(t) / (3 * (9 * _A4 * t6 * t2 + 7 * _A3 * t6 + 3 * _A2 * t2 + _A1))
    y = _RQ * t * (_A4 * t6 * t2 + _A3 * t6 + _A2 * t2 + _A1)
    return x, y


def spatial_blocks(df: DataFrame, size_m: float = 200_000.0) -> DataFrame:
    """Adds block_id_x, block_id_y and block_id of an equal-area grid."""
    x, y = equal_earth(F.col("lat"), F.col("lon"))
    out = df.withColumn("block_id_x", F.floor(x / size_m).cast("long")).withColumn("block_id_y", F.floor(y / size_m).cast("long"))
    return out.withColumn("block_id", F.format_string("bx_%d_by_%d", "block_id_x", "block_id_y"))


def morton(lat: Column, lon: Column) -> Column:
    """16 bits of latitude and longitude, interleaved."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    def scaled(v: Column, half: float) -> Column:
        unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v + half) / (2 * half)))
        return F.bround(unit * 65535.0).cast("long")

    return spread(scaled(lat, 90.0)).bitwiseOR(F.shiftleft(spread(scaled(lon, 180.0)), 1))


def _cells(band: Column, step: Column) -> Column:
    """Cells of longitude in a band of latitude, so wide that a radius spans one cell at most."""
    top = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * step), F.abs((band + 2) * step)))
    width = step / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))
    return F.when(top > 89.9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))).cast("long")


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / n)), n).cast("long")


def radius_join(
    left: DataFrame, right: DataFrame, radius_m: Column | float, keys: tuple[str, ...] = (), earth_r: float = DEDUP_R
) -> DataFrame:
    """All pairs of left and right rows at most radius_m apart, with equal keys, and their distance.

    Both sides have lat and lon; right columns come back with the prefix r_. A radius column must be a function of
    the keys and exist on both sides. Rows meet by an equi-join on (keys, band of latitude, cell of longitude): a left row
    is repeated for its own and the neighbouring cells, nine at most, so no pair is missed and none is found twice.
    """
    radius = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    step = F.degrees(radius / earth_r) * (1 + 1e-9)
    band = F.floor(F.col("lat") / step).cast("long")
    one = left.withColumn("__step", step).withColumn("__r", radius)
    one = one.withColumn("__band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band + d)))
    one = one.withColumn("__n", _cells(F.col("__band"), F.col("__step")))
    own = _cell(F.col("lon"), F.col("__n"))
    one = one.withColumn(
        "__cell",
        F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, F.col("__n"))))),
    )
    two = right.withColumn("__step", step).withColumn("__band", band)
    two = two.withColumn("__cell", _cell(F.col("lon"), _cells(F.col("__band"), F.col("__step")))).drop("__step")
    two = two.select(*(F.col(c).alias(f"r_{c}") for c in two.columns))
    same = [F.col(c) == F.col(f"r_{c}") for c in (*keys, "__band", "__cell")]
    both = one.join(two, same, "inner")
    both = both.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"), earth_r))
    return both.filter(F.col("distance_m") <= F.col("__r")).drop("__step", "__r", "__band", "__n", "__cell", "r___band", "r___cell")
