"""Asset footprints: rings in local metres, clipped to the tile, measured; shares and tile sizes by class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.geo import AUTHALIC_R, authalic_sine

TILE_M, PIXEL_M, LEAST_TILE_M = 600.0, 10.0, 160.0


def area(p: np.ndarray) -> float:
    """Signed shoelace area of a closed ring."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip(p: np.ndarray, half: float) -> np.ndarray:
    """The part of a ring in the box of +-half, one side after the other."""
    for axis in (0, 1):
        for sign in (1, -1):
            if not len(p):
                return p
            d = half - sign * p[:, axis]  # not negative inside
            q, e = np.roll(p, -1, 0), np.roll(d, -1)
            out = []
            for i in range(len(p)):
                if d[i] >= 0:
                    out.append(p[i])
                if (d[i] >= 0) != (e[i] >= 0):
                    out.append(p[i] + (q[i] - p[i]) * d[i] / (d[i] - e[i]))
            p = np.array(out).reshape(-1, 2)
    return p


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise."""
    pts = np.unique(p, axis=0)
    if len(pts) < 3:
        return pts

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def long_side(p: np.ndarray) -> float:
    """Longer side of the smallest rectangle around a ring: one of its sides lies on the hull."""
    h = hull(p)
    best = (math.inf, 0.0)
    for a, b in zip(h, np.roll(h, -1, 0), strict=True):
        u = (b - a) / max(1e-12, float(np.hypot(*(b - a))))
        s, t = h @ u, h @ np.array([-u[1], u[0]])
        w, d = float(np.ptp(s)), float(np.ptp(t))
        best = min(best, (w * d, max(w, d)))
    return best[1]


#: Decimals of the published numbers.
DIGITS = {"area_m2": 1, "extent_m": 1, "tile_share": 5}


def exact(rings: list[tuple[str, np.ndarray]], half: float = TILE_M / 2) -> dict | None:
    """Area, share of the tile, whether it goes beyond, long side. Inner rings are subtracted; None without area."""
    outer = [p for role, p in rings if role != "inner" and len(p) >= 3]
    inner = [p for role, p in rings if role == "inner" and len(p) >= 3]
    total = sum(abs(area(p)) for p in outer) - sum(abs(area(p)) for p in inner)
    if not outer or total <= 0:
        return None
    inside = sum(abs(area(clip(p, half))) for p in outer) - sum(abs(area(clip(p, half))) for p in inner)
    return {
        "area_m2": total,
        "extent_m": long_side(np.concatenate(outer)),
        "tile_share": inside / (2 * half) ** 2,
        "exceeds_tile": bool(total - inside > 1),
    }


def measure(rings: list[tuple[str, np.ndarray]], half: float = TILE_M / 2) -> dict | None:
    """The exact numbers, rounded as they are published."""
    found = exact(rings, half)
    return found and found | {k: round(found[k], n) for k, n in DIGITS.items()}


def footprints(assets: DataFrame, rounded: bool = True) -> DataFrame:
    """status and metrics of each asset. assets: asset_id, asset_type, osm_type, lat, lon, rings (null: element is gone).

    rings: array of struct(role, pts array of struct(lat, lon)). Nodes are points; an open way has no area. rounded: metrics
    as they are published; who rounds them once more needs those that aren't.
    """
    metrics = measure if rounded else exact

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                found, status = None, "polygon"
                if r.osm_type == "node":
                    status = "point"
                elif r.rings is None:
                    status = "missing_now"
                else:
                    kx = 111_320 * math.cos(math.radians(r.lat))
                    rings = []
                    for ring in r.rings:
                        pts = [(p["lon"], p["lat"]) for p in ring["pts"]]
                        if len(pts) >= 4 and pts[0] == pts[-1]:
                            rings.append((ring["role"], np.array([((x - r.lon) * kx, (y - r.lat) * 111_320) for x, y in pts[:-1]])))
                    found = metrics(rings)
                    status = "polygon" if found else "no_area"
                rows.append({"asset_id": r.asset_id, "asset_type": r.asset_type, "status": status, **(found or dict.fromkeys(("area_m2", "extent_m", "tile_share", "exceeds_tile")))})
            yield pd.DataFrame(rows, columns=["asset_id", "asset_type", "status", "area_m2", "extent_m", "tile_share", "exceeds_tile"])

    schema = "asset_id string, asset_type string, status string, area_m2 double, extent_m double, tile_share double, exceeds_tile boolean"
    return assets.select("asset_id", "asset_type", "osm_type", "lat", "lon", "rings").mapInPandas(run, schema)


def shares(found: DataFrame) -> DataFrame:
    """Share of the tile by class, in percent."""
    poly = F.col("status") == "polygon"
    s = F.when(poly, F.col("tile_share") * 100)
    mean = lambda c: F.round(100.0 * F.avg(c.cast("double")), 1)
    return found.groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("tiles"),
        mean(F.col("status") == "point").alias("point_mapped_pct"),
        F.count(F.when(poly, 1)).alias("with_area"),
        *(F.round(F.percentile(s, q), 2).alias(k) for k, q in (("median_share_pct", 0.5), ("p25_pct", 0.25), ("p75_pct", 0.75))),
        mean(s < 1).alias("under_1_pct"),
        mean(s < 5).alias("under_5_pct"),
        mean(F.when(poly, F.col("exceeds_tile"))).alias("exceeds_pct"),
    )


def proposed_tiles(found: DataFrame) -> DataFrame:
    """Tile side by class: twice the upper quartile of the extent, in whole pixels, within bounds; null below ten assets."""
    e = found.filter("status = 'polygon'").groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("extent_m", 0.75).alias("p75"))
    side = F.least(F.lit(TILE_M), F.greatest(F.lit(LEAST_TILE_M), F.ceil(F.col("p75") * 2 / PIXEL_M) * PIXEL_M))
    return e.select("asset_type", "n", F.when(F.col("n") >= 10, F.bround("p75", 0)).alias("extent_p75_m"), F.when(F.col("n") >= 10, side).alias("proposed_tile_m"))


def area_features(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds area_m2 on the ellipsoid (WGS84) and the planar centroid lat, lon of polygons of outer and inner rings.

    A ring is closed, an array of lat, lon structs with a role. Its area is summed over its edges on the authalic sphere,
    whose areas are those of the ellipsoid; inner rings are taken off. Array functions only.
    """
    sine = lambda p: authalic_sine(p["lat"])
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def edges(r: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(r["pts"]) - 1)
        return F.zip_with(F.slice(r["pts"], 1, n), F.slice(r["pts"], 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def measured(r: Column) -> Column:
        e = edges(r)
        first = lambda c: F.get(r["pts"], F.lit(0))[c]
        cross = lambda p: (p["a"]["lon"] - first("lon")) * (p["b"]["lat"] - first("lat")) - (p["b"]["lon"] - first("lon")) * (p["a"]["lat"] - first("lat"))
        mean = lambda c: add(F.transform(e, lambda p: (p["a"][c] + p["b"][c] - 2 * first(c)) * cross(p)))
        wedge = add(F.transform(e, lambda p: F.radians(p["b"]["lon"] - p["a"]["lon"]) * (2 + sine(p["a"]) + sine(p["b"]))))
        twice = add(F.transform(e, cross))
        sign = F.when(r["role"] == "inner", -1.0).otherwise(1.0)
        centre = lambda c: first(c) + F.coalesce(F.try_divide(mean(c), 3 * twice), F.lit(0.0))
        return F.struct((sign * F.abs(wedge) * AUTHALIC_R**2 / 2).alias("area"), (sign * F.abs(twice)).alias("flat"), centre("lat").alias("lat"), centre("lon").alias("lon"))

    out = df.withColumn("measured__", F.transform(rings, measured))
    flat = add(F.transform("measured__", lambda m: m["flat"]))
    at = lambda c: F.try_divide(add(F.transform("measured__", lambda m: m["flat"] * m[c])), flat)
    return out.withColumns({"area_m2": add(F.transform("measured__", lambda m: m["area"])), "lat": at("lat"), "lon": at("lon")}).drop("measured__")
