"""Queries through what is stored: logs, arrays, cells and their markers, landed map documents. Each removes its own folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.operators import footprint, review, sampling
from cartolith.plans.queries import query
from cartolith.plans.splits import _SHARES
from cartolith.plans.tiling import _CORNERS, _PIX, _tiles
from cartolith.session import remove, shared_folder, written
from cartolith.sources import cells, tables


def folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def kept(out: DataFrame, base: str) -> DataFrame:
    """The result as a table of its own; what it was read from goes."""
    result = written(out, "stored")
    remove(out.sparkSession, [base])
    return result


@query("""SELECT asset_id, reviewer, max_by(decision, struct_pack(a := line % 2, b := line)) AS decision, max_by(label, struct_pack(a := line % 2, b := line)) AS label
  FROM decisions_fx GROUP BY asset_id, reviewer""")
def a10_appended_log(spark, sf_dir):
    """Latest decisions of a log that was appended to twice: even lines, then odd ones."""
    base = folder(spark, "log")
    log = view(spark, sf_dir, "decisions_fx").orderBy("line")
    for part in (0, 1):
        tables.append_decisions(log.filter(F.col("line") % 2 == part), base)
    latest = review.latest(tables.load_decisions(spark, base))
    return kept(latest.select("asset_id", "reviewer", "decision", "label"), base)


@query(f"SELECT md5(CAST(vec_id AS VARCHAR)) || '.npy' AS name, 64 AS n, CAST(list_sum({_PIX}) AS BIGINT) AS total FROM embeddings WHERE vec_id % 25 <> 0")
def a13_array_files(spark, sf_dir):
    """What lies in the array files of all tiles: a file each, values and their sum."""
    base = folder(spark, "arrays")
    image = _tiles(spark, sf_dir).filter("image is not null").select(F.col("asset_id").alias("path"), F.array("image.c", "image.h", "image.w").alias("shape"), "image.data")
    tables.save_arrays(image, base)
    back = tables.load_arrays(spark, f"{base}/*.npy")
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return kept(back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.size("data").alias("n"), total.cast("long").alias("total")), base)


@query("""SELECT region, sector, count(*) AS n, count(*) FILTER (fetched) AS n_ok, CASE WHEN length(region) % 2 = 0 THEN 2 ELSE 1 END AS runs FROM attempts_fx GROUP BY region, sector""")
def a14_stored_markers(spark, sf_dir):
    """Cells with their markers and the runs they took; a first run was killed before it marked some of them."""
    base, cell = folder(spark, "cells"), ["region", "sector"]
    rows = view(spark, sf_dir, "attempts_fx")
    grid, counts = rows.select(*cell).distinct(), {"n_ok": F.count(F.when(F.col("fetched"), 1))}
    run = cells.new_run()
    cells.begin(grid, base, run)
    cells.save(rows, base, cell)
    cells.finish(grid.filter(F.length("region") % 2 == 1), base, cell, run, counts)
    cells.run_cells(grid, base, cell, lambda open_: rows.join(F.broadcast(open_), cell, "left_semi"), counts)
    begun = spark.read.parquet(f"{base}/markers").filter("state = 'begun'").groupBy(*cell).agg(F.count(F.lit(1)).cast("int").alias("runs"))
    return kept(cells.markers(spark, base, cell).join(begun, cell).select(*cell, "n", "n_ok", "runs"), base)


@query(f"""SELECT region, sector, asset_type, count(*) AS n FROM (SELECT *, CASE region WHEN 'asia' THEN 40 ELSE 120 END AS goal FROM ({_SHARES}) s) g
  WHERE n <= goal OR i <= least(round_even(c / n * goal, 0), c) GROUP BY region, sector, asset_type""")
def a7_sample_cells(spark, sf_dir):
    """Stored samples by cell and class, after one region's were drawn anew, smaller."""
    base, cell = folder(spark, "samples"), ["region", "sector"]
    assets = view(spark, sf_dir, "assets_fx")
    for some, target in ((assets, 120), (assets.filter("region = 'asia'"), 40)):
        grid, run = some.select(*cell).distinct(), cells.new_run()
        cells.begin(grid, base, run)
        cells.save(sampling.proportional_sample(some, ["region"], target), base, cell)
        cells.finish(grid, base, cell, run)
    return kept(cells.load(spark, base, cell).groupBy(*cell, "asset_type").agg(F.count(F.lit(1)).alias("n")), base)


_NAME = "sub_2 || ' \"{' || CAST(line_id % 10 AS VARCHAR(3)) || '}\\'"
_AREA = f"round(6371007.180918474e0 * 6371007.180918474e0 * radians(1e-2) * ({_CORNERS['b']} - {_CORNERS['a']}) - CASE WHEN line_id % 2 = 0 THEN 6371007.180918474e0 * 6371007.180918474e0 * radians(3e-3) * ({_CORNERS['d']} - {_CORNERS['c']}) ELSE 0 END, 0)"


@query(f"""SELECT line_id, {_NAME} AS name, CASE line_id % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Polygon' ELSE 'Point' END AS kind,
  CASE line_id % 3 WHEN 0 THEN 4 WHEN 1 THEN CASE WHEN line_id % 2 = 0 THEN 10 ELSE 5 END ELSE 1 END AS points,
  CASE WHEN line_id % 3 = 0 THEN round(lat + 4e-2, 6) WHEN line_id % 3 = 2 THEN round(lat, 6) END AS last_lat, CASE WHEN line_id % 3 = 1 THEN {_AREA} END AS area_m2
  FROM (SELECT *, lat1 AS lat, lon1 AS lon FROM lines_fx) l""")
def a19_landed_geojson(spark, sf_dir):
    """Lines, polygons and points out of landed documents with a mark before and words after them."""
    base = folder(spark, "documents")
    at = lambda dy, dx: F.array(F.col("lon1") + dx, F.col("lat1") + dy)
    ring = lambda y0, x0, y1, x1: F.array(at(y0, x0), at(y0, x1), at(y1, x1), at(y1, x0), at(y0, x0))
    outer, inner = ring(0.0, 0.0, 0.01, 0.01), ring(0.002, 0.001, 0.006, 0.004)
    shape = lambda kind, c: F.concat(F.lit(f'{{"type": "{kind}", "coordinates": '), F.to_json(c), F.lit("}"))
    k = F.col("line_id")
    geometry = F.when(k % 3 == 0, shape("LineString", F.array(at(0.0, 0.0), at(0.01, 0.02), at(0.03, 0.01), at(0.04, 0.0))))
    geometry = geometry.when(k % 3 == 1, shape("Polygon", F.when(k % 2 == 0, F.array(outer, inner)).otherwise(F.array(outer)))).otherwise(shape("Point", at(0.0, 0.0)))
    properties = F.to_json(F.struct(k.cast("string").alias("line_id"), F.expr(_NAME.replace("\\", "\\\\")).alias("name")))
    text = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), geometry, F.lit("}"))

    def document(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ['﻿{"type": "FeatureCollection", "name": "a {\\"b\\"", "features": [']})
        first = True
        for batch in batches:
            lines = [("" if first and i == 0 else ",") + x for i, x in enumerate(batch.value)]
            first = first and not lines
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]} end of {file}"]})

    view(spark, sf_dir, "lines_fx").repartition(3).select(text.alias("value")).mapInPandas(document, "value string").write.text(base)
    found = tables.tolerant_geojson(spark, base)
    pts = F.coalesce(F.flatten("paths"), F.flatten(F.transform("rings", lambda r: r["pts"])))
    areas = footprint.area_features(found.filter("rings is not null").select("properties", "rings")).select(F.col("properties")["line_id"].alias("id"), F.round("area_m2", 0).alias("area_m2"))
    last = F.round(F.coalesce(F.when(F.col("paths").isNotNull(), F.element_at(pts, -1)["lat"]), F.get("point", F.lit(1))), 6)
    out = found.select(F.col("properties")["line_id"].alias("id"), F.col("properties")["name"].alias("name"), "kind", F.coalesce(F.size(pts), F.lit(1)).alias("points"), last.alias("last_lat"))
    out = out.withColumn("points", F.when(F.col("kind") == "Point", 1).otherwise(F.col("points"))).join(areas, "id", "left")
    return kept(out.select(F.col("id").cast("long").alias("line_id"), "name", "kind", "points", "last_lat", "area_m2"), base)
