"""Queries of the readers, writers and normalisers: rows are landed in the forms that they take, read back and summed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.functions import geo, tags
from cartolith.operators import queue, review, sampling, tiles
from cartolith.plans.curation import elements
from cartolith.plans.queries import query
from cartolith.plans.splits import _RANDOM
from cartolith.plans.stores import folder, kept
from cartolith.plans.tiling import _PIX, _tiles
from cartolith.sources import registers, tables


@query("""SELECT suffix, asset_id, CAST(round(lat * 1e4, 0) AS BIGINT) AS lat_e4, 'x' || CAST(pos % 7 AS VARCHAR) AS power FROM assets_fx, (VALUES ('parquet'), ('csv'), ('saved')) t(suffix)""")
def a1_a3_asset_files(spark, sf_dir):
    """Assets read from both forms with their tags, and from what is saved of them, without the tags."""
    base = folder(spark, "assets")
    a = view(spark, sf_dir, "assets_fx").withColumn("osm_tags", F.to_json(F.create_map(F.lit("power"), F.concat(F.lit("x"), F.col("pos") % 7), F.lit("name"), F.concat("name", F.lit(' "q", z')))))
    a = a.select("asset_id", "asset_type", "lat", "lon", "name", F.lit("osm").alias("source"), "osm_tags")
    a.write.parquet(f"{base}/in.parquet")
    a.write.csv(f"{base}/in.csv", header=True, escape='"')
    lat = F.round(F.col("lat").cast("double") * 1e4, 0).cast("long").alias("lat_e4")
    out = [tables.load_assets(spark, f"{base}/in.{s}").select(F.lit(s).alias("suffix"), "asset_id", lat, F.col("osm_tags")["power"].alias("power")) for s in ("parquet", "csv")]
    tables.save_assets(tables.load_assets(spark, f"{base}/in.csv"), f"{base}/out")
    saved = spark.read.csv(f"{base}/out.csv", header=True).join(spark.read.parquet(f"{base}/out.parquet").select("asset_id", F.col("lat").alias("same")), "asset_id")
    known = a.select("asset_id", F.get_json_object("osm_tags", "$.power").alias("power"))
    saved = saved.filter("abs(cast(lat AS double) - same) < 1e-9").join(known, "asset_id").select(F.lit("saved").alias("suffix"), "asset_id", lat, "power")
    return kept(out[0].union(out[1]).union(saved), base)


@query("""SELECT CASE WHEN osm_type = 'relation' OR osm_type = 'way' AND osm_id % 2 = 0 THEN 'area' ELSE osm_type END AS kind, count(*) AS n, count(area_m2) FILTER (osm_type <> 'node' AND (osm_type = 'relation' OR osm_id % 2 = 0)) AS measured FROM elements_fx GROUP BY 1""")
def a2_candidates(spark, sf_dir):
    """Candidates of landed nodes, open ways and areas in one table."""
    e = elements(spark, sf_dir).withColumn("area", (F.col("osm_type") == "relation") | ((F.col("osm_type") == "way") & (F.col("osm_id") % 2 == 0)))
    bare = e.drop("area_m2")
    made = tables.candidates(bare.filter("osm_type = 'node'").withColumn("kind", F.lit("node")), bare.filter("osm_type = 'way' and not area").withColumn("kind", F.lit("way")), e.filter("area").withColumn("kind", F.lit("area")))
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.count("area_m2").alias("measured"))


@query("SELECT 'manifest' AS form, region, sector, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM assets_fx GROUP BY region, sector UNION ALL SELECT 'records', region, sector, count(*), CAST(sum(pos) AS BIGINT) FROM assets_fx GROUP BY region, sector UNION ALL SELECT 'summary', region, sector, count(*) FILTER (pos % 2 = 0), CAST(sum(pos) AS BIGINT) FROM assets_fx GROUP BY region, sector")
def a4_a5_datasets(spark, sf_dir):
    """Manifests of all cells, and what a saved dataset holds: records, and summary rows with two modalities."""
    base = folder(spark, "datasets")
    a = view(spark, sf_dir, "assets_fx").select("region", "sector", "asset_id", "pos")
    rows = a.withColumn("modalities", F.when(F.col("pos") % 2 == 0, F.array(F.lit("naip"), F.lit("sentinel1"))).otherwise(F.array(F.lit("naip")))).withColumn("box", F.array(F.lit(1.0)))
    # a manifest is one document a cell
    document = F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("asset_id", "pos")).alias("records")))
    cell = F.format_string("dataset_%s_%s_v1", F.regexp_replace("region", " ", "-"), "sector")
    a.groupBy(cell.alias("cell"), "region").agg(document.alias("value")).select("cell", "value").write.partitionBy("cell").text(f"{base}/manifests")
    tables.save_dataset(rows, f"{base}/set")
    sums = lambda df, form, n: df.groupBy("region", "sector").agg(n.alias("n"), F.sum("pos").cast("long").alias("total")).select(F.lit(form).alias("form"), "region", "sector", "n", "total")
    manifest = tables.load_manifests(spark, f"{base}/manifests/cell=*", "asset_id: string, pos: bigint").withColumn("region", F.regexp_replace("region", "-", " "))
    summary = spark.read.csv(f"{base}/set/summary", header=True)
    out = sums(manifest, "manifest", F.count("*")).union(sums(spark.read.json(f"{base}/set/records"), "records", F.count("*")))
    return kept(out.union(sums(summary, "summary", F.count(F.when(F.col("modalities") == "naip+sentinel1", 1)))), base)


@query(f"SELECT asset_id, split FROM ({_RANDOM}) r")
def a6_split_artifact(spark, sf_dir):
    """The split that a saved artifact gives each asset."""
    base = folder(spark, "split")
    split = sampling.random_split(geo.spatial_blocks(view(spark, sf_dir, "assets_fx")), ["region"]).withColumn("split_protocol", F.lit("random"))
    tables.save_split(split, f"{base}/split")
    return kept(tables.load_split(spark, f"{base}/split"), base)


@query("SELECT region, sector, CAST(count(*) AS INTEGER) AS target, CAST(count(*) // 2 AS INTEGER) AS threshold, 'run ' || region AS run FROM assets_fx GROUP BY region, sector")
def a9_targets(spark, sf_dir):
    """Targets of each cell out of a landed document."""
    base = folder(spark, "targets")
    cells = view(spark, sf_dir, "assets_fx").groupBy("region", "sector").agg(F.count("*").cast("int").alias("n"))
    value = F.struct(F.col("n").alias("target"), F.floor(F.col("n") / 2).cast("int").alias("threshold"), F.col("n").alias("sample_rows"), F.concat(F.lit("run "), "region").alias("run"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "region", "sector"), value)))  # a few cells
    cells.agg(F.to_json(F.struct(F.lit(42).alias("seed"), pairs.alias("cells"))).alias("value")).write.text(base)
    return kept(tables.load_targets(spark, base).select("region", "sector", "target", "threshold", "run"), base)


@query("""SELECT 'matrix' AS form, 'seed ' || CAST(seed AS VARCHAR) AS run, truth, pred, count(*) AS n FROM preds_fx GROUP BY ALL
  UNION ALL SELECT 'saved', 'seed ' || CAST(seed AS VARCHAR), truth, -1, count(*) FILTER (truth = pred) FROM preds_fx GROUP BY seed, truth""")
def a11_a12_results(spark, sf_dir):
    """Matrices of runs out of landed results under various keys, and the conditions of a saved document."""
    base = folder(spark, "results")
    n = view(spark, sf_dir, "preds_fx").groupBy("seed", "truth", "pred").agg(F.count("*").alias("n"))
    grid = F.map_from_entries(F.collect_list(F.struct(F.col("truth") * 5 + F.col("pred"), "n")))
    at = lambda i, j: F.coalesce(F.element_at("cells", F.lit(5 * i + j)), F.lit(0))
    matrix = F.array(*(F.array(*(at(i, j) for j in range(5))) for i in range(5)))
    run = F.struct(F.array(F.struct(F.lit(0).alias("epoch"), F.lit(0.5).alias("val_macro_f1"))).alias("history"), F.struct(matrix.alias("confusion"), F.array(F.lit(0.5)).alias("per_class_f1")).alias("test"))
    seeds = n.groupBy("seed").agg(grid.alias("cells"))
    text = F.when(F.col("seed") == 0, F.to_json(F.struct(run.alias("linear_probe")))).when(F.col("seed") == 1, F.to_json(F.struct(run.alias("finetune")))).otherwise(F.to_json(run))
    seeds.select(F.concat(F.lit("seed "), "seed").alias("run"), text.alias("value")).write.partitionBy("run").text(f"{base}/runs")
    cells = tables.confusion_rows(tables.load_results(spark, f"{base}/runs/run=*"))
    name = F.regexp_replace(F.regexp_extract("path", r"run=([^/]+)/", 1), "%20", " ")
    found = cells.filter("n > 0").select(F.lit("matrix").alias("form"), name.alias("run"), "truth", "pred", "n")
    right = n.groupBy("seed", "truth").agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).cast("long").alias("n"))
    tables.save_results(right.select(F.concat(F.lit("seed "), "seed").alias("run"), "truth", "n"), f"{base}/saved")
    back = spark.read.schema("n long, conditions array<struct<run string, truth int, n long>>").json(f"{base}/saved").select(F.explode("conditions").alias("c"))
    back = back.select(F.lit("saved").alias("form"), "c.run", "c.truth", F.lit(-1).alias("pred"), "c.n")
    return kept(found.union(back), base)


@query("SELECT 'batch_' || CAST(pos % 3 AS VARCHAR) AS batch, asset_id FROM assets_fx WHERE pos % 3 < 2 UNION ALL SELECT 'batch_2', NULL FROM assets_fx WHERE pos % 3 = 2 GROUP BY 1")
def a22_agent_batches(spark, sf_dir):
    """Decisions of agents' batches, and the batches that have a packet only."""
    base = folder(spark, "agents")
    a = view(spark, sf_dir, "assets_fx").select(F.concat(F.lit("batch_"), F.col("pos") % 3).alias("batch"), "asset_id")
    for k in (0, 1):
        one = a.filter(F.col("batch") == f"batch_{k}").select(F.to_json(F.array(F.struct("asset_id"))).alias("value"))
        one.write.text(f"{base}/batch_{k}/decisions.json")
    # each row is a document of its own
    made = spark.read.schema("asset_id string").json(f"{base}/batch_*/decisions.json").withColumn("batch", F.regexp_extract(F.input_file_name(), r"(batch_[^/]+)", 1))
    none = tables.missing_batches(spark, a, made).select("batch", F.lit(None).cast("string").alias("asset_id"))
    return kept(made.select("batch", "asset_id").union(none), base)


@query("""SELECT line_id, CASE WHEN kv >= 0 THEN kv END AS kv, round(lat1, 6) AS first_lat, round(lon2, 6) AS last_lon, 4 AS ends FROM lines_fx WHERE line_id % 4 <> 1 AND line_id % 5 <> 2 AND kv >= 110 AND kv <= 400""")
def a18_lines_from_paths(spark, sf_dir):
    """Ends of the existing lines of two paths, within limits of voltage, of the countries that aren't left out."""
    at = lambda lat, lon: F.array(lon, lat)
    p, q, m = at(F.col("lat1"), F.col("lon1")), at(F.col("lat2"), F.col("lon2")), at(F.col("lat1") + 1.0, F.col("lon2") - 1.0)
    rows = view(spark, sf_dir, "lines_fx").select(
        "line_id", "kv", F.when(F.col("line_id") % 4 == 1, "Planned").when(F.col("line_id") % 4 == 2, "Existing").alias("status"),
        F.when(F.col("line_id") % 5 == 2, "B").when(F.col("line_id") % 5 == 3, "A").alias("country"), F.array(F.array(p, m, q), F.array(m, m, q)).alias("paths"),
    )
    out = registers.lines_from_paths(rows, 110.0, 400.0, ("B",))
    first, last = F.round(F.get("ends", F.lit(0))["lat"], 6), F.round(F.element_at("ends", -1)["lon"], 6)
    return out.select("line_id", "kv", first.alias("first_lat"), last.alias("last_lon"), F.size("ends").alias("ends"))


@query("SELECT s_suppkey AS plant_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'solar' WHEN 1 THEN 'wind' ELSE 'hydro' END AS kind, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 90 AS DOUBLE) ELSE 0e0 END AS mw, CAST(s_suppkey % 60 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 60 <> 0")
def a20_plants(spark, sf_dir):
    """A landed plant inventory without rows at latitude zero."""
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("string").alias("Plant_Code"), F.col("s_name").alias("Plant_Name"), F.when(k % 3 == 0, "solar").when(k % 3 == 1, "wind").otherwise("hydro").alias("PrimSource"),
        F.when(k % 5 != 0, (k % 90).cast("string")).alias("Total_MW"), (k % 60).cast("string").alias("Latitude"), F.lit("7.5").alias("Longitude"),
    )
    return registers.plants(rows).select("plant_id", "name", "kind", "mw", "lat")


@query("""WITH w AS (SELECT osm_id FROM elements_fx WHERE osm_type = 'way' AND osm_id % 5 = 1), r AS (SELECT osm_id + 1 AS ref FROM elements_fx WHERE osm_type = 'relation' AND osm_id % 4 = 3),
  refs AS (SELECT osm_id - 1 AS ref FROM w UNION SELECT osm_id + 2 FROM w UNION SELECT ref FROM r)
  SELECT osm_id FROM elements_fx WHERE osm_type = 'node' AND (t_power IS NOT NULL OR osm_id IN (SELECT ref FROM refs))""")
def b10_needed_nodes(spark, sf_dir):
    """Anchor nodes and the nodes that ways and relations refer to."""
    e = view(spark, sf_dir, "elements_fx")
    nodes = e.filter("osm_type = 'node'").select("osm_type", "osm_id", F.when(F.col("t_power").isNotNull(), F.create_map(F.lit("power"), "t_power")).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("tags"))
    ways = e.filter("osm_type = 'way' and osm_id % 5 = 1").select("osm_type", "osm_id", F.array(F.col("osm_id") - 1, F.col("osm_id") + 2).alias("refs"))
    relations = e.filter("osm_type = 'relation' and osm_id % 4 = 3").select(F.array(F.struct(F.lit("node").alias("type"), (F.col("osm_id") + 1).alias("ref")), F.struct(F.lit("way").alias("type"), F.col("osm_id").alias("ref"))).alias("members"))
    return tags.needed_nodes(nodes, ways, relations).select("osm_id")


@query("""WITH l AS (SELECT asset_id, max_by(decision, line) AS decision, max_by(label, line) AS label FROM decisions_fx WHERE reviewer = 'r1' GROUP BY asset_id), q AS (SELECT DISTINCT asset_id FROM decisions_fx)
  SELECT q.asset_id, CASE decision WHEN 'accept' THEN 'true' WHEN 'relabel' THEN 'false' WHEN 'unsure' THEN 'false' ELSE '' END AS verdict, CASE WHEN decision = 'relabel' THEN label ELSE '' END AS cls FROM q LEFT JOIN l ON l.asset_id = q.asset_id""")
def a21_export(spark, sf_dir):
    """A queue as one reviewer's annotations."""
    log = view(spark, sf_dir, "decisions_fx")
    own = review.latest(log.filter("reviewer = 'r1'"), ("line",))
    return queue.exported(log.select("asset_id").distinct(), own).select("asset_id", "verdict", "cls")


_FEW = " + ".join(f"p[{8 * (r * 8 // 3) + c * 8 // 3 + 1}]" for r in range(3) for c in range(3))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS asset_id, 9 AS n, CAST({_FEW} AS BIGINT) AS total FROM (SELECT vec_id, {_PIX} AS p FROM embeddings WHERE vec_id % 25 <> 0) e")
def g5_resampled(spark, sf_dir):
    """Tiles at three by three pixels, the nearest ones."""
    small = tiles.resampled(_tiles(spark, sf_dir).filter("image is not null"), 3)
    return small.select("asset_id", F.size("image.data").alias("n"), F.aggregate("image.data", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@query(f"""SELECT CAST(vec_id AS VARCHAR) AS asset_id, round(list_sum(CASE WHEN hi > lo THEN list_transform(p, lambda x: least(1e0, greatest(0e0, (x - lo) / (hi - lo)))) ELSE list_transform(p, lambda x: x / 255) END), 4) AS total
  FROM (SELECT vec_id, p, list_aggregate(p, 'quantile_cont', 0.02) AS lo, list_aggregate(p, 'quantile_cont', 0.98) AS hi FROM (SELECT vec_id, {_PIX} AS p FROM embeddings WHERE vec_id % 25 <> 0) e) q""")
def g6_stretched(spark, sf_dir):
    """Sum of each tile's pixels after the stretch between its percentiles."""
    wide = tiles.stretched(_tiles(spark, sf_dir).filter("image is not null"))
    return wide.select("asset_id", F.round(F.aggregate("image.data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
