"""Queries: queue, joins on ids, set operations, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith import ontology
from cartolith.fixtures import view
from cartolith.functions import tags
from cartolith.operators import gate, metrics, queue, review, sampling, tiles
from cartolith.plans.curation import CLASSIFIED, HINTS, elements
from cartolith.plans.queries import query
from cartolith.plans.splits import _RANDOM


def assets(spark, sf_dir):
    return view(spark, sf_dir, "assets_fx")


def evidence(spark, sf_dir):
    return view(spark, sf_dir, "evidence_fx")


_FUSED = """SELECT asset_id, coalesce(string_agg(text, ' | ' ORDER BY seq, text) FILTER (text <> ''), '') AS evidence, bool_or(corroborated) AS corroborated FROM evidence_fx GROUP BY asset_id"""
_Q = f"""SELECT a.asset_id, asset_type, CASE WHEN pos % 13 = 0 THEN 'Solar ' || CAST(site AS VARCHAR) ELSE '' END AS name, 'img' AS image,
  CASE WHEN pos % 13 = 0 AND asset_type <> 'energy.generation.solar_farm' THEN 'energy.generation.solar_farm' ELSE '' END AS name_hint,
  coalesce(evidence, '') AS evidence, coalesce(corroborated, false) AS corroborated,
  round(CASE WHEN pos % 13 = 0 AND asset_type <> 'energy.generation.solar_farm' THEN 1e0 ELSE 0e0 END + CASE WHEN pos % 2 = 0 THEN 1 - (pos % 50) / 5e1 ELSE 0 END, 3) AS priority
  FROM assets_fx a LEFT JOIN ({_FUSED}) f ON f.asset_id = a.asset_id"""


def _queue(spark, sf_dir):
    a = assets(spark, sf_dir)
    named = a.select("asset_id", F.when(F.col("pos") % 13 == 0, F.concat(F.lit("Solar "), F.col("site").cast("string"))).alias("name"))
    hints = a.filter("pos % 2 = 0").select("asset_id", F.lit("x").alias("model_suggests"), ((F.col("pos") % 50) / 50.0).alias("model_p_label"))
    return queue.assemble(a.select("asset_id", "asset_type"), named, a.select("asset_id", F.lit("img").alias("image")), hints, evidence(spark, sf_dir))


@query(f"""SELECT asset_id, name, name_hint, evidence, corroborated, priority, row_number() OVER (ORDER BY asset_type, priority DESC, asset_id) - 1 AS "order" FROM ({_Q}) q""")
def c10_review_queue(spark, sf_dir):
    """The review queue from its parts, in its order."""
    return _queue(spark, sf_dir).select("asset_id", "name", "name_hint", "evidence", "corroborated", "priority", "order")


@query(f"""SELECT asset_id, o AS "order" FROM (SELECT asset_id, row_number() OVER (ORDER BY asset_type, priority DESC, asset_id) - 1 AS o FROM ({_Q}) q) r
  WHERE o > 100 AND asset_id IN (SELECT asset_id FROM assets_fx WHERE pos % 3 = 0) ORDER BY o LIMIT 60""")
def e17_next_items(spark, sf_dir):
    """The next sixty items of a pass after position 100."""
    passes = assets(spark, sf_dir).select("asset_id", F.when(F.col("pos") % 3 == 0, "first").otherwise("").alias("pass"))
    return queue.next_items(_queue(spark, sf_dir), passes, "first", 100).select("asset_id", "order")


@query("""SELECT asset_id, 'no_image' AS rule FROM assets_fx WHERE pos % 31 = 0 UNION ALL SELECT asset_id, 'duplicate' FROM assets_fx WHERE pos % 53 = 0
  UNION ALL SELECT asset_id, 'no_image' FROM assets_fx WHERE pos % 31 = 0 AND pos % 53 = 0""")
def j4_queue_gate(spark, sf_dir):
    """Tiles without an image and repeated tiles of a queue into which some were put."""
    q = _queue(spark, sf_dir).select("asset_id", "image").join(assets(spark, sf_dir).select("asset_id", "pos"), "asset_id")
    q = q.withColumn("image", F.when(F.col("pos") % 31 != 0, F.col("image")))
    return queue.queue_violations(q.unionByName(q.filter("pos % 53 = 0")))


@query("SELECT osm_type, osm_id, area_m2 FROM elements_fx")
def b11_first_elements(spark, sf_dir):
    """Elements that arrive twice count once, the first."""
    e = elements(spark, sf_dir).select("osm_type", "osm_id", "area_m2", F.lit(0).alias("arrival"))
    again = e.withColumn("area_m2", F.lit(-1.0)).withColumn("arrival", F.lit(1))
    return tags.first_elements(e.unionByName(again)).select("osm_type", "osm_id", "area_m2")


@query("""SELECT l_orderkey AS osm_id, round(avg(lat) + 1.2345e-8, 6) AS lat, round(avg(lon) + 1.2345e-8, 6) AS lon, count(*) AS nodes FROM lineitem JOIN registers_fx ON point_id = l_suppkey GROUP BY l_orderkey""")
def b12_way_centroids(spark, sf_dir):
    """Centroids of ways whose nodes are the suppliers of an order.

    Means of a few multiples of 1e-4 lie on ties of the sixth decimal; both sides are shifted off them before they are rounded.
    """
    ways = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("osm_id")).agg(F.collect_list("l_suppkey").alias("refs"))
    nodes = view(spark, sf_dir, "registers_fx").select(F.col("point_id").alias("osm_id"), "lat", "lon")
    c = tags.way_centroids(ways, nodes)
    return c.select("osm_id", F.round(F.col("lat") + 1.2345e-8, 6).alias("lat"), F.round(F.col("lon") + 1.2345e-8, 6).alias("lon"), "nodes")


@query("SELECT min_by(asset_id, pos) AS first_id, site FROM assets_fx WHERE pos % 5 <> 0 GROUP BY site")
def b15_clean_rows(spark, sf_dir):
    """Rows without coordinates go, then repeated ids: here the site is the id."""
    a = assets(spark, sf_dir).withColumn("first_id", F.col("asset_id")).withColumn("asset_id", F.col("site").cast("string"))
    a = a.withColumn("lat", F.when(F.col("pos") % 5 != 0, F.col("lat")))
    return queue.without_bad_rows(a, ["pos"]).select("first_id", "site")


@query("""SELECT asset_id, CASE pos % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'relabel' ELSE 'unsure' END AS decision,
  CASE pos % 4 WHEN 0 THEN asset_type WHEN 1 THEN 'energy.generation.wind_farm' ELSE '' END AS label, 'n' AS note FROM assets_fx WHERE pos % 4 < 3""")
def b29_a21_annotation_import(spark, sf_dir):
    a = assets(spark, sf_dir)
    verdict = F.when(F.col("pos") % 4 == 0, "true").when(F.col("pos") % 4 < 3, "false").otherwise("unconfirmed")
    cls = F.when(F.col("pos") % 4 == 1, "energy.generation.wind_farm")
    rows = a.select("asset_id", verdict.alias("verdict"), cls.alias("cls"), F.lit(" n ").alias("note"))
    return queue.imported(rows, a, "r0").select("asset_id", "decision", "label", "note")


@query("SELECT asset_id FROM assets_fx WHERE sector = 'energy' ORDER BY pos LIMIT 100")
def b30_type_filter_and_head(spark, sf_dir):
    """The first hundred assets of some types."""
    kinds = [c.name for c in ontology.preset("energy")]
    return assets(spark, sf_dir).filter(F.col("asset_type").isin(kinds)).orderBy("pos").limit(100).select("asset_id")


@query("SELECT asset_id, sector AS source, CASE WHEN pos % 6 = 0 THEN 'low' ELSE 'high' END AS confidence FROM assets_fx")
def c21_attach_triage(spark, sf_dir):
    a = assets(spark, sf_dir).select("asset_id", F.col("sector").alias("source"), "pos")
    results = a.filter("pos % 6 = 0").select("asset_id", "source", F.lit("low").alias("confidence"))
    return tiles.with_triage(a.drop("pos"), results)


def _pinned(spark, sf_dir):
    a = assets(spark, sf_dir)
    scene = lambda c: F.struct(F.when(c, F.concat(F.lit("s"), F.col("pos").cast("string"))).alias("item_id"))
    scenes = F.create_map(F.lit("sentinel1"), scene(F.col("pos") % 2 == 0), F.lit("naip"), scene(F.col("pos") % 3 == 0))
    return tiles.pins(a.select("asset_id", scenes.alias("scenes"))).join(a.select("asset_id", "pos"), "asset_id")


@query("""SELECT name, count(*) AS tiles FROM (SELECT 'sentinel1' AS name FROM assets_fx WHERE pos % 2 = 0 UNION ALL SELECT 'naip' FROM assets_fx WHERE pos % 3 = 0
  UNION ALL SELECT CASE WHEN pos % 2 = 0 OR pos % 3 = 0 THEN 'pinnable' ELSE 'unpinnable' END FROM assets_fx) p GROUP BY name""")
def b34_d37_pin_report(spark, sf_dir):
    return queue.pin_report(_pinned(spark, sf_dir))


@query("SELECT asset_id FROM assets_fx WHERE (pos % 2 = 0 OR pos % 3 = 0) AND pos % 7 = 0")
def j9_lost_pins(spark, sf_dir):
    p = _pinned(spark, sf_dir)
    return queue.lost_pins(p, p.select("asset_id", F.when(F.col("pos") % 7 == 0, "failed").otherwise("ok").alias("status")))


@query(f"""SELECT r.split, count(*) AS n, count(*) FILTER (e.vec_id IS NULL) AS without FROM ({_RANDOM}) r LEFT JOIN embeddings e ON e.vec_id = r.pos GROUP BY r.split""")
def c11_c15_embedding_loss(spark, sf_dir):
    """Tiles of each split and those without an embedding."""
    split = sampling.random_split(assets(spark, sf_dir), ["region"])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pos"), F.lit(True).alias("has"))
    return split.join(e, "pos", "left").groupBy("split").agg(F.count("*").alias("n"), F.count(F.when(F.col("has").isNull(), 1)).alias("without"))


@query("SELECT asset_id, label FROM assets_fx JOIN embeddings ON vec_id = pos")
def c12_embedding_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pos"), "label")
    return assets(spark, sf_dir).join(e, "pos").select("asset_id", "label")


@query("SELECT DISTINCT asset_id, source FROM evidence_fx WHERE asset_id IN (SELECT asset_id FROM assets_fx)")
def c16_candidates_in_queue(spark, sf_dir):
    return evidence(spark, sf_dir).join(assets(spark, sf_dir), "asset_id", "left_semi").select("asset_id", "source").distinct()


@query(f"""SELECT a.asset_id, CASE WHEN pos % 3 = 1 THEN round((pos % 40) * 10e0, 0) END AS extent, m.median, h.hint FROM assets_fx a
  JOIN (SELECT asset_type, median((pos % 40) * 10e0) AS median FROM assets_fx WHERE pos % 3 = 1 GROUP BY asset_type) m ON m.asset_type = a.asset_type LEFT JOIN ({HINTS}) h ON h.osm_id = a.pos""")
def c23_sample_hints(spark, sf_dir):
    """Each tile's footprint beside the median of its class, and its tags."""
    a = assets(spark, sf_dir).withColumn("extent", F.when(F.col("pos") % 3 == 1, (F.col("pos") % 40) * 10.0))
    medians = a.groupBy("asset_type").agg(F.percentile("extent", 0.5).alias("median"))
    hints = elements(spark, sf_dir).select(F.col("osm_id").alias("pos"), tags.hint_text(F.col("tags")).alias("hint"))
    return a.join(F.broadcast(medians), "asset_type").join(hints, "pos", "left").select("asset_id", "extent", "median", "hint")


@query("""WITH l AS (SELECT asset_id, reviewer, max_by(decision, line) AS decision, max_by(label, line) AS label FROM decisions_fx GROUP BY asset_id, reviewer),
  u AS (SELECT DISTINCT asset_id, source FROM evidence_fx WHERE auto_ok)
  SELECT u.source, count(DISTINCT u.asset_id) AS audit_tiles, count(l.decision) AS reviewed, count(*) FILTER (l.decision = 'accept' OR l.label = 'energy.generation.solar_farm') AS agree,
    round(1e2 * count(*) FILTER (l.decision = 'accept' OR l.label = 'energy.generation.solar_farm') / nullif(count(l.decision), 0), 1) AS agreement_pct
  FROM u LEFT JOIN l ON l.asset_id = u.asset_id AND l.reviewer <> 'source' GROUP BY u.source""")
def d29_audit_agreement(spark, sf_dir):
    audit = evidence(spark, sf_dir).filter("auto_ok").select("asset_id", "source").distinct()
    known = audit.select("asset_id").distinct().withColumn("asset_type", F.lit("energy.generation.solar_farm"))
    return queue.audit_agreement(audit, known, review.latest(view(spark, sf_dir, "decisions_fx"), ("line",)))


@query("""SELECT model, protocol, gmacs, params_m, round(avg(time_s), 6) AS wall_s, round(avg(epoch * 1e-1 + 2), 6) AS peak_gb FROM epochs_fx JOIN (VALUES ('m0', 1.5e0, 86.7e0), ('m1', 20e0, 11.2e0), ('m2', 0e0, 0e0), ('m3', 957.6e0, 304.1e0)) c(name, gmacs, params_m) ON name = model GROUP BY ALL""")
def d40_costs(spark, sf_dir):
    """Cost of each model beside its runs."""
    costs = spark.createDataFrame([("m0", 1.5, 86.7), ("m1", 20.0, 11.2), ("m2", 0.0, 0.0), ("m3", 957.6, 304.1)], "model string, gmacs double, params_m double")
    runs = view(spark, sf_dir, "epochs_fx").withColumn("gb", F.col("epoch") * 0.1 + 2)
    runs = runs.groupBy("model", "protocol").agg(F.round(F.avg("time_s"), 6).alias("wall_s"), F.round(F.avg("gb"), 6).alias("peak_gb"))
    return runs.join(F.broadcast(costs), "model").select("model", "protocol", "gmacs", "params_m", "wall_s", "peak_gb")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN passed THEN 'passed' WHEN fetched THEN 'fetched' ELSE 'failed' END AS status FROM attempts_fx) a GROUP BY status")
def d39_fetch_summary(spark, sf_dir):
    status = F.when(F.col("passed"), "passed").when(F.col("fetched"), "fetched").otherwise("failed")
    return view(spark, sf_dir, "attempts_fx").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""SELECT asset_id FROM (SELECT *, count(*) OVER (PARTITION BY region, asset_type) AS c, count(*) OVER (PARTITION BY region) AS n,
  row_number() OVER (PARTITION BY region, asset_type ORDER BY md5(concat_ws('|', '7', asset_type, asset_id)), asset_id) AS i FROM assets_fx) s WHERE n <= 50 OR i <= least(round_even(c / n * 50, 0), c)""")
def e4_capped_records(spark, sf_dir):
    """Cells capped at fifty records by class share."""
    return sampling.proportional_sample(assets(spark, sf_dir), ["region"], 50, seed=7).select("asset_id")


@query("""SELECT sector AS cell, count(*) AS n FROM (SELECT sector, asset_id FROM assets_fx WHERE sector = 'water' UNION ALL SELECT sector, asset_id FROM assets_fx WHERE sector <> 'water') u GROUP BY sector""")
def f1_cells_together(spark, sf_dir):
    a = assets(spark, sf_dir).select("sector", "asset_id")
    both = a.filter("sector = 'water'").unionByName(a.filter("sector <> 'water'"))
    return both.groupBy(F.col("sector").alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT pos, CASE WHEN pos % 2 = 0 AND pos % 3 = 0 THEN 'kept' WHEN pos % 2 = 0 THEN 'missing' ELSE 'orphan' END AS part FROM assets_fx WHERE pos % 2 = 0 OR pos % 3 = 0")
def f2_set_parts(spark, sf_dir):
    """Ids in both, only in the table, only among the tiles."""
    a = assets(spark, sf_dir).select("pos")
    table, have = a.filter("pos % 2 = 0"), a.filter("pos % 3 = 0")
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(table.intersect(have), "kept").union(part(table.exceptAll(have), "missing")).union(part(have.exceptAll(table), "orphan"))


@query(f"SELECT asset_id FROM ({_RANDOM}) r WHERE split = 'train' AND pos % 29 = 0")
def f3_split_overlap(spark, sf_dir):
    """Ids in both train and test: some train rows were put into test too."""
    s = sampling.random_split(assets(spark, sf_dir), ["region"])
    test = s.filter("split = 'test'").unionByName(s.filter("pos % 29 = 0"))
    return s.filter("split = 'train'").select("asset_id").intersect(test.select("asset_id"))


@query(f"""WITH u AS (SELECT asset_type AS name, count(*) AS n FROM ({CLASSIFIED}) c WHERE asset_type IS NOT NULL GROUP BY asset_type)
  SELECT name, 'unknown' AS rule FROM u WHERE name LIKE 'water.%' UNION ALL SELECT name, 'radius' FROM u WHERE n % 2 = 0 AND name NOT LIKE 'water.%'
  UNION ALL SELECT name, 'sector' FROM u WHERE n % 3 = 0 AND name NOT LIKE 'water.%' UNION ALL SELECT name, 'unique_name' FROM u WHERE n % 5 = 0 AND name NOT LIKE 'water.%'""")
def j1_registry_gate(spark, sf_dir):
    """Rules that a registry breaks and elements' classes that it lacks; what is wrong with it depends on the elements.

    The classes of water are left out; a class gets a negative radius, a wrong sector or a second row by its elements' number.
    """
    used = elements(spark, sf_dir).select(tags.best_class(F.col("tags"), F.col("osm_type"), F.col("area_m2")).alias("name"))
    used = used.filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    table = ontology.registry(spark).filter("not startswith(name, 'water.')").join(used, "name", "left").fillna({"n": 1})
    table = table.withColumn("radius_m", F.when(F.col("n") % 2 == 0, -F.col("radius_m")).otherwise(F.col("radius_m")))
    table = table.withColumn("sector", F.when(F.col("n") % 3 == 0, "sea").otherwise(F.col("sector")))
    unknown = used.join(table, "name", "left_anti").select("name", F.lit("unknown").alias("rule"))
    twice = ontology.violations(table.unionByName(table.filter("n % 5 = 0"))).filter("rule = 'unique_name'")
    return ontology.violations(table).unionByName(twice).unionByName(unknown)


@query("""WITH f AS (SELECT model, round(avg(val_f1), 6) AS f1, round(avg(time_s), 6) AS time FROM epochs_fx GROUP BY model)
  SELECT model, 'f1' AS value, f1 AS found, f1 + 1e-2 AS expected FROM f WHERE model = 'm1' UNION ALL SELECT model, 'time', time, time + 1e-6 FROM f WHERE model = 'm2'
  UNION ALL SELECT 'm9', 'f1', NULL, 5e-1 UNION ALL SELECT model, 'time', time, NULL FROM f WHERE model = 'm3'""")
def j6_tolerances(spark, sf_dir):
    """Values off by more than the tolerance of their metric, expected ones that are missing, found ones that weren't expected."""
    f = view(spark, sf_dir, "epochs_fx").groupBy("model").agg(F.round(F.avg("val_f1"), 6).alias("f1"), F.round(F.avg("time_s"), 6).alias("time"))
    f1 = f.withColumn("f1", F.col("f1") + F.when(F.col("model") == "m1", 1e-2).when(F.col("model") == "m0", 1e-4).otherwise(0.0)).select("model", "f1")
    f1 = f1.union(spark.createDataFrame([("m9", 0.5)], "model string, f1 double"))
    time = f.filter("model <> 'm3'").withColumn("time", F.col("time") + F.when(F.col("model") == "m2", 1e-6).otherwise(0.0))
    off = lambda want, value, tolerance: metrics.out_of_tolerance(f, want, ["model"], value, tolerance).select("model", F.lit(value).alias("value"), "found", "expected")
    return off(f1, "f1", 5e-4).union(off(time, "time", 1e-9))


_CONDITIONS = [*gate.conditions(), ("Other", "LP", "1.0x")]
_LISTED = ", ".join(f"({i}, '{m}', '{p}', '{s}')" for i, (m, p, s) in enumerate(_CONDITIONS))
_SECTORS = list(gate.SECTOR_ROWS)


@query(f"""WITH l(i, model, protocol, scale) AS (VALUES {_LISTED}),
  c AS (SELECT i, model, protocol, scale, CASE i WHEN 7 THEN 12 ELSE 13 END AS entries, avg(p_retailprice) / 1e4 AS mean, stddev_pop(p_retailprice) / 1e4 AS std, avg(p_size) / 1e2 AS f1, stddev_pop(p_size) / 1e2 AS f1_std
    FROM l JOIN part ON p_partkey % 31 = i WHERE i <> 11 GROUP BY i, model, protocol, scale),
  f AS (SELECT 'condition' AS scope, model, protocol, scale, 'entries' AS metric, 'n' AS field, CAST(entries AS DOUBLE) AS found, i FROM c
    UNION ALL SELECT 'condition', model, protocol, scale, 'rows.' || CASE p_size % 4 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SECTORS))} END, 'n', CAST(count(*) AS DOUBLE), i FROM l JOIN part ON p_partkey % 31 = i WHERE i <> 11 GROUP BY ALL
    UNION ALL SELECT 'condition', model, protocol, scale, 'accuracy', 'mean', mean, i FROM c UNION ALL SELECT 'condition', model, protocol, scale, 'accuracy', 'std', std, i FROM c
    UNION ALL SELECT 'condition', model, protocol, scale, 'macro_f1', 'mean', f1, i FROM c UNION ALL SELECT 'condition', model, protocol, scale, 'macro_f1', 'std', f1_std, i FROM c
    UNION ALL SELECT 'meta', '', '', '', 'test_n_per_seed', 'n', CAST(count(*) AS DOUBLE), -1 FROM part UNION ALL SELECT 'meta', '', '', '', 'conditions', 'n', CAST(count(*) AS DOUBLE), -1 FROM c),
  e AS (SELECT 'condition' AS scope, model, protocol, scale, 'entries' AS metric, 'n' AS field, 13e0 AS expected, 5e-1 AS tolerance FROM l WHERE i < 30
    UNION ALL SELECT 'condition', '{gate.LOOKED_INTO[0]}', '{gate.LOOKED_INTO[1]}', '{gate.LOOKED_INTO[2]}', 'rows.' || s, 'n', n, 5e-1 FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in gate.SECTOR_ROWS.items())}) t(s, n)
    UNION ALL SELECT 'meta', '', '', '', m, 'n', n, 5e-1 FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in {**gate.CONSTANTS, "conditions": 30}.items())}) t(m, n)
    UNION ALL SELECT scope, model, protocol, scale, metric, field, CASE WHEN i % 10 <> 3 THEN found + CASE metric WHEN 'accuracy' THEN (i % 3) * 4e-4 ELSE CASE WHEN i % 5 = 0 THEN 1e-6 ELSE 0 END END END,
      CASE metric WHEN 'accuracy' THEN 5e-4 ELSE 1e-9 END FROM f WHERE field IN ('mean', 'std') AND i < 30),
  j AS (SELECT coalesce(e.scope, f.scope) AS scope, coalesce(e.model, f.model) AS model, coalesce(e.protocol, f.protocol) AS protocol, coalesce(e.scale, f.scale) AS scale, coalesce(e.metric, f.metric) AS metric, coalesce(e.field, f.field) AS field,
    found, expected, tolerance, e.scope IS NOT NULL AS ruled FROM f FULL JOIN e ON e.scope = f.scope AND e.model = f.model AND e.protocol = f.protocol AND e.scale = f.scale AND e.metric = f.metric AND e.field = f.field),
  v AS (SELECT *, CASE WHEN NOT ruled THEN CASE WHEN metric = 'entries' THEN 'unlisted' ELSE 'ok' END WHEN expected IS NULL THEN CASE WHEN found IS NULL THEN 'ok' ELSE 'unexpected' END
    WHEN found IS NULL THEN 'missing' WHEN abs(found - expected) < tolerance THEN 'ok' ELSE 'off' END AS verdict FROM j)
  SELECT scope, model, protocol, scale, metric, field, round(found, 6) AS found, round(expected, 6) AS expected, verdict FROM v WHERE verdict <> 'ok'""")
def j6_results_gate(spark, sf_dir):
    """Constraints that a results document breaks: thirty conditions of thirteen entries, constants, values and absent ones.

    The document is made from the parts: a condition is missing, one has twelve entries, one isn't listed, values are off.
    """
    listed = F.broadcast(spark.createDataFrame([(i, *c) for i, c in enumerate(_CONDITIONS)], "i int, model string, protocol string, scale string"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 31).cast("int").alias("i"), F.col("p_retailprice").cast("double").alias("price"), "p_size")
    rows = parts.filter("i <> 11").join(listed, "i")
    sector = F.element_at(F.array(*(F.lit(x) for x in _SECTORS)), (F.col("p_size") % 4 + 1).cast("int"))
    sectors = rows.groupBy("i", sector.alias("sector")).agg(F.count("*").alias("n")).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("sector", "n"))).alias("sector_rows"))
    value = lambda c, by: F.struct((F.avg(c) / by).alias("mean"), (F.stddev_pop(c) / by).alias("std"))
    found = rows.groupBy("i", "model", "protocol", "scale").agg(F.create_map(F.lit("accuracy"), value("price", 1e4), F.lit("macro_f1"), value("p_size", 1e2)).alias("values"))
    found = found.join(sectors, "i").withColumn("entries", F.when(F.col("i") == 7, 12).otherwise(13))
    meta = parts.agg(F.count("*").alias("value")).select(F.lit("test_n_per_seed").alias("name"), "value")
    measured = gate.measures(found, meta)
    wanted = measured.filter("field in ('mean', 'std')").join(listed, ["model", "protocol", "scale"]).filter("i < 30")
    shift = F.when(F.col("metric") == "accuracy", F.col("i") % 3 * 4e-4).otherwise(F.when(F.col("i") % 5 == 0, 1e-6).otherwise(0.0))
    wanted = wanted.withColumn("expected", F.when(F.col("i") % 10 != 3, F.col("value") + shift)).withColumn("tolerance", F.when(F.col("metric") == "accuracy", 5e-4).otherwise(1e-9))
    rules = gate.constraints(spark, wanted.select("model", "protocol", "scale", "metric", "field", "expected", "tolerance"))
    out = gate.judged(measured, rules).filter("verdict <> 'ok'")
    return out.withColumn("found", F.round("found", 6)).withColumn("expected", F.round("expected", 6))


@query("SELECT count(*) AS n FROM attempts_fx WHERE NOT passed AND asset_id % 50 = 0")
def j7_antijoin_sanity(spark, sf_dir):
    """Failed assets that are among the kept ones after all: those whose kept row came late."""
    from cartolith.operators import reconcile

    a = view(spark, sf_dir, "attempts_fx")
    kept = a.filter("passed")
    lost = reconcile.failed(a, kept, ["region", "sector"])
    late = a.filter("passed or asset_id % 50 = 0")
    return lost.join(late.select(F.col("asset_id").cast("string").alias("asset_id")), "asset_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT region, sector, count(*) AS n, 60 AS target FROM assets_fx GROUP BY region, sector HAVING count(*) - 60 > 14")
def j10_cell_overshoot(spark, sf_dir):
    """Cells that exceed their target by more rows than there are classes."""
    a = assets(spark, sf_dir)
    targets = a.select("region", "sector").distinct().withColumn("target", F.lit(60))
    return queue.cell_overshoot(a, targets, len(ontology.CLASSES))
