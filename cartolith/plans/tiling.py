"""Queries: tiles, triage, scenes, yields, footprints, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.operators import reconcile, tiles
from cartolith.plans.queries import query

# One band of 8 x 8 pixels from an embedding; small values are empty pixels.
_PIX = "list_transform(embedding, lambda x: CASE WHEN x < -2e-1 THEN 0e0 ELSE CAST(CAST(floor((CAST(x AS DOUBLE) + 0.5e0) * 180) AS INT) AS DOUBLE) END)"


def _tiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = F.transform("embedding", lambda x: F.when(x.cast("double") < -0.2, 0.0).otherwise(F.floor((x.cast("double") + 0.5) * 180).cast("double")))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("energy.transmission.substation", "energy.generation.solar_farm", "water.wastewater.plant"))), F.col("label") % 3 + 1)
    image = F.when(F.col("vec_id") % 25 != 0, F.struct(F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("data")))
    return e.select(F.col("vec_id").cast("string").alias("asset_id"), kind.alias("asset_type"), F.array(F.lit("sentinel1")).alias("modalities"), image.alias("image"), "vec_id")


_STATS = f"""SELECT vec_id, label, vec_id % 25 <> 0 AS has_image, p, list_avg(p) AS mean, len(list_filter(p, lambda x: x <> 0)) / 64 AS valid, list_avg(list_filter(p, lambda x: x <> 0)) AS good
  FROM (SELECT vec_id, label, {_PIX} AS p FROM embeddings) e"""


def _large(spark, sf_dir):
    """The tiles with every pixel five times as wide and high, or twice; some without a first row, radar or optical."""
    t = _tiles(spark, sf_dir)
    times = F.when(F.col("vec_id") % 7 == 0, 2).otherwise(5)
    old = F.transform("image.data", lambda x, i: F.when((F.col("vec_id") % 11 == 0) & (i < 8), 0.0).otherwise(x))
    side = times * 8
    at = lambda i: (F.floor(i / side / times) * 8 + F.floor(i % side / times)).cast("int")
    # the old pixels as the one element of an array, so that they are made once and not for each new pixel
    data = F.transform(F.array(old), lambda q: F.transform(F.sequence(F.lit(0), side * side - 1), lambda i: F.get(q, at(i))))[0]
    image = F.when(F.col("image").isNotNull(), F.struct(F.lit(1).alias("c"), side.alias("h"), side.alias("w"), data.alias("data")))
    return t.withColumn("modalities", F.array(F.when(F.col("vec_id") % 3 == 0, "sentinel1").otherwise("naip"))).withColumn("image", image)


_EMPTY = "len(list_filter({x}, lambda v: v = 0)) / 8"
_SIDES = [f"q[{8 * r + 1}:{8 * r + 8}]" for r in (0, 7)] + [f"[{', '.join(f'q[{8 * r + c + 1}]' for r in range(8))}]" for c in (0, 7)]
_EDGE = f"greatest({', '.join(_EMPTY.format(x=x) for x in _SIDES)})"
# a strip of five pixels is the first row of a tile that was widened five times; of one widened twice it is two and a half
_NEXT = [[f"q[{8 * r + 1}:{8 * r + 8}]" for r in rows] for rows in ((0, 1, 2), (7, 6, 5))]
_NEXT += [[f"[{', '.join(f'q[{8 * r + c + 1}]' for r in range(8))}]" for c in columns] for columns in ((0, 1, 2), (7, 6, 5))]
_WIDE = f"greatest({', '.join('(' + ' + '.join(f'{w} * {_EMPTY.format(x=x)}' for w, x in zip((2, 2, 1), side)) + ') / 5' for side in _NEXT)})"
_QC = f"""SELECT vec_id, has_image, round(valid, 6) AS valid_ratio, round(coalesce(good, 0), 6) AS mean_value, CASE WHEN NOT has_image THEN 'fail_no_image' WHEN valid < 0.8e0 THEN 'fail_valid_pixels'
    WHEN edge > 0.9e0 THEN 'fail_edge_artifacts' WHEN vec_id % 7 = 0 THEN 'fail_min_size' WHEN coalesce(good, 0) = 0 OR CASE WHEN vec_id % 3 = 0 THEN good NOT BETWEEN -28 AND 5 ELSE good NOT BETWEEN 15 AND 220 END THEN 'fail_value_range' ELSE 'pass' END AS status
  FROM (SELECT *, len(list_filter(q, lambda x: x <> 0)) / 64 AS valid, list_avg(list_filter(q, lambda x: x <> 0)) AS good, CASE WHEN vec_id % 7 = 0 THEN {_WIDE} ELSE {_EDGE} END AS edge
    FROM (SELECT vec_id, has_image, list_transform(p, lambda x, i: CASE WHEN vec_id % 11 = 0 AND i <= 8 THEN 0 ELSE x END) AS q FROM ({_STATS}) s) t) u"""


@query(f"SELECT CAST(vec_id AS VARCHAR) AS asset_id, status, CASE WHEN has_image THEN valid_ratio END AS valid_ratio, CASE WHEN has_image THEN mean_value END AS mean_value FROM ({_QC}) q")
def g8_quality_checks(spark, sf_dir):
    """Status of each tile."""
    v = tiles.qc_verdict(tiles.measured(_large(spark, sf_dir)))
    return v.select("asset_id", "status", F.round("qc.valid_ratio", 6).alias("valid_ratio"), F.round("qc.mean_value", 6).alias("mean_value"))


@query(f"SELECT status, count(*) AS n FROM ({_QC}) q GROUP BY status")
def d6_b33_qc_summary(spark, sf_dir):
    """Tiles by the outcome of the checks."""
    return tiles.qc_verdict(tiles.measured(_large(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n"))


# one band is all three, so both ratios are the share of pixels that aren't empty
_STEPS = " + ".join(f"(list_sum(list_transform(range({n}), lambda i: abs(p[{at.format(x='i')} + {step}] - p[{at.format(x='i')}]))) / {n})" for n, at, step in (
    (56, "(i // 7) * 8 + i % 7 + 1", 1), (56, "{x} + 1", 8))).replace("i // 7", "CAST(floor(i / 7) AS BIGINT)")
_MIDDLE = "list_avg([" + ", ".join(f"p[{8 * r + c + 1}]" for r in range(2, 6) for c in range(2, 6)) + "])"
_SIGNALS = f"""SELECT vec_id, label, has_image, mean AS mean_brightness, list_stddev_pop(p) AS std_brightness, valid AS rg_ratio, valid AS rb_ratio, {_STEPS} AS texture, valid AS valid_ratio,
  {_MIDDLE} AS center_brightness, {_MIDDLE} / greatest(mean, 1) AS center_vs_full FROM ({_STATS}) s"""


@query("SELECT CAST(vec_id AS VARCHAR) AS asset_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in tiles.SIGNALS) + f" FROM ({_SIGNALS}) s WHERE has_image")
def g9_triage_signals(spark, sf_dir):
    m = tiles.measured(_tiles(spark, sf_dir)).filter("has_image")
    return m.select("asset_id", *(F.round(f"signals.{c}", 6).alias(c) for c in tiles.SIGNALS))


_KIND = "['energy.transmission.substation', 'energy.generation.solar_farm', 'water.wastewater.plant'][label % 3 + 1]"
_TRIAGE = f"""SELECT *, {_KIND} AS asset_type, list_sort(list_filter(CASE label % 3
    WHEN 0 THEN [CASE WHEN texture NOT BETWEEN 8 AND 9999 THEN printf('texture=%.2f outside [8.0, 9999.0]', round(texture, 2)) END, CASE WHEN mean_brightness NOT BETWEEN 20 AND 210 THEN printf('mean_brightness=%.2f outside [20.0, 210.0]', round(mean_brightness, 2)) END]
    WHEN 1 THEN [CASE WHEN mean_brightness NOT BETWEEN 10 AND 180 THEN printf('mean_brightness=%.2f outside [10.0, 180.0]', round(mean_brightness, 2)) END, CASE WHEN rg_ratio NOT BETWEEN 0.5e0 AND 1.5e0 THEN printf('rg_ratio=%.2f outside [0.5, 1.5]', round(rg_ratio, 2)) END]
    ELSE [CASE WHEN mean_brightness NOT BETWEEN 15 AND 220 THEN printf('mean_brightness=%.2f outside [15.0, 220.0]', round(mean_brightness, 2)) END, CASE WHEN valid_ratio NOT BETWEEN 0.8e0 AND 1e0 THEN printf('valid_ratio=%.2f outside [0.8, 1.0]', round(valid_ratio, 2)) END] END,
    lambda x: x IS NOT NULL)) AS why FROM ({_SIGNALS}) s"""
_VERDICT = f"""SELECT CAST(vec_id AS VARCHAR) AS asset_id, asset_type, CASE WHEN NOT has_image OR len(why) >= 3 THEN 'contradiction' WHEN len(why) >= 1 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN has_image THEN len(why) ELSE 0 END AS failures, CASE WHEN NOT has_image THEN 'No image available' WHEN len(why) = 0 THEN 'All signals within expected range' ELSE len(why) || ' signal(s): ' || array_to_string(why, '; ') END AS reason FROM ({_TRIAGE}) t"""


@query(f"SELECT asset_id, confidence, confidence = 'low' AS flag_for_human, failures, reason FROM ({_VERDICT}) v")
def g10_triage_verdicts(spark, sf_dir):
    """Confidence of each tile and why."""
    return tiles.triage(tiles.measured(_tiles(spark, sf_dir))).select("asset_id", "confidence", "flag_for_human", "failures", "reason")


@query(f"SELECT asset_type, confidence, count(*) AS n FROM ({_VERDICT}) v GROUP BY ALL")
def d7_triage_counts(spark, sf_dir):
    """Tiles by class and confidence."""
    return tiles.triage(tiles.measured(_tiles(spark, sf_dir))).groupBy("asset_type", "confidence").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT vec_id, [0, 1, 2, 3] AS b, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1e2) AS v FROM embeddings WHERE vec_id % 6 <> 0)
  SELECT vec_id, round(list_sum(list_transform(v[49:64], lambda x: (least(0e0, greatest(-25e0, x)) + 25) / 25)), 6) AS first, round(list_sum(list_transform(v[17:32], lambda x: (least(0e0, greatest(-25e0, x)) + 25) / 25)), 6) AS third FROM d""")
def g7_bands(spark, sf_dir):
    """Tiles of four bands, the fourth and second of them in this order with an empty one between, clipped and rescaled; of two bands: dropped."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    few = F.col("vec_id") % 6 == 0
    data = F.transform("embedding", lambda x: x.cast("double") * 100.0)
    image = F.struct(F.when(few, 2).otherwise(4).alias("c"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.when(few, F.slice(data, 1, 32)).otherwise(data).alias("data"))
    t = tiles.with_bands(e.select("vec_id", image.alias("image")), [3, None, 1])
    t = t.withColumn("scaled", tiles.rescaled(F.col("image.data"), -25.0, 0.0))
    total = lambda at: F.round(F.aggregate(F.slice("scaled", at, 16), F.lit(0.0), lambda a, x: a + x), 6)
    return t.select("vec_id", total(1).alias("first"), total(33).alias("third"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(10e0, greatest(-30e0, CASE WHEN x > 0 THEN 10 * log10(CAST(x AS DOUBLE)) ELSE -30e0 END)))), 4) AS sar,
  round(list_sum(list_transform(embedding, lambda x: least(350e0, greatest(200e0, CAST(x AS DOUBLE) * 0.00341802e0 + 149e0)))), 4) AS thermal,
  list_sum(list_transform(embedding, lambda x: floor(least(255e0, greatest(0e0, CAST(x AS DOUBLE) * 255e0))))) AS optical,
  list_sum(list_transform(embedding, lambda x: floor(least(255e0, greatest(0e0, CAST(x AS DOUBLE) * 32768e0 * (1 / 1e4) * 255e0))))) AS counts FROM embeddings""")
def g4_normalise(spark, sf_dir):
    """Sums of scaled pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("d", F.col("embedding").cast("array<double>"))
    total = lambda kind: F.round(F.aggregate(tiles.normalised(F.col("d"), kind), F.lit(0.0), lambda a, x: a + x), 4)
    plain = lambda c: F.aggregate(tiles.normalised(c, "optical").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    counts = F.transform("d", lambda x: x * 32768.0)  # over 1: reflectance in ten thousandths
    return e.select("vec_id", total("sar").alias("sar"), total("thermal").alias("thermal"), plain(F.col("d")).alias("optical"), plain(counts).alias("counts"))


@query("""SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0""")
def b32_finite_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))).select("vec_id")


@query("SELECT count(*) AS n, round(min(CAST(x AS DOUBLE)), 6) AS least, round(max(CAST(x AS DOUBLE)), 6) AS most, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std FROM (SELECT unnest(embedding) AS x FROM embeddings) e")
def d38_embedding_ranges(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.agg(F.count("x").alias("n"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def attempts(spark, sf_dir):
    return view(spark, sf_dir, "attempts_fx").withColumn("accepted", F.col("passed") & (F.col("asset_id") % 2 == 0))


_PCT = "round(1e2 * {a} / nullif({b}, 0), 2)"


@query(f"""SELECT region, extracted, n_fetched, n_passed, n_accepted, {_PCT.format(a='n_fetched', b='extracted')} AS fetch_pct, {_PCT.format(a='n_passed', b='n_fetched')} AS qc_pct, {_PCT.format(a='n_accepted', b='extracted')} AS overall_pct FROM (
  SELECT region, count(*) AS extracted, count(*) FILTER (fetched) AS n_fetched, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed AND asset_id % 2 = 0) AS n_accepted FROM attempts_fx GROUP BY region) f""")
def d8_funnel(spark, sf_dir):
    return reconcile.funnel(attempts(spark, sf_dir), ["region"])


@query("SELECT region, sector, CAST(asset_id AS VARCHAR) AS asset_id FROM attempts_fx WHERE NOT (passed AND asset_id % 2 = 0)")
def c13_failed_assets(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return reconcile.failed(a, a.filter("accepted"), ["region", "sector"]).select("region", "sector", "asset_id")


@query("""WITH c AS (SELECT region, sector, CAST(floor(asset_id / 64) AS BIGINT) AS part, count(*) AS n, count(*) FILTER (fetched OR asset_id % 9 <> 0) AS done, count(*) FILTER (fetched) AS ok FROM attempts_fx GROUP BY ALL)
  SELECT region, sector, part, n AS tiles, CASE WHEN n = done THEN ok END AS n_ok FROM c""")
def a14_completion(spark, sf_dir):
    """Cells with their completion markers; cells that a next run has to do have none."""
    a = attempts(spark, sf_dir).withColumn("part", F.floor(F.col("asset_id") / 64).cast("long"))
    status = F.when(F.col("fetched"), "ok").when(F.col("asset_id") % 9 != 0, "failed")
    cell = ["region", "sector", "part"]
    markers = reconcile.marked_complete(a.select(*cell, status.alias("status")), cell)
    cells = a.groupBy(*cell).agg(F.count("*").alias("tiles"))
    open_ = reconcile.skip_done(cells, markers, cell).withColumn("n_ok", F.lit(None).cast("long"))
    return cells.join(markers.drop("n"), cell).unionByName(open_)


@query("SELECT region, sector, asset_id, sector <> 'water' AS first FROM attempts_fx WHERE sector <> 'telecom'")
def a8_fallback_input(spark, sf_dir):
    """Rows of cells that the first input has, and of the others from the second: the first lacks water."""
    a = attempts(spark, sf_dir).select("region", "sector", "asset_id").filter("sector <> 'telecom'")
    first = a.filter("sector <> 'water'").withColumn("first", F.lit(True))
    return reconcile.with_fallback(first, a.withColumn("first", F.lit(False)), ["region", "sector"])


@query("SELECT asset_id FROM attempts_fx WHERE NOT fetched")
def c14_pending(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return reconcile.pending(a, a.filter("fetched")).select("asset_id")


@query("""WITH a AS (SELECT floor(lat / 5) * 5 AS lat0, floor(lon / 5) * 5 AS lon0, count(*) AS attempted, count(*) FILTER (passed) AS kept FROM attempts_fx GROUP BY ALL)
  SELECT *, round(1e2 * kept / attempted, 2) AS yield_pct FROM a WHERE attempted >= 10""")
def d9_c19_yield_grid(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return reconcile.yield_grid(a, a.filter("passed"), 5.0, 10)


@query("SELECT CASE WHEN lat >= -60 AND lat < -23 THEN 'south' WHEN lat < 23 THEN 'tropics' WHEN lat < 66 THEN 'north' END AS band, count(*) AS n FROM attempts_fx WHERE lat >= -60 AND lat < 66 GROUP BY 1")
def d10_bands(spark, sf_dir):
    return reconcile.bands(attempts(spark, sf_dir), "lat", [("south", -60.0, -23.0), ("tropics", -23.0, 23.0), ("north", 23.0, 66.0)])


@query("SELECT modality, count(*) AS n FROM (SELECT unnest(string_split(modalities, '+')) AS modality FROM attempts_fx) m GROUP BY modality")
def d5_modality_counts(spark, sf_dir):
    return reconcile.modality_counts(attempts(spark, sf_dir))


@query("""WITH t AS (SELECT asset_id FROM attempts_fx WHERE fetched), i AS (SELECT asset_id FROM attempts_fx WHERE asset_id % 5 <> 0)
  SELECT coalesce(t.asset_id, i.asset_id) AS asset_id, CASE WHEN t.asset_id IS NOT NULL AND i.asset_id IS NOT NULL THEN 'kept' WHEN i.asset_id IS NOT NULL THEN 'orphan' ELSE 'missing' END AS status FROM t FULL JOIN i ON t.asset_id = i.asset_id""")
def c17_reconcile(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return reconcile.reconciled(a.filter("fetched"), a.filter("asset_id % 5 <> 0"))


@query("""SELECT region, max_by(lat, asset_id) FILTER (fetched) AS lat, max_by(sector, asset_id) FILTER (passed) AS sector FROM attempts_fx GROUP BY region""")
def a15_run_log(spark, sf_dir):
    """The latest value given for each field of each region."""
    a = attempts(spark, sf_dir)
    log = a.select("region", F.col("asset_id").alias("seq"), F.when(F.col("fetched"), F.col("lat")).alias("lat"), F.when(F.col("passed"), F.col("sector")).alias("sector"))
    return reconcile.run_log(log, ["lat", "sector"])


@query("""SELECT asset_id, max_by(sector, seq) AS sector, max(seq) AS seq FROM (SELECT asset_id, sector, 0 AS seq FROM attempts_fx UNION ALL SELECT asset_id, 'retry', 1 FROM attempts_fx WHERE NOT fetched) u GROUP BY asset_id""")
def f5_retry_union(spark, sf_dir):
    a = attempts(spark, sf_dir)
    old = a.select("asset_id", "sector", F.lit(0).alias("seq"))
    new = a.filter("not fetched").select("asset_id", F.lit("retry").alias("sector"), F.lit(1).alias("seq"))
    return reconcile.latest_results(old, new)


@query("""SELECT asset_id, item_id, cloud, cloud <= 20 AS below_limit FROM (SELECT a.asset_id, s.item_id, coalesce(s.cloud_cover, 100e0) AS cloud,
    row_number() OVER (PARTITION BY a.asset_id ORDER BY coalesce(s.cloud_cover, 100e0), s.scene_rank) AS n FROM assets_fx a JOIN scenes_fx s
    ON a.lon - 3e-3 <= s.maxx AND a.lon + 3e-3 >= s.minx AND a.lat - 3e-3 <= s.maxy AND a.lat + 3e-3 >= s.miny
    WHERE s.taken >= TIMESTAMP '1996-01-01' AND s.taken < TIMESTAMP '1998-01-01' AND s.platform = 'landsat-8') x WHERE n = 1""")
def c18_best_scenes(spark, sf_dir):
    """The least cloudy scene over each asset's tile."""
    a = view(spark, sf_dir, "assets_fx").select("asset_id", (F.col("lon") - 3e-3).alias("minx"), (F.col("lon") + 3e-3).alias("maxx"), (F.col("lat") - 3e-3).alias("miny"), (F.col("lat") + 3e-3).alias("maxy"))
    return tiles.best_scenes(a, view(spark, sf_dir, "scenes_fx"), "1996-01-01", "1998-01-01", "landsat-8")


@query("""WITH r AS (SELECT *, CASE WHEN pos % 6 = 0 THEN ['naip'] WHEN pos % 6 < 4 THEN ['sentinel2_ms', 'naip'] ELSE ['sentinel1'] END AS m, pos % 3 AS t, CASE WHEN pos % 5 = 0 THEN '4x600x600' ELSE '7x60x60' END AS shape FROM assets_fx)
  SELECT count(*) AS n_tiles, list_sort(list(DISTINCT asset_type)) AS asset_types, list_sort(list(DISTINCT sector)) AS sources, (SELECT list_sort(list(DISTINCT x)) FROM (SELECT unnest(m) AS x FROM r) u) AS modalities,
  (SELECT list(c ORDER BY c) FROM (SELECT array_to_string(m, '+') || ':' || count(*) AS c FROM r GROUP BY array_to_string(m, '+')) v) AS combinations, list_sort(list(DISTINCT shape)) AS shapes, bool_or(t > 1) AS has_temporal,
  round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM r""")
def d3_d4_manifest_rollup(spark, sf_dir):
    part = F.col("pos") % 6
    names = F.when(part == 0, F.array(F.lit("naip"))).when(part < 4, F.array(F.lit("sentinel2_ms"), F.lit("naip"))).otherwise(F.array(F.lit("sentinel1")))
    shape = F.when(F.col("pos") % 5 == 0, "4x600x600").otherwise("7x60x60")
    a = view(spark, sf_dir, "assets_fx").select("asset_type", F.col("sector").alias("source"), names.alias("modalities"), (F.col("pos") % 3).alias("n_timesteps"), shape.alias("shape"), "lat", "lon")
    r = tiles.manifest_rollup(a)
    return r.select(*(F.round(c, 6).alias(c) if c[:4] in ("min_", "max_") else c for c in r.columns))


@query("""SELECT year, season, start, stop, row_number() OVER (ORDER BY year, season DESC) - 1 AS place FROM (SELECT DISTINCT CAST(year(ts) AS INT) - y AS year FROM events, (VALUES (0), (1)) v(y)) e,
  (VALUES (0, '01-01', '03-31'), (1, '04-01', '06-30'), (2, '07-01', '09-30'), (3, '10-01', '12-31')) s(season, a, b), LATERAL (SELECT year || '-' || a AS start, year || '-' || b AS stop) d""")
def e25_seasons(spark, sf_dir):
    """Seasons of the years of the events and of the year before each, the newest year last."""
    years = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.year("ts").alias("last")).distinct()
    return tiles.seasons(years, 2)


@query("""SELECT asset_id, list(frame ORDER BY w) AS frames, max_by(frame, w) AS last_frame FROM (SELECT site AS asset_id, CAST(pos % 4 AS INT) AS w, asset_id AS frame FROM assets_fx) f GROUP BY asset_id""")
def g11_e25_stacks(spark, sf_dir):
    """Four frames of each site in order."""
    a = view(spark, sf_dir, "assets_fx").select(F.col("site").alias("asset_id"), (F.col("pos") % 4).cast("int").alias("window"), F.col("asset_id").alias("frame"))
    out = tiles.stacked(a, 4, packed=True)
    return out.withColumn("frames", F.filter("frames", lambda x: x.isNotNull()))


def _found(spark, sf_dir, rounded=True):
    """Rectangles around assets as closed rings."""
    from cartolith.operators import footprint

    a = view(spark, sf_dir, "assets_fx")
    up, right = (F.col("pos") % 40 + 1) * 1e-4, (F.col("pos") % 25 + 1) * 1e-4
    corner = lambda y, x: F.struct((F.col("lat") + y * up).alias("lat"), (F.col("lon") + x * right).alias("lon"))
    ring = F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))
    rings = F.when(F.col("pos") % 50 != 1, F.array(F.struct(F.lit("outer").alias("role"), ring.alias("pts"))))
    kind = F.split("asset_id", "_")[1]
    return footprint.footprints(a.select("asset_id", "asset_type", kind.alias("osm_type"), "lat", "lon", rings.alias("rings")), rounded)


_RECT = """SELECT asset_id, asset_type, CASE WHEN pos % 3 = 0 THEN 'point' WHEN pos % 50 = 1 THEN 'missing_now' ELSE 'polygon' END AS status,
  2 * (pos % 40 + 1) * 1e-4 * 111320e0 AS h, 2 * (pos % 25 + 1) * 1e-4 * 111320e0 * cos(radians(lat)) AS w FROM assets_fx"""


@query(f"""SELECT asset_id, status, CASE WHEN status = 'polygon' THEN round(w * h / 1000, 0) END AS area, CASE WHEN status = 'polygon' THEN floor((greatest(w, h) + 5e-2) / 10) END AS extent,
  CASE WHEN status = 'polygon' THEN round(least(w, 600) * least(h, 600) / 360000 * 100 + 1e-3, 0) END AS share, CASE WHEN status = 'polygon' THEN w * h - least(w, 600) * least(h, 600) > 1 END AS exceeds_tile FROM ({_RECT}) r""")
def g3_footprints(spark, sf_dir):
    """Area (1000 m2), extent (10 m) and share of the tile (percent) of rectangular footprints."""
    f = _found(spark, sf_dir, rounded=False)
    return f.select("asset_id", "status", F.round(F.col("area_m2") / 1000, 0).alias("area"), F.floor((F.col("extent_m") + 5e-2) / 10).cast("double").alias("extent"), F.round(F.col("tile_share") * 100 + 1e-3, 0).alias("share"), "exceeds_tile")


@query(f"""SELECT asset_type, count(*) AS tiles, round(1e2 * avg(CASE WHEN status = 'point' THEN 1e0 ELSE 0e0 END), 1) AS point_mapped_pct, count(*) FILTER (status = 'polygon') AS with_area,
  round(1e2 * avg(CASE WHEN w * h - least(w, 600) * least(h, 600) > 1 THEN 1e0 ELSE 0e0 END) FILTER (status = 'polygon'), 1) AS exceeds_pct FROM ({_RECT}) r GROUP BY asset_type""")
def d27_footprint_shares(spark, sf_dir):
    from cartolith.operators import footprint

    return footprint.shares(_found(spark, sf_dir)).select("asset_type", "tiles", "point_mapped_pct", "with_area", "exceeds_pct")


@query(f"""SELECT asset_type, count(*) AS n, least(600e0, greatest(160e0, ceil(quantile_cont(round(greatest(w, h), 1), 0.75) * 2 / 10) * 10)) AS proposed_tile_m FROM ({_RECT}) r WHERE status = 'polygon' GROUP BY asset_type""")
def d28_proposed_tiles(spark, sf_dir):
    from cartolith.operators import footprint

    return footprint.proposed_tiles(_found(spark, sf_dir)).select("asset_type", "n", "proposed_tile_m")


_SINE = """(1 - 0.0066943799901413165e0) * (s / (1 - 0.0066943799901413165e0 * s * s) - ln((1 - 0.08181919084262149e0 * s) / (1 + 0.08181919084262149e0 * s)) / (2 * 0.08181919084262149e0)) / 1.995531087388263e0"""
_CORNERS = {k: f"({_SINE.replace('s ', f'sin(radians(lat + {dy})) ').replace('* s)', f'* sin(radians(lat + {dy})))')})" for k, dy in (("a", "0"), ("b", "1e-2"), ("c", "2e-3"), ("d", "6e-3"))}


@query(f"""SELECT asset_id, round(6371007.180918474e0 * 6371007.180918474e0 * radians(1e-2) * ({_CORNERS['b']} - {_CORNERS['a']}) - CASE WHEN pos % 2 = 0 THEN 6371007.180918474e0 * 6371007.180918474e0 * radians(3e-3) * ({_CORNERS['d']} - {_CORNERS['c']}) ELSE 0 END, 0) AS area_m2,
  round(CASE WHEN pos % 2 = 0 THEN (1e-4 * (lat + 5e-3) - 1.2e-5 * (lat + 4e-3)) / 8.8e-5 ELSE lat + 5e-3 END, 5) AS lat, round(CASE WHEN pos % 2 = 0 THEN (1e-4 * (lon + 5e-3) - 1.2e-5 * (lon + 2.5e-3)) / 8.8e-5 ELSE lon + 5e-3 END, 5) AS lon FROM assets_fx""")
def b13_ring_areas(spark, sf_dir):
    """Area on the ellipsoid and planar centroid of squares, half of them with a hole."""
    from cartolith.operators import footprint

    a = view(spark, sf_dir, "assets_fx").select("asset_id", "pos", F.col("lat").alias("y"), F.col("lon").alias("x"))
    at = lambda dy, dx: F.struct((F.col("y") + dy).alias("lat"), (F.col("x") + dx).alias("lon"))
    ring = lambda y0, x0, y1, x1: F.array(at(y0, x0), at(y0, x1), at(y1, x1), at(y1, x0), at(y0, x0))
    part = lambda role, pts: F.struct(F.lit(role).alias("role"), pts.alias("pts"))
    outer, inner = part("outer", ring(0.0, 0.0, 0.01, 0.01)), part("inner", ring(0.002, 0.001, 0.006, 0.004))
    rings = F.when(F.col("pos") % 2 == 0, F.array(outer, inner)).otherwise(F.array(outer))
    out = footprint.area_features(a.withColumn("rings", rings))
    return out.select("asset_id", F.round("area_m2", 0).alias("area_m2"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def _labelled(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = F.col("vec_id") % 20
    split = F.when(part < 14, "train").when(part < 17, "val").otherwise("test")
    return e.select(F.col("vec_id").alias("id"), "label", "embedding", (F.col("vec_id") % 5).alias("fold"), split.alias("split"))


@query()
def h1_out_of_fold_hints(spark, sf_dir):
    """Every row's class by a model of the other folds."""
    from cartolith.operators import probes

    return probes.out_of_fold(_labelled(spark, sf_dir))


@query()
def h2_linear_probe(spark, sf_dir):
    """Test predictions of the best probe."""
    from cartolith.operators import probes

    return probes.probe(_labelled(spark, sf_dir), 10)


@query()
def h2_probe_three_tenths(spark, sf_dir):
    """Test predictions of the best probe that learns from 0.3 of each class's train rows."""
    from cartolith.operators import probes, sampling

    rows = _labelled(spark, sf_dir)
    return probes.probe(sampling.fraction_sample(rows, 0.3, cls="label", key="id"), 10)


@query("""WITH l AS (SELECT asset_id, reviewer, max_by(decision, struct_pack(a := "at", b := line)) AS decision, max_by(label, struct_pack(a := "at", b := line)) AS label FROM decisions_fx GROUP BY asset_id, reviewer),
  s AS (SELECT asset_id, count(*) FILTER (decision <> 'unsure') AS labels, count(DISTINCT label) FILTER (decision <> 'unsure') AS kinds, max(label) FILTER (decision <> 'unsure') AS label, array_to_string(list_sort(list(reviewer)), ',') AS reviewers FROM l GROUP BY asset_id)
  SELECT asset_id, CASE WHEN labels = 0 THEN 'unsure' WHEN kinds = 1 THEN 'done' ELSE 'disputed' END AS status, CASE WHEN labels > 0 AND kinds = 1 THEN label ELSE '' END AS final_label, reviewers FROM s""")
def i1_i2_decision_stream(spark, sf_dir):
    """Status of each asset after the decision log has gone through the stream in files, a file a batch."""
    import uuid

    from cartolith.session import shared_folder
    from cartolith.streaming import decisions

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    view(spark, sf_dir, "decisions_fx").repartition(3).write.json(f"{base}/log")
    run = decisions.keep_status(decisions.read_log(spark, f"{base}/log"), f"{base}/status", f"{base}/checkpoint")
    run.awaitTermination()
    return decisions.current_status(spark, f"{base}/status").withColumn("reviewers", F.array_join("reviewers", ","))
