"""Queries: samples, splits, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.functions import geo
from cartolith.operators import ranking, sampling
from cartolith.plans.queries import query


def draw(seed: int, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}))"


_DRAW = draw(42, "asset_type", "asset_id")
_SHARES = f"""SELECT *, count(*) OVER (PARTITION BY region, asset_type) AS c, count(*) OVER (PARTITION BY region) AS n,
  row_number() OVER (PARTITION BY region, asset_type ORDER BY {_DRAW}, asset_id) AS i FROM assets_fx"""


@query(f"SELECT asset_id FROM ({_SHARES}) s WHERE n <= 120 OR i <= least(round_even(c / n * 120, 0), c)")
def e3_proportional_sample(spark, sf_dir):
    return sampling.proportional_sample(view(spark, sf_dir, "assets_fx"), ["region"], 120).select("asset_id")


@query("""SELECT region, asset_type, c AS in_population, CAST(CASE WHEN n <= 120 THEN c ELSE least(round_even(c / n * 120, 0), c) END AS BIGINT) AS in_sample,
  round(c / n, 6) AS proportion, CASE WHEN n <= 120 THEN 'all (population <= threshold)' WHEN round_even(c / n * 120, 0) <= 0 THEN 'rounded to zero'
  WHEN least(round_even(c / n * 120, 0), c) = c THEN 'all' ELSE 'sampled' END AS note
  FROM (SELECT region, asset_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY region) AS n FROM assets_fx GROUP BY region, asset_type) s""")
def a7_sample_summary(spark, sf_dir):
    return sampling.sample_summary(view(spark, sf_dir, "assets_fx"), ["region"], 120)


@query(f"""SELECT asset_id, i AS draw, c AS class_size FROM (SELECT *, count(*) OVER (PARTITION BY asset_type) AS c,
  row_number() OVER (PARTITION BY asset_type ORDER BY {_DRAW}, asset_id) AS i FROM assets_fx) s WHERE i <= least(c, 100, greatest(20, ceil(c * 0.1e0)))""")
def e7_class_sample(spark, sf_dir):
    return sampling.class_sample(view(spark, sf_dir, "assets_fx")).select("asset_id", "draw", "class_size")


@query(f"""SELECT region, asset_type, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY region, asset_type ORDER BY {_DRAW}, asset_id) AS i FROM assets_fx) s WHERE i <= 3""")
def e5_up_to_n(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx")
    return ranking.top_of_each(a, ["region", "asset_type"], [ranking.draw_key(42, "asset_type", "asset_id"), "asset_id"], 3).select("region", "asset_type", "asset_id")


@query(f"SELECT asset_id FROM assets_fx ORDER BY {draw(42, 'asset_id')}, asset_id LIMIT 50")
def e9_uniform_sample(spark, sf_dir):
    """Fifty assets drawn over all."""
    return sampling.uniform_sample(view(spark, sf_dir, "assets_fx"), 50).select("asset_id")


_RANDOM = f"""SELECT *, CASE WHEN i <= floor(c * 0.7e0) THEN 'train' WHEN i <= floor(c * 0.7e0) + floor(c * 0.15e0) THEN 'val' ELSE 'test' END AS split FROM ({_SHARES}) s"""


@query(f"SELECT asset_id, split FROM ({_RANDOM}) r")
def e12_random_split(spark, sf_dir):
    return sampling.random_split(view(spark, sf_dir, "assets_fx"), ["region"]).select("asset_id", "split")


@query(f"""SELECT asset_id, split FROM (SELECT *, count(*) OVER (PARTITION BY split, asset_type) AS m, row_number() OVER (PARTITION BY split, asset_type ORDER BY {_DRAW}, asset_id) AS j
  FROM ({_RANDOM}) r) t WHERE split <> 'train' OR j <= greatest(1, round_even(m * 0.3e0, 0))""")
def e6_train_fraction(spark, sf_dir):
    split = sampling.random_split(view(spark, sf_dir, "assets_fx"), ["region"])
    return sampling.fraction_sample(split, 0.3).select("asset_id", "split")


def _blocks(spark, sf_dir):
    return geo.spatial_blocks(view(spark, sf_dir, "assets_fx"), 2_000_000.0)


# Blocks of the driver's twin: degrees, as the projection has a query of its own.
_GRID = "CAST(floor(lat / 20e0) AS BIGINT) AS block_id_y, CAST(floor(lon / 20e0) AS BIGINT) AS block_id_x"
_TILES = f"SELECT *, 'b' || block_id_x || '_' || block_id_y AS block_id FROM (SELECT *, {_GRID} FROM assets_fx) g"
_GREEDY = f"""WITH RECURSIVE blocks AS (SELECT region, block_id, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY {draw(42, 'region', 'block_id')}, block_id) AS i
    FROM ({_TILES}) t GROUP BY region, block_id),
  aims AS (SELECT region, 0.7e0 * sum(n) AS ta, 0.15e0 * sum(n) AS va, 0.15e0 * sum(n) AS sa FROM blocks GROUP BY region),
  walk AS (
    SELECT region, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS tr, CAST(0 AS DOUBLE) AS va, CAST(0 AS DOUBLE) AS te, CAST(NULL AS VARCHAR) AS block_id, CAST(NULL AS VARCHAR) AS split FROM aims
    UNION ALL
    SELECT region, i, CASE WHEN split = 'train' THEN tr + n ELSE tr END, CASE WHEN split = 'val' THEN va + n ELSE va END, CASE WHEN split = 'test' THEN te + n ELSE te END, block_id, split
    FROM (SELECT w.region, b.i, w.tr, w.va, w.te, b.block_id, b.n,
            CASE WHEN a.ta - w.tr >= a.va - w.va AND a.ta - w.tr >= a.sa - w.te THEN 'train' WHEN a.va - w.va >= a.sa - w.te THEN 'val' ELSE 'test' END AS split
          FROM walk w JOIN blocks b ON b.region = w.region AND b.i = w.i + 1 JOIN aims a ON a.region = w.region) s),
  given AS (SELECT block_id, max_by(split, region) AS split FROM walk WHERE block_id IS NOT NULL GROUP BY block_id)"""


def _degree_blocks(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx")
    a = a.withColumn("block_id_x", F.floor(F.col("lon") / 20.0)).withColumn("block_id_y", F.floor(F.col("lat") / 20.0))
    return a.withColumn("block_id", F.concat(F.lit("b"), "block_id_x", F.lit("_"), "block_id_y"))


@query(f"{_GREEDY} SELECT asset_id, t.block_id, g.split FROM ({_TILES}) t JOIN given g ON g.block_id = t.block_id")
def e10_block_split(spark, sf_dir):
    """Whole blocks to train, val and test, the largest shortfall first."""
    return sampling.block_split(_degree_blocks(spark, sf_dir)).select("asset_id", "block_id", "split")


@query(f"""{_GREEDY} SELECT asset_id, CASE WHEN asset_type = 'transport.train_station' THEN CASE WHEN i <= floor(c * 0.7e0) THEN 'train' WHEN i <= floor(c * 0.7e0) + floor(c * 0.15e0) THEN 'val' ELSE 'test' END
    ELSE g.split END AS split, CASE WHEN asset_type = 'transport.train_station' THEN 'class_fallback' ELSE 'spatial_block' END AS split_protocol
  FROM (SELECT *, count(*) OVER (PARTITION BY asset_type) AS c, row_number() OVER (PARTITION BY asset_type ORDER BY {_DRAW}, asset_id) AS i FROM ({_TILES}) t) t JOIN given g ON g.block_id = t.block_id""")
def e11_class_fallback(spark, sf_dir):
    split = sampling.class_fallback(sampling.block_split(_degree_blocks(spark, sf_dir)), ["transport.train_station"])
    return split.select("asset_id", "split", "split_protocol")


_FALLBACK = f"""SELECT asset_id, asset_type, t.block_id, CASE WHEN asset_type = 'transport.train_station' THEN CASE WHEN i <= floor(c * 0.7e0) THEN 'train' WHEN i <= floor(c * 0.7e0) + floor(c * 0.15e0) THEN 'val' ELSE 'test' END
    ELSE g.split END AS split, CASE WHEN asset_type = 'transport.train_station' THEN 'class_fallback' ELSE 'spatial_block' END AS split_protocol, pos
  FROM (SELECT *, count(*) OVER (PARTITION BY asset_type) AS c, row_number() OVER (PARTITION BY asset_type ORDER BY {_DRAW}, asset_id) AS i FROM ({_TILES}) t) t JOIN given g ON g.block_id = t.block_id"""


def _fallback(spark, sf_dir):
    return sampling.class_fallback(sampling.block_split(_degree_blocks(spark, sf_dir)), ["transport.train_station"])


@query(f"""{_GREEDY}, s AS (SELECT asset_id, asset_type, block_id, split_protocol, CASE WHEN pos % 97 = 0 THEN NULL WHEN pos % 101 = 0 THEN 'test' ELSE split END AS split FROM ({_FALLBACK}) f
    UNION ALL SELECT asset_id, asset_type, block_id, split_protocol, 'val' FROM ({_FALLBACK}) f WHERE pos % 89 = 0)
  SELECT 'unassigned' AS rule, asset_id AS subject FROM s WHERE split IS NULL
  UNION ALL SELECT 'two_splits', asset_id FROM s GROUP BY asset_id HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'block', block_id FROM s WHERE split_protocol = 'spatial_block' GROUP BY block_id HAVING count(DISTINCT split) > 1
  UNION ALL SELECT 'class_missing', asset_type FROM s GROUP BY asset_type HAVING count(DISTINCT split) < 3
  UNION ALL SELECT 'share', n FROM (SELECT 'train' AS n, count(*) FILTER (split = 'train') / count(*) - 0.7e0 AS off FROM s UNION ALL
    SELECT 'val', count(*) FILTER (split = 'val') / count(*) - 0.15e0 FROM s UNION ALL SELECT 'test', count(*) FILTER (split = 'test') / count(*) - 0.15e0 FROM s) d WHERE abs(off) > 5e-2""")
def j2_j3_split_gate(spark, sf_dir):
    """Violations of a split into which some were put: rows without a split, rows in two, rows taken out of their block."""
    good = _fallback(spark, sf_dir)
    put = F.when(F.col("pos") % 97 == 0, F.lit(None)).when(F.col("pos") % 101 == 0, "test").otherwise(F.col("split"))
    again = good.filter("pos % 89 = 0").withColumn("split", F.lit("val"))
    return sampling.split_violations(good.withColumn("split", put).unionByName(again), slack=0.05)


@query(f"""{_GREEDY}, f AS ({_FALLBACK}), s AS (SELECT CASE WHEN pos % 79 = 0 THEN 'x' || asset_id ELSE asset_id END AS asset_id, asset_type, CASE WHEN pos % 97 = 0 THEN NULL ELSE block_id END AS block_id,
    CASE WHEN pos % 83 = 0 THEN 'by_hand' ELSE split_protocol END AS split_protocol, pos FROM f)
  SELECT 'not_in_dataset' AS rule, 'x' || asset_id AS subject FROM f WHERE pos % 79 = 0 UNION ALL SELECT 'not_in_split', asset_id FROM f WHERE pos % 79 = 0
  UNION ALL SELECT 'empty_column', 'block_id' FROM s WHERE block_id IS NULL GROUP BY 2 UNION ALL SELECT DISTINCT 'unknown_protocol', split_protocol FROM s WHERE split_protocol = 'by_hand'
  UNION ALL SELECT DISTINCT 'wrong_protocol', asset_type FROM s WHERE (split_protocol = 'class_fallback') <> (asset_type IN ('transport.train_station', 'water.wastewater.plant'))
  UNION ALL SELECT 'fallback_share', 'class_fallback' FROM s HAVING avg(CASE WHEN split_protocol = 'class_fallback' THEN 1e0 ELSE 0e0 END) > 0.1e0
  UNION ALL SELECT 'no_embedding', asset_id FROM s WHERE pos % 13 = 0 OR pos % 79 = 0""")
def j3_artifact_gate(spark, sf_dir):
    """Violations of a shipped split against its dataset, with some put in."""
    split = _fallback(spark, sf_dir)
    dataset = split.select("asset_id", "pos")
    shipped = split.withColumns({
        "asset_id": F.when(F.col("pos") % 79 == 0, F.concat(F.lit("x"), "asset_id")).otherwise(F.col("asset_id")),
        "block_id": F.when(F.col("pos") % 97 != 0, F.col("block_id")),
        "split_protocol": F.when(F.col("pos") % 83 == 0, "by_hand").otherwise(F.col("split_protocol")),
    })
    return sampling.artifact_violations(shipped, dataset, dataset.filter("pos % 13 <> 0"), ["transport.train_station", "water.wastewater.plant"], 0.1)


_PCT = ", ".join(f"round(1e2 * count(*) FILTER (split = '{s}') / count(*), 2) AS {s}_pct" for s in sampling.SPLITS)
_CNT = ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in sampling.SPLITS)


@query(f"SELECT region, {_CNT}, count(*) AS total, {_PCT} FROM ({_RANDOM}) r GROUP BY region")
def d11_split_crosstab(spark, sf_dir):
    return sampling.crosstab(sampling.random_split(view(spark, sf_dir, "assets_fx"), ["region"]), "region", "split", sampling.SPLITS)


@query(f"""{_GREEDY} SELECT asset_type, array_to_string(list_sort(list(DISTINCT split_protocol)), ',') AS protocols FROM ({_FALLBACK}) f GROUP BY asset_type""")
def d12_protocols(spark, sf_dir):
    """How each class was split."""
    return _fallback(spark, sf_dir).groupBy("asset_type").agg(F.array_join(F.array_sort(F.collect_set("split_protocol")), ",").alias("protocols"))


@query(f"""{_GREEDY}, x AS (SELECT r.split AS old_split, g.split AS new_split, count(*) AS n FROM ({_RANDOM}) r JOIN ({_TILES}) t ON t.asset_id = r.asset_id
  JOIN given g ON g.block_id = t.block_id GROUP BY 1, 2)
  SELECT *, round(1e2 * (SELECT sum(n) FROM x WHERE old_split = new_split) / (SELECT sum(n) FROM x), 2) AS unchanged_pct FROM x""")
def d13_split_transitions(spark, sf_dir):
    tiles = _degree_blocks(spark, sf_dir)
    return sampling.transitions(sampling.random_split(view(spark, sf_dir, "assets_fx"), ["region"]), sampling.block_split(tiles))


@query(f"""SELECT region, count(*) AS blocks, min(n) AS least, median(n) AS median, max(n) AS most, round(avg(n), 4) AS mean
  FROM (SELECT region, block_id, count(*) AS n FROM ({_TILES}) t GROUP BY region, block_id) b GROUP BY region""")
def d14_block_sizes(spark, sf_dir):
    n = _degree_blocks(spark, sf_dir).groupBy("region", "block_id").agg(F.count("*").alias("n"))
    return n.groupBy("region").agg(
        F.count("*").alias("blocks"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean")
    )


@query("""SELECT asset_id, asset_type, source, CAST(floor((row_number() OVER (PARTITION BY asset_type ORDER BY asset_id) - 1) / 50) AS BIGINT) AS batch
  FROM (SELECT asset_id, asset_type, sector AS source FROM assets_fx) a""")
def e19_batches(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx").select("asset_id", "asset_type", F.col("sector").alias("source"))
    return ranking.batches(a, ["asset_type"], ["asset_id"], 50)


@query("""SELECT asset_id, row_number() OVER (ORDER BY asset_type, balance DESC, asset_id) - 1 AS "order" FROM assets_fx""")
def e16_queue_order(spark, sf_dir):
    """A dense order over all assets: class, priority descending, id."""
    a = view(spark, sf_dir, "assets_fx").select("asset_id", "asset_type", "balance")
    return ranking.dense_order(a, ["asset_type", F.col("balance").desc(), "asset_id"]).select("asset_id", "order")


@query("""SELECT region, site, min_by(asset_id, pos) AS asset_id FROM assets_fx GROUP BY region, site""")
def e15_keep_first(spark, sf_dir):
    return ranking.keep_first(view(spark, sf_dir, "assets_fx"), ["region", "site"], ["pos"]).select("region", "site", "asset_id")


@query(f"""WITH c AS (SELECT source, asset_id, held, done FROM (SELECT sector AS source, asset_id, pos % 40 = 0 AS held, pos % 3 = 0 AS done FROM assets_fx) a)
  SELECT asset_id, source, held OR (NOT held AND NOT done AND i <= want) AS audit FROM (SELECT *, row_number() OVER (PARTITION BY source, NOT held AND NOT done ORDER BY {draw(42, 'source', 'asset_id')}, asset_id) AS i,
    greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.1e0, 0)) - sum(CAST(held AS INT)) OVER (PARTITION BY source) AS want FROM c) w""")
def e8_audit_holdout(spark, sf_dir):
    a = view(spark, sf_dir, "assets_fx").withColumn("source", F.col("sector"))
    return sampling.audit_holdout(a.select("asset_id", "source"), a.filter("pos % 40 = 0"), a.filter("pos % 3 = 0"))


_LIGHTEST = "CASE WHEN a <= least(b, c, d, e) THEN 0 WHEN b <= least(c, d, e) THEN 1 WHEN c <= least(d, e) THEN 2 WHEN d <= e THEN 3 ELSE 4 END"


@query(f"""WITH RECURSIVE g AS (SELECT block_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block_id) AS i FROM ({_TILES}) t GROUP BY block_id),
  walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS block_id, 0 AS fold
    UNION ALL SELECT i, a + CASE WHEN fold = 0 THEN n ELSE 0 END, b + CASE WHEN fold = 1 THEN n ELSE 0 END, c + CASE WHEN fold = 2 THEN n ELSE 0 END, d + CASE WHEN fold = 3 THEN n ELSE 0 END,
      e + CASE WHEN fold = 4 THEN n ELSE 0 END, block_id, fold
    FROM (SELECT g.i, g.n, g.block_id, a, b, c, d, e, {_LIGHTEST} AS fold FROM walk JOIN g ON g.i = walk.i + 1) s)
  SELECT asset_id, t.block_id, CAST(fold AS INT) AS fold FROM ({_TILES}) t JOIN walk ON walk.block_id = t.block_id""")
def e24_group_folds(spark, sf_dir):
    """Five folds of whole blocks, the largest block to the lightest fold."""
    return sampling.group_folds(_degree_blocks(spark, sf_dir), "block_id").select("asset_id", "block_id", "fold")


@query("""SELECT a.region, s.sector, count(t.asset_id) AS n, CASE WHEN count(t.asset_id) = 0 THEN 'MISSING_INPUT' ELSE 'OK' END AS status
  FROM (SELECT DISTINCT region FROM assets_fx) a CROSS JOIN (VALUES ('energy'), ('water'), ('transport'), ('telecom')) s(sector)
  LEFT JOIN assets_fx t ON t.region = a.region AND t.sector = s.sector GROUP BY 1, 2""")
def a8_c24_cell_grid(spark, sf_dir):
    """All cells of regions and sectors with their rows; cells without any are marked."""
    a = view(spark, sf_dir, "assets_fx")
    sectors = F.explode(F.array(*(F.lit(s) for s in ("energy", "water", "transport", "telecom"))))
    grid = a.select("region").distinct().withColumn("sector", sectors)
    n = a.groupBy("region", "sector").agg(F.count("*").alias("n"))
    out = grid.join(n, ["region", "sector"], "left").fillna({"n": 0})
    return out.withColumn("status", F.when(F.col("n") == 0, "MISSING_INPUT").otherwise("OK"))
