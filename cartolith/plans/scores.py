"""Queries: confusion matrices, learning curves, agents, decisions, label status."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.fixtures import view
from cartolith.operators import metrics, review
from cartolith.plans.queries import query

GRID = "(SELECT a.c AS truth, b.c AS pred FROM (SELECT unnest(range(5)) AS c) a CROSS JOIN (SELECT unnest(range(5)) AS c) b)"


def matrix_sql(*group: str) -> str:
    g, names = ", ".join(group), "".join(f"{c}, " for c in group)
    keys = "".join(f" AND p.{c} = s.{c}" for c in group)
    heads = f"(SELECT DISTINCT {g} FROM preds_fx) s CROSS JOIN {GRID} g" if group else f"{GRID} g"
    own = "".join(f"s.{c}, " for c in group)
    return f"""SELECT {own}g.truth, g.pred, coalesce(p.n, 0) AS n FROM {heads} LEFT JOIN (SELECT {names}truth, pred, count(*) AS n FROM preds_fx GROUP BY ALL) p
      ON p.truth = g.truth AND p.pred = g.pred{keys}"""


def classes_sql(*group: str) -> str:
    names = "".join(f"{c}, " for c in group)
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
      SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM (
      SELECT {names}cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted FROM (
      SELECT {names}truth AS cls, n AS support, 0 AS predicted, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM ({matrix_sql(*group)}) m
      UNION ALL SELECT {names}pred, 0, n, 0 FROM ({matrix_sql(*group)}) m) u GROUP BY ALL) t) q"""


def preds(spark, sf_dir):
    return view(spark, sf_dir, "preds_fx")


@query(f"SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY seed, truth) > 0 THEN n / sum(n) OVER (PARTITION BY seed, truth) ELSE 0 END, 9) AS share FROM ({matrix_sql('seed')}) m")
def d18_confusion(spark, sf_dir):
    m = metrics.row_share(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)), ("seed",))
    return m.withColumn("share", F.round("share", 9))


@query(f"SELECT cls, tp, support, predicted, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM ({classes_sql()}) c")
def d19_class_metrics(spark, sf_dir):
    c = metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5))
    return c.select("cls", "tp", "support", "predicted", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")))


@query(f"""SELECT seed, round(avg(f1) FILTER (support > 0 OR predicted > 0), 9) AS macro_f1, round(sum(support * f1) / sum(support), 9) AS weighted_f1, round(sum(tp) / sum(support), 9) AS accuracy, CAST(sum(support) AS BIGINT) AS total
  FROM ({classes_sql('seed')}) c GROUP BY seed""")
def d20_overall(spark, sf_dir):
    o = metrics.overall(metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)), ("seed",)), ("seed",), present=True)
    return o.select("seed", *(F.round(x, 9).alias(x) for x in ("macro_f1", "weighted_f1", "accuracy")), "total")


@query(f"""SELECT region, CAST(sum(support) AS BIGINT) AS total, round(avg(f1) FILTER (support > 0 OR predicted > 0), 9) AS macro_f1, round(sum(tp) / sum(support), 9) AS accuracy FROM ({classes_sql('region')}) c GROUP BY region""")
def d21_by_region(spark, sf_dir):
    o = metrics.overall(metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5, ("region",)), ("region",)), ("region",), present=True)
    return o.select("region", "total", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""SELECT CASE WHEN cls < 2 THEN 'energy' WHEN cls < 4 THEN 'water' ELSE 'transport' END AS sector, CAST(sum(support) AS BIGINT) AS n, round(avg(f1), 9) AS macro_f1, round(sum(tp) / sum(support), 9) AS accuracy
  FROM ({classes_sql()}) c GROUP BY 1""")
def d22_by_sector(spark, sf_dir):
    sectors = spark.createDataFrame([(0, "energy"), (1, "energy"), (2, "water"), (3, "water"), (4, "transport")], "cls int, sector string")
    o = metrics.by_sector(metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5)), sectors)
    return o.select("sector", "n", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""SELECT seed, round(avg(f1), 9) AS macro_f1, round(sum(support * f1) / sum(support), 9) AS weighted_f1 FROM ({classes_sql('seed')}) c WHERE cls IN (0, 2, 4) GROUP BY seed""")
def d23_refit(spark, sf_dir):
    o = metrics.refit(metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)), ("seed",)), [0, 2, 4], ("seed",))
    return o.select("seed", F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1"))


@query(f"""WITH m AS ({matrix_sql('seed')}), s AS (SELECT seed, truth AS cls, sum(n) AS support, sum(n) FILTER (truth = pred) AS tp FROM m WHERE truth IN (0, 2, 4) GROUP BY ALL),
  p AS (SELECT seed, pred AS cls, sum(n) AS predicted FROM m WHERE truth IN (0, 2, 4) AND pred IN (0, 2, 4) GROUP BY ALL)
  SELECT seed, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(tp / predicted), 9) AS macro_precision, round(avg(tp / support), 9) AS macro_recall,
    round(sum(support * tp / predicted) / sum(support), 9) AS weighted_precision FROM s JOIN p USING (seed, cls) GROUP BY seed""")
def d24_kept_metrics(spark, sf_dir):
    o = metrics.kept_metrics(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)), [0, 2, 4], ("seed",))
    return o.select("seed", *(F.round(c, 9).alias(c) for c in o.columns if c != "seed"))


@query(f"""SELECT cls, round(avg(f1), 9) AS mean, round(stddev_pop(f1), 9) AS std, list(round(f1, 9) ORDER BY seed) AS per_seed FROM ({classes_sql('seed')}) c GROUP BY cls""")
def d25_over_seeds(spark, sf_dir):
    c = metrics.per_class(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)), ("seed",))
    o = metrics.over_seeds(c, "f1", ("cls",))
    return o.select("cls", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.transform("per_seed", lambda x: F.round(x, 9)).alias("per_seed"))


RUN = ("model", "protocol")


@query("""WITH s AS (SELECT model, protocol, seed, sum(time_s) AS s, count(*) AS e FROM epochs_fx GROUP BY ALL)
  SELECT model, protocol, round(avg(s), 6) AS mean_s, round(sum(s), 6) AS total_s, min(e) AS least_epochs, max(e) AS most_epochs, min(e) <> max(e) AS uneven,
    format('{:d}h {:02d}m {:02d}s', CAST(floor(avg(s) / 3600) AS BIGINT), CAST(floor(CAST(floor(avg(s)) AS BIGINT) % 3600 / 60) AS BIGINT), CAST(floor(avg(s)) AS BIGINT) % 60) AS mean_text FROM s GROUP BY ALL""")
def d26_wall_clock(spark, sf_dir):
    w = metrics.wall_clock(view(spark, sf_dir, "epochs_fx"), RUN)
    return w.withColumn("mean_s", F.round("mean_s", 6)).withColumn("total_s", F.round("total_s", 6))


@query("SELECT model, protocol, seed, max_by(epoch, struct_pack(a := val_f1, b := -epoch)) AS best_epoch, max(val_f1) AS best_f1 FROM epochs_fx GROUP BY ALL")
def e22_best_epoch(spark, sf_dir):
    return metrics.best_epochs(view(spark, sf_dir, "epochs_fx"), RUN)


@query("""WITH e AS (SELECT model, protocol, min(m) AS last FROM (SELECT model, protocol, seed, max(epoch) AS m FROM epochs_fx GROUP BY ALL) s GROUP BY ALL)
  SELECT model, protocol, epoch, round(avg(val_f1), 9) AS mean, round(stddev_pop(val_f1), 9) AS std FROM epochs_fx JOIN e USING (model, protocol) WHERE epoch <= last GROUP BY ALL""")
def e23_curves(spark, sf_dir):
    c = metrics.curves(view(spark, sf_dir, "epochs_fx"), RUN)
    return c.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query("""WITH b AS (SELECT model, protocol, round(avg(val_f1), 9) AS f1 FROM epochs_fx GROUP BY ALL)
  SELECT model, max(f1) AS best_f1, max_by(protocol, struct_pack(a := f1, b := protocol)) AS best_protocol, rank() OVER (ORDER BY max(f1) DESC) AS place FROM b GROUP BY model""")
def e20_e21_best_condition(spark, sf_dir):
    """The better protocol of each model, ranked."""
    from pyspark.sql import Window

    b = view(spark, sf_dir, "epochs_fx").groupBy(*RUN).agg(F.round(F.avg("val_f1"), 9).alias("f1"))
    best = b.groupBy("model").agg(F.max("f1").alias("best_f1"), F.max_by("protocol", F.struct("f1", "protocol")).alias("best_protocol"))
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("best_f1"))))  # a row for each model


@query("""WITH b AS (SELECT model, protocol, avg(val_f1) AS f1 FROM epochs_fx WHERE NOT (model = 'm3' AND protocol = 'FT') GROUP BY ALL), p AS (SELECT model, max(f1) FILTER (protocol = 'LP') AS lp, max(f1) FILTER (protocol = 'FT') AS ft FROM b GROUP BY model)
  SELECT model, round(lp, 9) AS lp, round(ft, 9) AS ft, round(ft - lp, 9) AS gain, round(ft - (SELECT ft FROM p WHERE model = 'm0'), 9) AS lead, row_number() OVER (ORDER BY ft DESC NULLS LAST, model) AS place FROM p""")
def e21_adaptation_pairs(spark, sf_dir):
    """Probe and fine-tuned score of each model against the fine-tuned m0; one model has no fine-tuned run."""
    runs = view(spark, sf_dir, "epochs_fx").filter("not (model = 'm3' and protocol = 'FT')")
    pairs = metrics.adaptation_pairs(runs.groupBy(*RUN).agg(F.avg("val_f1").alias("f1")), "m0")
    return pairs.select("model", *(F.round(c, 9).alias(c) for c in ("lp", "ft", "gain", "lead")), "place")


_YIELDS = "SELECT floor(lat / 5) * 5 AS lat0, floor(lon / 5) * 5 AS lon0, count(*) AS attempted, round(1e2 * count(*) FILTER (passed) / count(*), 2) AS yield_pct FROM attempts_fx GROUP BY 1, 2 HAVING count(*) >= 5"


@query(f"""(SELECT lat0, lon0, yield_pct, 'top' AS side FROM ({_YIELDS}) y ORDER BY yield_pct DESC, lat0, lon0 LIMIT 10) UNION ALL (SELECT lat0, lon0, yield_pct, 'bottom' FROM ({_YIELDS}) y ORDER BY yield_pct, lat0, lon0 LIMIT 10)""")
def e20_extreme_cells(spark, sf_dir):
    """The ten grid cells with the highest yield and the ten with the lowest."""
    from cartolith.operators import reconcile

    a = view(spark, sf_dir, "attempts_fx")
    cells = reconcile.yield_grid(a, a.filter("passed"), 5.0, 5).select("lat0", "lon0", "yield_pct")
    return metrics.extremes(cells, "yield_pct", 10, ["lat0", "lon0"])


@query("""WITH e AS (SELECT model, protocol, min(m) AS last FROM (SELECT model, protocol, seed, max(epoch) AS m FROM epochs_fx GROUP BY ALL) s GROUP BY ALL)
  SELECT model, protocol, round(avg(val_f1), 9) AS tail_mean, round(stddev_pop(val_f1), 9) AS tail_std, count(*) AS points FROM epochs_fx JOIN e USING (model, protocol) WHERE epoch <= last AND epoch > last - 5 GROUP BY ALL""")
def e23_curve_tails(spark, sf_dir):
    """The last five epochs of each curve."""
    t = metrics.curve_tail(view(spark, sf_dir, "epochs_fx"), RUN)
    return t.withColumn("tail_mean", F.round("tail_mean", 9)).withColumn("tail_std", F.round("tail_std", 9))


@query("SELECT truth, n, round(total / (5 * n), 9) AS weight FROM (SELECT truth, count(*) AS n, sum(count(*)) OVER () AS total FROM preds_fx GROUP BY truth) t")
def g13_class_weights(spark, sf_dir):
    return metrics.class_weights(preds(spark, sf_dir), "truth").withColumn("weight", F.round("weight", 9))


@query(f"SELECT truth, count(DISTINCT s) AS sums FROM (SELECT seed, truth, sum(n) AS s FROM ({matrix_sql('seed')}) m GROUP BY ALL) r GROUP BY truth HAVING count(DISTINCT s) > 1")
def j8_support_gate(spark, sf_dir):
    return metrics.support_violations(metrics.confusion(preds(spark, sf_dir), 5, ("seed",)))


def agents(spark, sf_dir):
    a = view(spark, sf_dir, "agents_fx")
    return a.withColumn("human", F.when(~F.col("human_unsure"), F.col("human_label")))


_ROUTE = """SELECT *, CASE WHEN NOT human_unsure THEN human_label END AS human, CASE WHEN a_action = 'confirm' THEN osm_label ELSE a_label END AS a_cls,
  CASE WHEN a_action = 'request_review' OR b_action = 'request_review' THEN 'agent_abstention' WHEN CASE WHEN a_action = 'confirm' THEN osm_label ELSE a_label END <> b_label THEN 'agent_disagreement' END AS r1,
  CASE WHEN least(a_confidence, b_confidence) < {t} THEN 'low_confidence' END AS r2, CASE WHEN a_quality = 'poor' THEN 'poor_imagery' END AS r3 FROM {f}"""
_DONE = """SELECT *, CASE WHEN coalesce(r1, r2, r3) IS NOT NULL THEN 'request_review' WHEN a_cls = osm_label THEN 'confirm' ELSE 'relabel' END AS action,
  CASE WHEN coalesce(r1, r2, r3) IS NOT NULL THEN '' ELSE a_cls END AS label FROM (""" + _ROUTE + ") r"


def done(t: str = "0.85e0", f: str = "agents_fx") -> str:
    return _DONE.format(t=t, f=f)


@query(f"SELECT id, action, label, concat_ws(',', r1, r2, r3) AS reasons FROM ({done()}) d")
def g15_agent_routing(spark, sf_dir):
    return review.routed(agents(spark, sf_dir)).select("id", "action", "label", F.array_join("reasons", ",").alias("reasons"))


_SCORE = """count(*) AS scored, count(*) FILTER (action <> 'request_review') AS automatic, round(count(*) FILTER (action <> 'request_review') / count(*), 3) AS coverage,
  count(*) FILTER (action <> 'request_review' AND human IS NOT NULL) AS resolved, count(*) FILTER (action <> 'request_review' AND label <> human) AS wrong,
  count(*) FILTER (action = 'confirm' AND label <> human) AS false_confirms, count(*) FILTER (action = 'relabel' AND label <> human) AS false_relabels,
  round(count(*) FILTER (action <> 'request_review' AND label <> human) / nullif(count(*) FILTER (action <> 'request_review' AND human IS NOT NULL), 0), 3) AS selective_error"""


@query(f"SELECT region, {_SCORE} FROM ({done()}) d GROUP BY region")
def d32_agent_scores(spark, sf_dir):
    return review.agent_scores(review.routed(agents(spark, sf_dir)), ("region",))


@query("""SELECT 'a' AS role, count(*) FILTER (a_action <> 'request_review') AS answered, count(*) FILTER (a_action = 'request_review') AS abstained,
  count(*) FILTER (CASE WHEN a_action = 'relabel' THEN a_label WHEN a_action = 'confirm' THEN osm_label END = human_label) AS correct FROM agents_fx WHERE NOT human_unsure
  UNION ALL SELECT 'b', count(*) FILTER (b_action = 'classify'), count(*) FILTER (b_action <> 'classify'), count(*) FILTER (b_action = 'classify' AND b_label = human_label) FROM agents_fx WHERE NOT human_unsure""")
def d32_role_scores(spark, sf_dir):
    a = agents(spark, sf_dir)
    return review.role_scores(a, "a").unionByName(review.role_scores(a, "b"))


_STEPS = "(SELECT a.*, t.threshold FROM agents_fx a CROSS JOIN (SELECT (i * 5 + 50) / 100 AS threshold FROM (SELECT unnest(range(11)) AS i) u) t WHERE NOT human_unsure)"


@query(f"SELECT threshold, {_SCORE} FROM ({done('threshold', _STEPS)}) d WHERE half = 'calibration' GROUP BY threshold")
def c20_threshold_sweep(spark, sf_dir):
    return review.sweep(agents(spark, sf_dir).filter("half = 'calibration'"))


@query(f"""WITH s AS (SELECT threshold, {_SCORE} FROM ({done('threshold', _STEPS)}) d WHERE half = 'calibration' GROUP BY threshold),
  c AS (SELECT coalesce(min(threshold) FILTER (selective_error <= 0.3e0), 1e0) AS threshold FROM s)
  SELECT region, d.threshold, {_SCORE} FROM ({done('threshold', _STEPS)}) d JOIN c ON c.threshold = d.threshold WHERE half = 'heldout' GROUP BY region, d.threshold""")
def d33_calibration(spark, sf_dir):
    return review.calibrate(agents(spark, sf_dir), 0.3, ("region",))


@query(f"SELECT id, label, human FROM ({done('0.75e0')}) d WHERE action <> 'request_review' AND label <> human")
def d33_disputes(spark, sf_dir):
    return review.disputes(agents(spark, sf_dir), 0.75).select("id", "label", "human")


@query("""WITH p AS (SELECT *, CASE WHEN a_action = 'confirm' THEN osm_label ELSE a_label END AS said FROM agents_fx WHERE NOT human_unsure AND a_action <> 'request_review')
  SELECT region, count(*) AS answered, count(*) FILTER (said = human_label) AS agent_right, count(*) FILTER (osm_label = human_label) AS label_right,
    count(*) FILTER (said = human_label AND osm_label <> human_label) AS fixed, count(*) FILTER (said <> human_label AND osm_label = human_label) AS broken FROM p GROUP BY region""")
def d34_single_agent_report(spark, sf_dir):
    """One agent against trusting the original label: what it fixes and what it breaks."""
    a = agents(spark, sf_dir).filter("human is not null and a_action <> 'request_review'")
    said = F.when(F.col("a_action") == "confirm", F.col("osm_label")).otherwise(F.col("a_label"))
    right, kept = said == F.col("human"), F.col("osm_label") == F.col("human")
    n = lambda c: F.count(F.when(c, 1))
    return a.groupBy("region").agg(F.count("*").alias("answered"), n(right).alias("agent_right"), n(kept).alias("label_right"), n(right & ~kept).alias("fixed"), n(~right & kept).alias("broken"))


@query("""SELECT a.region, count(*) AS shared, count(*) FILTER (a.a_label = b.b_label) AS same FROM agents_fx a JOIN agents_fx b ON a.tile = b.tile AND a.id < b.id GROUP BY a.region""")
def f4_shared_ablation(spark, sf_dir):
    """Tiles that two runs share, and how often they agree."""
    a = view(spark, sf_dir, "agents_fx")
    b = a.select("tile", F.col("id").alias("id2"), F.col("b_label").alias("other"))
    both = a.join(b, "tile").filter("id < id2")
    return both.groupBy("region").agg(F.count("*").alias("shared"), F.count(F.when(F.col("a_label") == F.col("other"), 1)).alias("same"))


@query("""SELECT 'a' AS role, id, 'label' AS rule FROM agents_fx WHERE a_action = 'relabel' AND a_label NOT IN ('c0', 'c1', 'c2', 'c3')
  UNION ALL SELECT 'a', id, 'confidence' FROM agents_fx WHERE NOT a_confidence BETWEEN 0.7e0 - 0.7e0 AND 1
  UNION ALL SELECT 'a', id, 'citations' FROM agents_fx WHERE tile % 10 = 0 UNION ALL SELECT 'a', id, 'imagery' FROM agents_fx WHERE tile % 15 = 0 UNION ALL SELECT 'a', id, 'reason' FROM agents_fx WHERE tile % 25 = 0""")
def j5_agent_gate(spark, sf_dir):
    """Rules that the rows of one agent break."""
    a = view(spark, sf_dir, "agents_fx")
    image = F.when(F.col("tile") % 15 == 0, F.lit("e:osm")).otherwise(F.lit("e:naip"))
    cites = F.when(F.col("tile") % 10 == 0, F.array(image, F.lit("other"))).otherwise(F.array(image))
    rows = a.select(
        F.lit("a").alias("role"), "id", F.col("a_action").alias("action"), F.col("a_label").alias("label"), F.col("a_confidence").alias("confidence"),
        F.col("a_quality").alias("image_quality"), cites.alias("evidence_ids"), F.when(F.col("tile") % 25 == 0, " ").otherwise("seen").alias("reason"),
        F.array(F.lit("e:osm"), F.lit("e:naip")).alias("allowed"),
    )
    return review.agent_violations(rows, ["c0", "c1", "c2", "c3"], {"a": ("confirm", "relabel", "request_review")})


def log(spark, sf_dir):
    return view(spark, sf_dir, "decisions_fx")


_LATEST = "SELECT asset_id, reviewer, max_by(decision, line) AS decision, max_by(label, line) AS label, max_by(note, line) AS note, max(line) AS line FROM decisions_fx GROUP BY asset_id, reviewer"


@query(_LATEST)
def e14_latest_decisions(spark, sf_dir):
    return review.latest(log(spark, sf_dir), ("line",)).select("asset_id", "reviewer", "decision", "label", "note", "line")


_STATE = f"""SELECT asset_id, count(*) AS n, count(*) FILTER (decision <> 'unsure') AS labels, count(DISTINCT label) FILTER (decision <> 'unsure') AS kinds,
  max(label) FILTER (decision <> 'unsure') AS label, bool_or(decision = 'accept') AS accepted, array_to_string(list_sort(list(DISTINCT reviewer)), ',') AS reviewers FROM ({_LATEST}) l GROUP BY asset_id"""
_ONE = f"SELECT *, CASE WHEN labels = 0 THEN 'unsure' WHEN kinds = 1 THEN 'done' ELSE 'disputed' END AS status FROM ({_STATE}) s"
_TWO = f"SELECT *, CASE WHEN accepted AND n = 1 THEN 'done' WHEN n = 1 THEN 'needs_second' WHEN labels >= 2 AND kinds = 1 THEN 'done' ELSE 'disputed' END AS status FROM ({_STATE}) s"


@query(f"SELECT asset_id, status, CASE WHEN status = 'done' THEN label ELSE '' END AS final_label, reviewers FROM ({_ONE}) o")
def g14_status(spark, sf_dir):
    s = review.status(review.latest(log(spark, sf_dir), ("line",)))
    return s.withColumn("reviewers", F.array_join("reviewers", ","))


@query(f"SELECT asset_id, status, CASE WHEN status = 'done' THEN label ELSE '' END AS final_label FROM ({_TWO}) o")
def g14_status_two_reviewers(spark, sf_dir):
    return review.status(review.latest(log(spark, sf_dir), ("line",)), second_opinion=True).drop("reviewers")


@query(f"""SELECT q.asset_id, CASE WHEN status IS NULL THEN 'first' WHEN NOT list_contains(string_split(reviewers, ','), 'r1') AND status IN ('needs_second', 'disputed') THEN 'second' ELSE '' END AS pass
  FROM (SELECT DISTINCT 'osm_way_' || CAST(c_custkey AS VARCHAR) AS asset_id FROM customer) q LEFT JOIN ({_TWO}) s ON s.asset_id = q.asset_id""")
def g14_passes(spark, sf_dir):
    """Which pass each of the queue's assets belongs to for one reviewer."""
    queue, _ = _queue(spark, sf_dir)
    states = review.status(review.latest(log(spark, sf_dir), ("line",)), second_opinion=True)
    return review.wants(queue, states, "r1", second_opinion=True)


@query(f"SELECT status, count(*) AS n, count(*) FILTER (list_contains(string_split(reviewers, ','), 'r1')) AS mine FROM ({_ONE}) o GROUP BY status")
def d36_queue_state(spark, sf_dir):
    s = review.status(review.latest(log(spark, sf_dir), ("line",)))
    return s.groupBy("status").agg(F.count("*").alias("n"), F.count(F.when(F.array_contains("reviewers", "r1"), 1)).alias("mine"))


@query(f"""SELECT asset_id, reviewer, decision, label, 'note 3' AS note FROM ({_LATEST}) l WHERE note <> 'note 3'""")
def g19_import_upsert(spark, sf_dir):
    """What an import with one changed column would append."""
    entries = review.latest(log(spark, sf_dir), ("line",)).select("asset_id", "reviewer", "decision", "label", "note")
    return review.upsert(entries, entries.withColumn("note", F.lit("note 3")))


_QUEUE = "SELECT DISTINCT 'osm_way_' || CAST(c_custkey AS VARCHAR) AS asset_id, 'energy.generation.wind_farm' AS asset_type, c_custkey AS k FROM customer"


@query(f"""WITH l AS ({_LATEST}), p AS (SELECT * FROM l WHERE reviewer = 'r0'), s AS (SELECT asset_id FROM l WHERE reviewer = 'source'),
  q AS (SELECT *, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 'relabel' WHEN k % 10 = 0 THEN 'request_review' ELSE 'confirm' END END AS g_action, 'energy.generation.solar_farm' AS g_label, (k % 100) / 1e2 AS g_confidence FROM ({_QUEUE}) q),
  b AS (SELECT q.*, p.decision, p.label AS p_label, s.asset_id IS NOT NULL AS sourced, g_action <> 'request_review' AND g_confidence >= 0.65e0 AS sure FROM q LEFT JOIN p ON p.asset_id = q.asset_id LEFT JOIN s ON s.asset_id = q.asset_id)
  SELECT asset_id, asset_type AS original_label, CASE WHEN decision = 'relabel' THEN p_label WHEN decision IS NOT NULL OR sourced THEN asset_type WHEN sure AND g_action <> 'confirm' THEN g_label ELSE asset_type END AS screened_label,
    CASE WHEN decision = 'unsure' THEN 'human_unsure' WHEN decision IS NOT NULL THEN 'human' WHEN sourced THEN 'official_source' WHEN g_action IS NULL THEN 'unscreened' WHEN sure THEN 'agent' ELSE 'agent_unsure' END AS checked_by FROM b""")
def g16_label_status(spark, sf_dir):
    """One label for each tile, by precedence."""
    queue, agent = _queue(spark, sf_dir)
    return review.label_status(queue, review.latest(log(spark, sf_dir), ("line",)), agent, "r0")


def _queue(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("osm_way_"), F.col("c_custkey").cast("string")).alias("asset_id"), F.col("c_custkey").alias("k"))
    queue = c.select("asset_id", F.lit("energy.generation.wind_farm").alias("asset_type"))
    action = F.when(F.col("k") % 6 == 0, "relabel").when(F.col("k") % 10 == 0, "request_review").otherwise("confirm")
    agent = c.filter("k % 2 = 0").select("asset_id", action.alias("action"), F.lit("energy.generation.solar_farm").alias("label"), ((F.col("k") % 100) / 100.0).alias("confidence"))
    return queue, agent


@query(f"""WITH l AS ({_LATEST}), p AS (SELECT * FROM l WHERE reviewer = 'r0'), s AS (SELECT asset_id FROM l WHERE reviewer = 'source')
  SELECT CASE WHEN p.decision = 'unsure' THEN 'human_unsure' WHEN p.decision IS NOT NULL THEN 'human' WHEN s.asset_id IS NOT NULL THEN 'official_source' WHEN k % 2 = 1 THEN 'unscreened'
    WHEN NOT (k % 10 = 0 AND k % 6 <> 0) AND (k % 100) / 1e2 >= 0.65e0 THEN 'agent' ELSE 'agent_unsure' END AS checked_by, count(*) AS n
  FROM ({_QUEUE}) q LEFT JOIN p ON p.asset_id = q.asset_id LEFT JOIN s ON s.asset_id = q.asset_id GROUP BY 1""")
def d35_status_counts(spark, sf_dir):
    return g16_label_status(spark, sf_dir).groupBy("checked_by").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT asset_id, seq, text, corroborated FROM evidence_fx)
  SELECT asset_id, coalesce(string_agg(text, ' | ' ORDER BY seq, text) FILTER (text <> ''), '') AS evidence, bool_or(corroborated) AS corroborated FROM e GROUP BY asset_id""")
def d15_fused_evidence(spark, sf_dir):
    return review.fused(view(spark, sf_dir, "evidence_fx"))


@query("""SELECT source, count(*) AS rows, count(DISTINCT asset_id) AS tiles, count(*) FILTER (corroborated) AS corroborated, count(*) FILTER (auto_ok) AS auto_ok, count(*) FILTER (starts_with(text, 'Caution')) AS flagged
  FROM evidence_fx GROUP BY source UNION ALL SELECT 'all', count(*), count(DISTINCT asset_id), count(*) FILTER (corroborated), count(*) FILTER (auto_ok), count(*) FILTER (starts_with(text, 'Caution')) FROM evidence_fx""")
def d17_evidence_crosstab(spark, sf_dir):
    """Evidence by source, with a row for all."""
    n = lambda c: F.count(F.when(c, 1))
    out = view(spark, sf_dir, "evidence_fx").rollup("source").agg(
        F.count("*").alias("rows"), F.count_distinct("asset_id").alias("tiles"), n(F.col("corroborated")).alias("corroborated"),
        n(F.col("auto_ok")).alias("auto_ok"), n(F.startswith("text", F.lit("Caution"))).alias("flagged"),
    )
    return out.fillna({"source": "all"})


@query(f"""WITH c AS (SELECT asset_id, source, text AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY source, k, seq, k2, text) AS n FROM evidence_fx WHERE auto_ok) e WHERE n = 1),
  w AS (SELECT asset_id, bool_or(reviewer <> 'source') AS human, bool_or(reviewer = 'source') AS own FROM ({_LATEST}) l GROUP BY asset_id)
  SELECT c.asset_id, c.source, CASE WHEN human THEN 'already_reviewed' ELSE '' END AS audit_kind, CASE WHEN own THEN 'already_accepted' WHEN human THEN 'human_decided' ELSE 'accepted' END AS verdict,
    CASE WHEN NOT coalesce(own, false) AND NOT coalesce(human, false) THEN 'auto-accepted (' || c.source || '): rule. ' || split_part(evidence, ' | ', 1) END AS note FROM c LEFT JOIN w ON w.asset_id = c.asset_id""")
def g17_auto_accept(spark, sf_dir):
    """Verdicts on tiles that an official source confirms, one source each."""
    from cartolith.operators.ranking import keep_first

    e = view(spark, sf_dir, "evidence_fx").filter("auto_ok")
    first = keep_first(e, ["asset_id"], ["source", "k", "seq", "k2", "text"])
    cands = first.select("asset_id", "source", F.lit("rule").alias("rule"), F.col("text").alias("evidence"), F.lit(False).alias("audit"))
    out = review.auto_accept(cands, review.latest(log(spark, sf_dir), ("line",)))
    return out.select("asset_id", "source", "audit_kind", "verdict", "note")


@query()
def d30_class_accuracy(spark, sf_dir):
    """Label accuracy of each class with an exact interval."""
    from cartolith.operators.sampling import class_sample

    queue, agent = _queue(spark, sf_dir)
    sample = class_sample(view(spark, sf_dir, "assets_fx"))
    kind = F.when(F.col("pos") % 9 == 0, "unsure").when(F.col("pos") % 4 == 0, "relabel").otherwise("accept")
    decided = view(spark, sf_dir, "assets_fx").select("asset_id", kind.alias("decision"), F.lit("x").alias("label"))
    return review.class_accuracy(sample, decided)


@query("""SELECT a.asset_type, 'energy.generation.wind_farm' AS label, count(*) AS tiles FROM assets_fx a WHERE pos % 4 = 0 AND pos % 9 <> 0 AND asset_type <> 'energy.generation.wind_farm' GROUP BY 1""")
def d31_wrong_labels(spark, sf_dir):
    """Confusion of labels that a person corrected."""
    a = view(spark, sf_dir, "assets_fx").filter("pos % 4 = 0 and pos % 9 <> 0").withColumn("label", F.lit("energy.generation.wind_farm"))
    return a.filter("asset_type <> label").groupBy("asset_type", "label").agg(F.count("*").alias("tiles"))
