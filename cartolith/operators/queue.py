"""The review queue: assembly, order, listing, imports, audits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.names import element_url, name_hint
from cartolith.operators.ranking import dense_order
from cartolith.operators.review import fused


def without_bad_rows(assets: DataFrame, order: list) -> DataFrame:
    """Rows with coordinates, the first of each asset_id."""
    from cartolith.operators.ranking import keep_first

    return keep_first(assets.dropna(subset=["lat", "lon"]), ["asset_id"], order)


def assemble(split: DataFrame, names: DataFrame, images: DataFrame, hints: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each tile with name, image, model hint, name hint, evidence, priority and dense order.

    Within a class name hints come first, then the tiles that the model doubts most.
    """
    out = split.join(names.select("asset_id", F.trim(F.coalesce("name", F.lit(""))).alias("name")), "asset_id", "left")
    out = out.join(images.select("asset_id", "image"), "asset_id", "left").join(hints.select("asset_id", "model_suggests", "model_p_label"), "asset_id", "left")
    out = out.join(fused(evidence), "asset_id", "left").fillna({"name": "", "image": "", "model_suggests": "", "evidence": "", "corroborated": False})
    out = out.withColumn("name_hint", name_hint(F.col("name"), F.col("asset_type")))
    doubt = F.coalesce(1 - F.col("model_p_label"), F.lit(0.0))
    out = out.withColumn("priority", F.round(F.when(F.col("name_hint") != "", 1.0).otherwise(0.0) + doubt, 3))
    out = out.withColumn("osm_url", element_url(F.col("asset_id")))
    return dense_order(out, ["asset_type", F.col("priority").desc(), "asset_id"])


def queue_violations(queue: DataFrame) -> DataFrame:
    """asset_id, rule: tiles without an image, ids that occur twice."""
    bare = queue.filter("coalesce(image, '') = ''").select("asset_id", F.lit("no_image").alias("rule"))
    twice = queue.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("asset_id", F.lit("duplicate").alias("rule"))
    return bare.union(twice)


def next_items(queue: DataFrame, passes: DataFrame, wanted: str, after: int, n: int = 60) -> DataFrame:
    """The next items of a pass after a position, in order."""
    mine = passes.filter(F.col("pass") == wanted).select("asset_id")
    return queue.filter(F.col("order") > after).join(mine, "asset_id", "left_semi").orderBy("order").limit(n)


def verdict_decision(verdict: Column, cls: Column) -> Column:
    """Decision of an annotation: true accepts, false with a class relabels, the rest is unsure, unconfirmed is none."""
    return (
        F.when(verdict == "true", "accept").when((verdict == "false") & (F.coalesce(cls, F.lit("")) != ""), "relabel").when(verdict == "false", "unsure")
    )


def imported(annotations: DataFrame, queue: DataFrame, reviewer: str) -> DataFrame:
    """Decisions of an annotation file; the label of an accepted tile comes from the queue. annotations: asset_id, verdict, cls, note."""
    both = annotations.join(queue.select("asset_id", "asset_type"), "asset_id")
    decision = verdict_decision(F.col("verdict"), F.col("cls"))
    label = F.when(decision == "accept", F.col("asset_type")).when(decision == "relabel", F.col("cls")).otherwise("")
    return both.select("asset_id", F.lit(reviewer).alias("reviewer"), decision.alias("decision"), label.alias("label"), F.trim("note").alias("note")).filter("decision is not null")


def exported(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """Annotations of a queue's tiles by one reviewer's latest decisions, the inverse of ``imported``: asset_id, verdict, cls, note.

    Tiles that aren't decided have an empty verdict, as in a new project. entries: asset_id, decision, label, note.
    """
    both = queue.select("asset_id").join(entries.select("asset_id", "decision", "label", "note"), "asset_id", "left")
    verdict = F.when(F.col("decision") == "accept", "true").when(F.col("decision").isin("relabel", "unsure"), "false").otherwise("")
    cls = F.when(F.col("decision") == "relabel", F.col("label")).otherwise("")
    return both.select("asset_id", verdict.alias("verdict"), cls.alias("cls"), F.coalesce("note", F.lit("")).alias("note"))


def audit_agreement(audit: DataFrame, queue: DataFrame, entries: DataFrame, automatic: str = "source") -> DataFrame:
    """Audit tiles by source: reviewed, agreeing, share. audit: asset_id, source."""
    human = entries.filter(F.col("reviewer") != automatic).select("asset_id", "decision", "label")
    both = audit.join(queue.select("asset_id", "asset_type"), "asset_id").join(human, "asset_id", "left")
    agrees = (F.col("decision") == "accept") | (F.col("label") == F.col("asset_type"))
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy("source").agg(
        F.count_distinct("asset_id").alias("audit_tiles"), n(F.col("decision").isNotNull()).alias("reviewed"), n(agrees).alias("agree"),
        F.round(F.try_divide(100.0 * n(agrees), n(F.col("decision").isNotNull())), 1).alias("agreement_pct"),
    )


def pin_report(pinned: DataFrame) -> DataFrame:
    """modality, tiles with a pinned scene; and rows for pinnable and unpinnable tiles. pinned: asset_id, pinned (map)."""
    by = pinned.select(F.explode(F.map_keys("pinned")).alias("name"))
    both = by.union(pinned.select(F.when(F.size("pinned") > 0, "pinnable").otherwise("unpinnable")))
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("tiles"))


def lost_pins(pinned: DataFrame, refetched: DataFrame) -> DataFrame:
    """Pinned tiles whose refetch failed. refetched: asset_id, status."""
    return pinned.filter(F.size("pinned") > 0).join(refetched.filter("status <> 'ok'"), "asset_id", "left_semi").select("asset_id")


def require_pins(pinned: DataFrame, allow_partial: bool = False) -> None:
    """Refuses a rebuild if some tiles can't be pinned."""
    missing = pinned.filter(F.size("pinned") == 0).limit(1).count()
    if missing and not allow_partial:
        raise ValueError("some tiles have no pinned scene")


def cell_overshoot(sample: DataFrame, targets: DataFrame, classes: int) -> DataFrame:
    """Cells whose sample exceeds the target by more rows than there are classes."""
    n = sample.groupBy("region", "sector").agg(F.count(F.lit(1)).alias("n"))
    return n.join(targets, ["region", "sector"]).filter(F.col("n") - F.col("target") > classes)
