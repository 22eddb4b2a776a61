"""Decision logs, agents, label status."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("accept", "relabel", "unsure")


def latest(log: DataFrame, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The last decision of each asset and reviewer, in the order of the log or any other."""
    rest = [c for c in log.columns if c not in ("asset_id", "reviewer")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("e")
    return log.groupBy("asset_id", "reviewer").agg(last).select("asset_id", "reviewer", *(F.col(f"e.{c}") for c in rest))


def invalid(log: DataFrame) -> DataFrame:
    """Decisions with a blank reviewer or an unknown decision."""
    bad = F.coalesce(F.trim("reviewer"), F.lit("")).isin("") | ~F.coalesce(F.col("decision"), F.lit("")).isin(*DECISIONS)
    return log.filter(bad)


def status(entries: DataFrame, second_opinion: bool = False) -> DataFrame:
    """asset_id, status, final_label, reviewers of the assets that anyone decided. entries: latest()."""
    made = F.col("decision") != "unsure"
    groups = entries.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(made, 1)).alias("labels"),
        F.count_distinct(F.when(made, F.col("label"))).alias("kinds"),
        F.max(F.when(made, F.col("label"))).alias("label"),
        F.bool_or(F.col("decision") == "accept").alias("accepted"),
        F.array_sort(F.collect_set("reviewer")).alias("reviewers"),
    )
    agree = F.col("kinds") == 1
    if second_opinion:
        word = (
            F.when(F.col("accepted") & (F.col("n") == 1), "done")
            .when(F.col("n") == 1, "needs_second")
            .when((F.col("labels") >= 2) & agree, "done")
            .otherwise("disputed")
        )
    else:
        word = F.when(F.col("labels") == 0, "unsure").when(agree, "done").otherwise("disputed")
    out = groups.withColumn("status", word)
    return out.select("asset_id", "status", F.when(F.col("status") == "done", F.col("label")).otherwise("").alias("final_label"), "reviewers")


def wants(queue: DataFrame, states: DataFrame, reviewer: str, second_opinion: bool = False) -> DataFrame:
    """asset_id, pass: first, revisit or second for this reviewer, else empty."""
    both = queue.select("asset_id").join(states, "asset_id", "left")
    mine = F.coalesce(F.array_contains("reviewers", reviewer), F.lit(False))
    if second_opinion:
        later = F.when(~mine & F.col("status").isin("needs_second", "disputed"), "second")
    else:
        later = F.when(mine & (F.col("status") == "unsure"), "revisit")
    return both.select("asset_id", F.when(F.col("status").isNull(), "first").otherwise(F.coalesce(later, F.lit(""))).alias("pass"))


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """What an import would append: rows that differ from the latest ones. Both: asset_id, reviewer, decision, label, note."""
    old = entries.select("asset_id", "reviewer", *(F.col(c).alias(f"o_{c}") for c in ("decision", "label", "note")))
    both = new.join(old, ["asset_id", "reviewer"], "left")
    same = F.lit(True)
    for c in ("decision", "label", "note"):
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return both.filter(~same).select(*new.columns)


def routed(agents: DataFrame, threshold: Column | float = 0.85) -> DataFrame:
    """Adds action, label, reasons. agents: osm_label and a_/b_ action, label, confidence, quality (b may lack quality)."""
    a_cls = F.when(F.col("a_action") == "confirm", F.col("osm_label")).otherwise(F.col("a_label"))
    b_quality = F.col("b_quality") if "b_quality" in agents.columns else F.lit("adequate")
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    abstained = (F.col("a_action") == "request_review") | (F.col("b_action") == "request_review")
    reasons = F.filter(
        F.array(
            F.when(abstained, "agent_abstention").when(~a_cls.eqNullSafe(F.col("b_label")), "agent_disagreement"),
            F.when(F.least("a_confidence", "b_confidence") < threshold, "low_confidence"),
            F.when((F.col("a_quality") == "poor") | (b_quality == "poor"), "poor_imagery"),
        ),
        lambda x: x.isNotNull(),
    )
    out = agents.withColumn("reasons", reasons).withColumn("__a", a_cls)
    review = F.size("reasons") > 0
    action = F.when(review, "request_review").when(F.col("__a") == F.col("osm_label"), "confirm").otherwise("relabel")
    return out.withColumn("action", action).withColumn("label", F.when(review, "").otherwise(F.col("__a"))).drop("__a")


def agent_scores(decided: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Coverage and selective error. decided: action, label, human (null where the person was unsure)."""
    auto = F.col("action") != "request_review"
    resolved = auto & F.col("human").isNotNull()
    wrong = resolved & (F.col("label") != F.col("human"))
    n = lambda c: F.count(F.when(c, 1))
    return decided.groupBy(*group).agg(
        F.count(F.lit(1)).alias("scored"),
        n(auto).alias("automatic"),
        F.round(n(auto) / F.count(F.lit(1)), 3).alias("coverage"),
        n(resolved).alias("resolved"),
        n(wrong).alias("wrong"),
        n(wrong & (F.col("action") == "confirm")).alias("false_confirms"),
        n(wrong & (F.col("action") == "relabel")).alias("false_relabels"),
        F.round(F.try_divide(n(wrong), n(resolved)), 3).alias("selective_error"),
    )


def role_scores(agents: DataFrame, role: str) -> DataFrame:
    """answered, abstained, correct of one role where the person decided. agents: osm_label, human, <role>_action, <role>_label."""
    action = F.col(f"{role}_action")
    said = F.when(action.isin("relabel", "classify"), F.col(f"{role}_label")).when(action == "confirm", F.col("osm_label"))
    n = lambda c: F.count(F.when(c, 1))
    return agents.filter("human is not null").agg(
        n(said.isNotNull()).alias("answered"),
        n(said.isNull()).alias("abstained"),
        n(said == F.col("human")).alias("correct"),
    ).withColumn("role", F.lit(role))


THRESHOLDS = tuple((50 + 5 * i) / 100 for i in range(11))


def sweep(agents: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Scores at the thresholds 0.50, 0.55, ... 1.00 over decided tiles.

    Tiles are counted once by the number of thresholds that their lower confidence reaches: twelve rows a group at most, which
    are then summed up for each threshold.
    """
    steps = F.array(*(F.lit(t) for t in THRESHOLDS))
    base = routed(agents.filter("human is not null"), 0.0)
    base = base.withColumn("reached", F.size(F.filter(steps, lambda t: F.least("a_confidence", "b_confidence") >= t)))
    counts = agent_scores(base, (*group, "reached")).drop("coverage", "selective_error")
    counts = counts.select("*", F.posexplode(steps).alias("step", "threshold"))
    sums = ("automatic", "resolved", "wrong", "false_confirms", "false_relabels")
    sure = F.col("reached") > F.col("step")
    out = counts.groupBy(*group, "threshold").agg(F.sum("scored").alias("scored"), *(F.sum(F.when(sure, F.col(c)).otherwise(0)).alias(c) for c in sums))
    return out.select(
        *group, "threshold", "scored", "automatic", F.round(F.col("automatic") / F.col("scored"), 3).alias("coverage"), "resolved", "wrong",
        "false_confirms", "false_relabels", F.round(F.try_divide("wrong", "resolved"), 3).alias("selective_error"),
    )


def chosen_threshold(swept: DataFrame, target_error: float = 0.05) -> DataFrame:
    """The lowest threshold whose selective error meets the target, 1.0 if none does."""
    ok = F.when(F.col("selective_error") <= target_error, F.col("threshold"))
    return swept.agg(F.coalesce(F.min(ok), F.lit(1.0)).alias("threshold"))


def calibrate(agents: DataFrame, target_error: float = 0.05, group: tuple[str, ...] = ()) -> DataFrame:
    """Threshold chosen on the calibration half, scores of the held-out half at it."""
    chosen = chosen_threshold(sweep(agents.filter("half = 'calibration'")), target_error).first()["threshold"]
    held = routed(agents.filter("half = 'heldout' and human is not null"), chosen)
    return agent_scores(held.withColumn("threshold", F.lit(chosen)), (*group, "threshold"))


def disputes(agents: DataFrame, threshold: float) -> DataFrame:
    """Tiles on which both agents agree, confidently, against the person."""
    out = routed(agents.filter("human is not null"), threshold)
    return out.filter("action <> 'request_review' and label <> human")


def agent_violations(rows: DataFrame, classes: list[str], actions: dict[str, tuple[str, ...]]) -> DataFrame:
    """role, id, rule for each rule that an agent's row breaks.

    rows: role, id, action, label, confidence, image_quality, evidence_ids, reason, allowed (the packet's evidence ids).
    """
    allowed = F.lit(False)
    for role, words in actions.items():
        allowed = allowed | ((F.col("role") == role) & F.col("action").isin(*words))
    c = F.col("confidence")
    cites = F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>"))
    rules = {
        "action": ~F.coalesce(allowed, F.lit(False)),
        "label": F.col("action").isin("relabel", "classify") & ~F.coalesce(F.col("label").isin(classes), F.lit(False)),
        "confidence": c.isNull() | F.isnan(c) | ~c.between(0, 1),
        "image_quality": ~F.coalesce(F.col("image_quality").isin("adequate", "poor"), F.lit(False)),
        "citations": (F.size(cites) == 0) | (F.size(F.array_except(cites, F.col("allowed"))) > 0),
        "imagery": ~F.exists(cites, lambda x: x.endswith(":sentinel2") | x.endswith(":naip")),
        "reason": F.coalesce(F.trim("reason"), F.lit("")) == "",
    }
    named = F.explode(F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull()))
    own = rows.select("role", "id", named.alias("rule"))
    twice = rows.groupBy("role", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.union(twice.select("role", "id", F.lit("duplicate").alias("rule")))


def label_status(queue: DataFrame, entries: DataFrame, agent: DataFrame, reviewer: str, threshold: float = 0.65) -> DataFrame:
    """One label for each tile by precedence: the person, an official source, a confident agent, the original.

    queue: asset_id, asset_type; entries: latest(); agent: asset_id, action, label, confidence.
    """
    person = entries.filter(F.col("reviewer") == reviewer).select("asset_id", F.col("decision").alias("p_decision"), F.col("label").alias("p_label"))
    source = entries.filter("reviewer = 'source'").select("asset_id", F.lit(True).alias("sourced"))
    rows = agent.select("asset_id", F.col("action").alias("g_action"), F.col("label").alias("g_label"), F.col("confidence").alias("g_confidence"))
    both = queue.join(person, "asset_id", "left").join(source, "asset_id", "left").join(rows, "asset_id", "left")
    sure = (F.col("g_action") != "request_review") & (F.col("g_confidence") >= threshold)
    by = (
        F.when(F.col("p_decision") == "unsure", "human_unsure")
        .when(F.col("p_decision").isNotNull(), "human")
        .when(F.col("sourced"), "official_source")
        .when(F.col("g_action").isNull(), "unscreened")
        .when(sure, "agent")
        .otherwise("agent_unsure")
    )
    osm = F.col("asset_type")
    label = (
        F.when(F.col("p_decision") == "relabel", F.col("p_label"))
        .when(F.col("p_decision").isNotNull() | F.col("sourced"), osm)
        .when(sure & (F.col("g_action") != "confirm"), F.coalesce(F.nullif(F.col("g_label"), F.lit("")), osm))
        .otherwise(osm)
    )
    return both.select("asset_id", osm.alias("original_label"), label.alias("screened_label"), by.alias("checked_by"))


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for whole a and b: a sum of binomial terms."""
    out = []
    for xi, ai, bi in zip(x, a.astype(int), b.astype(int), strict=True):
        n = ai + bi - 1
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
        k = np.arange(ai, n + 1)
        terms = logs[n] - logs[k] - logs[n - k] + k * np.log(max(xi, 1e-300)) + (n - k) * np.log(max(1 - xi, 1e-300))
        out.append(np.exp(terms).sum())
    return np.array(out)


def _beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (low + high) / 2
        below = _beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def clopper_pearson(k: Column, n: Column) -> Column:
    """Exact 95 % interval (low, high) of k successes in n; null for n = 0. A few rows: one for each class."""
    return F.pandas_udf(_interval, "low double, high double")(k, n)


def _interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    k, n = k.to_numpy(float), n.to_numpy(float)
    low, high = np.full(len(k), np.nan), np.full(len(k), np.nan)
    low[n > 0], high[n > 0] = 0.0, 1.0
    some, rest = k > 0, k < n
    low[some] = _beta_quantile(0.025, k[some], (n - k + 1)[some])
    high[rest] = _beta_quantile(0.975, (k + 1)[rest], (n - k)[rest])
    return pd.DataFrame({"low": low, "high": high})


def class_accuracy(sample: DataFrame, decided: DataFrame, stop_after: int = 30, stop_width: float = 12.0) -> DataFrame:
    """Label accuracy of each class with its interval; unsure ones don't count; whether to go on.

    sample: asset_id, asset_type, class_size; decided: asset_id, decision, label of one reviewer.
    """
    both = sample.join(decided.select("asset_id", "decision", "label"), "asset_id", "left")
    right = (F.col("decision") == "accept") | (F.col("label") == F.col("asset_type"))
    sure = F.col("decision").isNotNull() & (F.col("decision") != "unsure")
    n = lambda c: F.count(F.when(c, 1))
    out = both.groupBy("asset_type").agg(
        F.max("class_size").alias("class_size"),
        F.count(F.lit(1)).alias("sampled"),
        n(F.col("decision").isNotNull()).alias("reviewed"),
        n(F.col("decision") == "unsure").alias("unsure"),
        n(sure).alias("decided"),
        n(sure & right).alias("correct"),
    )
    out = out.withColumn("ci", clopper_pearson(F.col("correct"), F.col("decided")))
    enough = (F.col("reviewed") >= F.col("sampled")) | (
        (F.col("decided") >= F.least(F.lit(stop_after), F.col("sampled"))) & (100 * (F.col("ci.high") - F.col("ci.low")) <= stop_width)
    )
    return out.select(
        "asset_type", "class_size", "sampled", "reviewed", "unsure", "correct",
        F.round(F.try_divide(F.col("correct") * 100.0, F.col("decided")), 1).alias("accuracy_pct"),
        F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), enough.alias("enough"),
    )


def fused(evidence: DataFrame) -> DataFrame:
    """One row for each asset: non-empty texts joined in the order of the sources, corroborated if any is."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text")))), lambda x: x["text"])
    return evidence.groupBy("asset_id").agg(F.array_join(texts, " | ").alias("evidence"), F.bool_or("corroborated").alias("corroborated"))


def auto_accept(candidates: DataFrame, entries: DataFrame, reviewer: str = "source") -> DataFrame:
    """candidates (asset_id, source, rule, evidence, audit) with audit_kind and verdict, and the note of accepted ones."""
    who = entries.groupBy("asset_id").agg(
        F.bool_or(F.col("reviewer") != reviewer).alias("human"), F.bool_or(F.col("reviewer") == reviewer).alias("own")
    )
    both = candidates.join(who, "asset_id", "left").fillna({"human": False, "own": False})
    kind = F.when(F.col("audit"), "held_back").when(F.col("human"), "already_reviewed").otherwise("")
    verdict = F.when(F.col("audit"), "held_back").when(F.col("own"), "already_accepted").when(F.col("human"), "human_decided").otherwise("accepted")
    note = F.concat(F.lit("auto-accepted ("), "source", F.lit("): "), "rule", F.lit(". "), F.split("evidence", r" \| ")[0])
    out = both.withColumn("audit_kind", kind).withColumn("verdict", verdict)
    return out.select(*candidates.columns, "audit_kind", "verdict", F.when(F.col("verdict") == "accepted", note).alias("note"))
