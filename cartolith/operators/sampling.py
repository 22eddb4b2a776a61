"""Stratified samples and splits.

Draws order rows by a digest of seed and id, so they don't depend on partitions. Rows are selected by counts of digests
(ranking.pieces), not numbered: classes are few, and no task sees all rows of one.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.operators.ranking import draw_key, numbered, pieces

SPLITS = ("train", "val", "test")
FRACTIONS = (0.70, 0.15, 0.15)
#: Groups (blocks) that a sequential choice may run over in a task; it raises beyond.
MOST_GROUPS = 1_000_000


def proportional_sample(df: DataFrame, cell: list[str], target: int | Column, threshold: int | Column | None = None, seed: int = 42, cls: str = "asset_type", key: str = "asset_id") -> DataFrame:
    """A cell of at most ``threshold`` rows is kept whole; of a larger one each class gives its rounded share of target.

    Rounding is half to even; shares need not sum to the target; a share of 0 drops the class.
    """
    threshold = target if threshold is None else threshold
    target, threshold = (F.lit(x) if isinstance(x, int) else x for x in (target, threshold))

    def limits(sizes: DataFrame) -> DataFrame:
        n = F.sum("size").over(Window.partitionBy(*cell))  # a row a class
        share = F.least(F.bround(F.col("size") / n * target, 0), F.col("size"))
        return sizes.withColumn("limits", F.array(F.when(n <= threshold, F.col("size")).otherwise(share).cast("long")))

    drawn = pieces(df, [*cell, cls], draw_key(seed, cls, key), key, limits, "__piece")
    return drawn.filter("__piece = 0").select(*df.columns)


def sample_summary(df: DataFrame, cell: list[str], target: int, threshold: int | None = None, cls: str = "asset_type") -> DataFrame:
    """Population, sample and note of each class of each cell."""
    threshold = target if threshold is None else threshold
    counts = df.groupBy(*cell, cls).agg(F.count(F.lit(1)).alias("in_population"))
    n = F.sum("in_population").over(Window.partitionBy(*cell))
    share = F.col("in_population") / n
    take = F.least(F.bround(share * target, 0), F.col("in_population")).cast("long")
    note = (
        F.when(n <= threshold, F.lit("all (population <= threshold)"))
        .when(take <= 0, F.lit("rounded to zero"))
        .when(take == F.col("in_population"), F.lit("all"))
        .otherwise(F.lit("sampled"))
    )
    return counts.select(
        *cell,
        cls,
        "in_population",
        F.when(n <= threshold, F.col("in_population")).otherwise(F.greatest(F.lit(0), take)).alias("in_sample"),
        F.round(share, 6).alias("proportion"),
        note.alias("note"),
    )


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42, cls: str = "asset_type", key: str = "asset_id") -> DataFrame:
    """Of the train rows of each class the rounded fraction, one at least; other rows stay."""
    kept = F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(fraction), 0)).cast("long")
    limits = lambda sizes: sizes.withColumn("limits", F.array(F.when(F.col("split") == "train", kept).otherwise(F.col("size"))))
    return pieces(df, ["split", cls], draw_key(seed, cls, key), key, limits, "__piece").filter("__piece = 0").drop("__piece")


def class_sample(df: DataFrame, share: float = 0.10, least: int = 20, most: int = 100, seed: int = 42, cls: str = "asset_type", key: str = "asset_id") -> DataFrame:
    """min(n, most, max(least, ceil(share n))) rows of each class in a fixed order of draw."""
    n = F.col("size")
    size = F.least(n, F.lit(most), F.greatest(F.lit(least), F.ceil(n * F.lit(share)))).cast("long")
    drawn = pieces(df, [cls], draw_key(seed, cls, key), key, lambda sizes: sizes.withColumn("limits", F.array(size)), "__piece")
    # the sample, ``most`` rows a class, is put in order; what is left out doesn't change ranks
    drawn = numbered(drawn.filter("__piece = 0").drop("__piece"), [cls], [draw_key(seed, cls, key), F.col(key)], "draw")
    sizes = df.groupBy(F.col(cls).alias("__cls")).agg(F.count(F.lit(1)).alias("class_size"))
    return drawn.join(sizes, F.col(cls).eqNullSafe(F.col("__cls"))).drop("__cls")


def persisted_sample(stored: DataFrame, fresh: DataFrame, cls: str = "asset_type", key: str = "asset_id") -> DataFrame:
    """A stored draw is never redrawn: classes that have one keep it, others get the fresh one."""
    return stored.unionByName(fresh.join(stored.select(cls).distinct(), cls, "left_anti"), allowMissingColumns=True)


def audit_holdout(candidates: DataFrame, held: DataFrame, decided: DataFrame, share: float = 0.10, seed: int = 42) -> DataFrame:
    """candidates (asset_id, source) with audit: earlier picks stay, new ones fill up each source's share, one at least.

    New picks come from assets that nobody has decided. held and decided: asset_id.
    """
    marks = candidates.join(held.select("asset_id", F.lit(True).alias("__held")), "asset_id", "left")
    marks = marks.join(decided.select("asset_id", F.lit(True).alias("__done")).distinct(), "asset_id", "left")
    marks = marks.fillna({"__held": False, "__done": False})
    marks = marks.withColumn("__free", ~F.col("__held") & ~F.col("__done"))
    want = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share), 0)) - F.sum(F.col("__held").cast("int"))
    wanted = marks.groupBy("source").agg(want.alias("__want"))  # a row a source
    limits = lambda sizes: sizes.join(wanted, "source").withColumn("limits", F.array(F.when(F.col("__free"), F.col("__want")).otherwise(0).cast("long")))
    out = pieces(marks, ["source", "__free"], draw_key(seed, "source", "asset_id"), "asset_id", limits, "__piece")
    return out.withColumn("audit", F.col("__held") | (F.col("__free") & (F.col("__piece") == 0))).select(*candidates.columns, "audit")


def uniform_sample(df: DataFrame, n: int, seed: int = 42, key: str = "asset_id") -> DataFrame:
    return df.orderBy(draw_key(seed, key), key).limit(n)


def random_split(df: DataFrame, cell: list[str], seed: int = 42, cls: str = "asset_type", key: str = "asset_id") -> DataFrame:
    """Train, val and test by class within a cell: the floors of their fractions, the rest to test."""
    out = pieces(df, [*cell, cls], draw_key(seed, cls, key), key, lambda sizes: sizes.withColumn("limits", split_limits(F.col("size"), FRACTIONS)), "__piece")
    return out.withColumn("split", split_of(F.col("__piece"))).drop("__piece")


def split_limits(n: Column, fractions: tuple) -> Column:
    """The last ranks of train and val among n rows: the floors of their fractions."""
    train, val = F.floor(n * F.lit(fractions[0])), F.floor(n * F.lit(fractions[1]))
    return F.array(train.cast("long"), (train + val).cast("long"))


def split_of(piece: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SPLITS)), piece + 1)


def block_split(tiles: DataFrame, stratum: str = "region", fractions=FRACTIONS, seed: int = 42) -> DataFrame:
    """Adds split and split_protocol: blocks are given, in a drawn order, to the split that lacks most rows.

    Tiles are first summed up to blocks; the sequential choice runs over the blocks of a stratum, a narrow row each (blocks of
    200 km are some 13 000 over all the earth; more than ``MOST_GROUPS`` raise). A block in two strata takes the assignment of
    the last stratum.
    """
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    blocks = tiles.groupBy(stratum, "block_id").agg(F.count(F.lit(1)).alias("n"))
    if blocks.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} blocks")
    blocks = blocks.withColumn("draw", draw_key(seed, stratum, "block_id"))

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "block_id"])
        aims = [f * part.n.sum() for f in fractions]
        have, out = [0, 0, 0], []
        for n in part.n:
            pick = max(range(3), key=lambda i: (aims[i] - have[i], -i))
            have[pick] += n
            out.append(SPLITS[pick])
        return pd.DataFrame({"stratum": part[stratum].astype(str), "block_id": part.block_id, "split": out})

    given = blocks.groupBy(stratum).applyInPandas(assign, "stratum string, block_id string, split string")
    given = given.groupBy("block_id").agg(F.max_by("split", "stratum").alias("split"))
    return tiles.join(given, "block_id").withColumn("split_protocol", F.lit("spatial_block"))


def class_fallback(split: DataFrame, classes: list[str], fractions=FRACTIONS, seed: int = 42) -> DataFrame:
    """Rows of rare classes are split at random instead, and marked."""
    limits = lambda sizes: sizes.withColumn("limits", split_limits(F.col("size"), fractions))
    rare = pieces(split.filter(F.col("asset_type").isin(classes)), ["asset_type"], draw_key(seed, "asset_type", "asset_id"), "asset_id", limits, "__piece")
    rare = rare.withColumn("split", split_of(F.col("__piece"))).drop("__piece")
    rare = rare.withColumn("split_protocol", F.lit("class_fallback"))
    return split.filter(~F.col("asset_type").isin(classes)).unionByName(rare)


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value of a column by row, and their percentages."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    out = df.groupBy(row).agg(*counts, F.count(F.lit(1)).alias("total"))
    return out.select(row, *values, "total", *(F.round(F.lit(100.0) * F.col(v) / F.col("total"), 2).alias(f"{v}_pct") for v in values))


def transitions(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """old_split, new_split, n, and the percentage of all rows whose split is unchanged (the same in each row)."""
    both = old.select(key, F.col("split").alias("old_split")).join(new.select(key, F.col("split").alias("new_split")), key)
    counts = both.groupBy("old_split", "new_split").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()  # over nine rows
    same = F.sum(F.when(F.col("old_split") == F.col("new_split"), F.col("n")).otherwise(0)).over(all_)
    return counts.withColumn("unchanged_pct", F.round(F.lit(100.0) * same / F.sum("n").over(all_), 2))


def split_violations(split: DataFrame, classes: list[str] | None = None, slack: float = 0.02) -> DataFrame:
    """rule, subject: unassigned rows, ids in two splits, incoherent blocks, classes missing from a split, drift of shares."""
    out = [
        split.filter(F.col("split").isNull() | ~F.col("split").isin(*SPLITS)).select(F.lit("unassigned").alias("rule"), F.col("asset_id").alias("subject")),
        split.groupBy("asset_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("two_splits").alias("rule"), F.col("asset_id").alias("subject")),
        split.filter("split_protocol = 'spatial_block'").groupBy("block_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("block").alias("rule"), F.col("block_id").alias("subject")),
        split.groupBy("asset_type").agg(F.count_distinct("split").alias("n")).filter("n < 3").select(F.lit("class_missing").alias("rule"), F.col("asset_type").alias("subject")),
    ]
    shares = split.agg(*((F.count(F.when(F.col("split") == s, 1)) / F.count(F.lit(1)) - f).alias(s) for s, f in zip(SPLITS, FRACTIONS, strict=True)))
    drift = shares.select(F.explode(F.array(*(F.when(F.abs(s) > slack, F.lit(s)) for s in SPLITS))).alias("subject")).filter("subject is not null")
    out.append(drift.select(F.lit("share").alias("rule"), "subject"))
    return reduce(DataFrame.union, out)


def artifact_violations(shipped: DataFrame, dataset: DataFrame, embedded: DataFrame | None = None, rare: list[str] = (), most_fallback: float = 0.5) -> DataFrame:
    """rule, subject of a shipped split against the dataset that it belongs to.

    Ids that are only in one of them, columns without a value, protocols that no rule knows, rare classes that were not
    split by class and others that were, a share of class splits above ``most_fallback``, and rows without an embedding.
    shipped: asset_id, asset_type, split, split_protocol, block_id; dataset and embedded: asset_id.
    """
    row = lambda df, rule, subject="asset_id": df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    ids, fallback = shipped.select("asset_id"), F.col("split_protocol") == "class_fallback"
    columns = ("asset_type", "split", "split_protocol", "block_id")
    empty = F.explode(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull()))
    out = [
        row(ids.join(dataset.select("asset_id"), "asset_id", "left_anti"), "not_in_dataset"),
        row(dataset.select("asset_id").join(ids, "asset_id", "left_anti"), "not_in_split"),
        shipped.select(empty.alias("column")).distinct().select(F.lit("empty_column").alias("rule"), F.col("column").alias("subject")),
        row(shipped.filter(~F.col("split_protocol").isin("spatial_block", "class_fallback")).select("split_protocol").distinct(), "unknown_protocol", "split_protocol"),
        row(shipped.filter(fallback != F.col("asset_type").isin(*rare)).select("asset_type").distinct(), "wrong_protocol", "asset_type"),
    ]
    share = shipped.agg((F.count(F.when(fallback, 1)) / F.count(F.lit(1))).alias("share")).filter(F.col("share") > most_fallback)
    out.append(share.select(F.lit("fallback_share").alias("rule"), F.lit("class_fallback").alias("subject")))
    if embedded is not None:
        out.append(row(ids.join(embedded.select("asset_id"), "asset_id", "left_anti"), "no_embedding"))
    return reduce(DataFrame.union, out)


def lightest_folds(groups: pd.DataFrame, folds: int) -> pd.DataFrame:
    """Groups (group, n), largest first, each to the lightest fold."""
    load, out = [0] * folds, []
    for r in groups.sort_values(["n", "group"], ascending=[False, True]).itertuples():
        k = min(range(folds), key=lambda i: (load[i], i))
        load[k] += r.n
        out.append((r.group, k))
    return pd.DataFrame(out, columns=["group", "fold"])


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds fold: whole groups, largest first, to the lightest fold.

    The choice is sequential and runs in one task over the groups' sizes, a narrow row each; spatial blocks of 200 km are
    some 13 000 over all the earth. More groups than ``MOST_GROUPS`` raise.
    """
    sizes = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    if sizes.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    given = sizes.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda p: lightest_folds(p, folds), "group string, fold int")
    return df.join(given.withColumnRenamed("group", group), group)
