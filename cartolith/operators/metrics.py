"""Confusion matrices and what follows from them. Long form: group columns, truth, pred, n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, classes: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every (truth, pred) of the full class grid, zeros included. preds: group columns, truth, pred."""
    spark = preds.sparkSession
    found = preds.groupBy(*group, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("pred"))
    full = preds.select(*group).distinct().join(grid, how="cross") if group else grid  # classes squared for each group
    return full.join(found, [*group, "truth", "pred"], "left").fillna({"n": 0})


def row_share(matrix: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds share of the row, 0 for empty rows."""
    total = F.sum("n").over(Window.partitionBy(*group, "truth"))
    return matrix.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(matrix: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """cls, tp, support, predicted, precision, recall, f1; 0 where a denominator is."""
    both = matrix.select(*group, F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("x"))
    sums = both.groupBy(*group, "x.cls").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "support", "predicted")))
    p, r = safe(F.col("tp"), F.col("predicted")), safe(F.col("tp"), F.col("support"))
    out = sums.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", safe(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def overall(classes: DataFrame, group: tuple[str, ...] = (), present: bool = False) -> DataFrame:
    """Macro and weighted F1, accuracy and total. present: macro F1 over classes in truth or prediction only."""
    macro = F.avg(F.when((F.col("support") > 0) | (F.col("predicted") > 0), F.col("f1"))) if present else F.avg("f1")
    total = F.sum("support")
    return classes.groupBy(*group).agg(
        macro.alias("macro_f1"),
        safe(F.sum(F.col("support") * F.col("f1")), total).alias("weighted_f1"),
        safe(F.sum("tp"), total).alias("accuracy"),
        total.alias("total"),
    )


def by_sector(classes: DataFrame, sectors: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the classes' F1 of the full test set by sector, its rows and accuracy. sectors: cls, sector."""
    return classes.join(F.broadcast(sectors), "cls").groupBy(*group, "sector").agg(
        F.sum("support").alias("n"), F.avg("f1").alias("macro_f1"), safe(F.sum("tp"), F.sum("support")).alias("accuracy")
    )


def kept_metrics(matrix: DataFrame, keep: list[int], group: tuple[str, ...] = ()) -> DataFrame:
    """Metrics over some classes: recall over the rows as they were, precision over the kept columns of kept rows."""
    rows = matrix.filter(F.col("truth").isin(keep))
    support = rows.groupBy(*group, F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    columns = rows.filter(F.col("pred").isin(keep)).groupBy(*group, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    both = support.join(columns, [*group, "cls"], "left")
    p, r = safe(F.col("tp"), F.col("predicted")), safe(F.col("tp"), F.col("support"))
    return both.groupBy(*group).agg(
        safe(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(p).alias("macro_precision"),
        F.avg(r).alias("macro_recall"),
        safe(F.sum(F.col("support") * p), F.sum("support")).alias("weighted_precision"),
    )


def refit(classes: DataFrame, keep: list[int], group: tuple[str, ...] = ()) -> DataFrame:
    """Macro and support-weighted F1 over the kept classes."""
    kept = classes.filter(F.col("cls").isin(keep))
    return kept.groupBy(*group).agg(F.avg("f1").alias("macro_f1"), safe(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("weighted_f1"))


def over_seeds(values: DataFrame, metric: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation and the values in the order of the seeds."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seed", metric))), lambda x: x[metric])
    return values.groupBy(*group).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), listed.alias("per_seed"))


def best_epochs(epochs: DataFrame, run: tuple[str, ...]) -> DataFrame:
    """The epoch with the best validation F1 of each run and seed, the earliest on ties."""
    return epochs.groupBy(*run, "seed").agg(F.max_by("epoch", F.struct(F.col("val_f1"), -F.col("epoch"))).alias("best_epoch"), F.max("val_f1").alias("best_f1"))


def curves(epochs: DataFrame, run: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each epoch, up to the end of the shortest seed."""
    ends = epochs.groupBy(*run, "seed").agg(F.max("epoch").alias("end")).groupBy(*run).agg(F.min("end").alias("end"))
    return epochs.join(ends, list(run)).filter("epoch <= end").groupBy(*run, "epoch").agg(F.avg("val_f1").alias("mean"), F.stddev_pop("val_f1").alias("std"))


def curve_tail(epochs: DataFrame, run: tuple[str, ...], last: int = 5) -> DataFrame:
    """Mean and population deviation over the last epochs of a run's curve, all seeds together, up to the end of the shortest."""
    ends = epochs.groupBy(*run, "seed").agg(F.max("epoch").alias("end")).groupBy(*run).agg(F.min("end").alias("end"))
    tail = epochs.join(ends, list(run)).filter((F.col("epoch") <= F.col("end")) & (F.col("epoch") > F.col("end") - last))
    return tail.groupBy(*run).agg(F.avg("val_f1").alias("tail_mean"), F.stddev_pop("val_f1").alias("tail_std"), F.count(F.lit(1)).alias("points"))


def adaptation_pairs(conditions: DataFrame, baseline: str, metric: str = "f1") -> DataFrame:
    """A row for each model: probe and fine-tuned score, what tuning adds, and its lead over the fine-tuned baseline model.

    Best fine-tuned score first; a model without one comes last. conditions: model, protocol (LP, FT), the metric.
    """
    one = lambda p: F.max(F.when(F.col("protocol") == p, F.col(metric)))
    pairs = conditions.groupBy("model").agg(one("LP").alias("lp"), one("FT").alias("ft"))
    base = pairs.agg(F.max(F.when(F.col("model") == baseline, F.col("ft"))).alias("base"), F.lit(0).alias("key"))
    out = pairs.withColumn("key", F.lit(0)).join(F.broadcast(base), "key")  # a row
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("ft"), "model"))  # a row for each model
    return out.select("model", "lp", "ft", (F.col("ft") - F.col("lp")).alias("gain"), (F.col("ft") - F.col("base")).alias("lead"), place.alias("place"))


def extremes(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the highest value and the k with the lowest, as side top or bottom."""
    side = lambda name, order: df.orderBy(order, *ties).limit(k).withColumn("side", F.lit(name))
    return side("top", F.col(value).desc()).union(side("bottom", F.col(value).asc()))


def wall_clock(epochs: DataFrame, run: tuple[str, ...]) -> DataFrame:
    """Seconds by run: mean of the seeds and total; whether seeds have unequal epochs; the mean as h/m/s."""
    seeds = epochs.groupBy(*run, "seed").agg(F.sum("time_s").alias("s"), F.count(F.lit(1)).alias("e"))
    out = seeds.groupBy(*run).agg(F.avg("s").alias("mean_s"), F.sum("s").alias("total_s"), F.min("e").alias("least_epochs"), F.max("e").alias("most_epochs"))
    whole = F.floor("mean_s").cast("long")
    text = F.format_string("%dh %02dm %02ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return out.withColumn("uneven", F.col("least_epochs") != F.col("most_epochs")).withColumn("mean_text", text)


def support_violations(matrix: DataFrame) -> DataFrame:
    """Classes whose row sums differ between seeds."""
    rows = matrix.groupBy("seed", "truth").agg(F.sum("n").alias("support"))
    return rows.groupBy("truth").agg(F.count_distinct("support").alias("sums")).filter("sums > 1")


def class_weights(labels: DataFrame, cls: str, most: float | None = None) -> DataFrame:
    """Weight total / (classes * n) of each class, at most ``most``."""
    n = labels.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row for each class
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return n.select(cls, "n", (F.least(weight, F.lit(most)) if most else weight).alias("weight"))


def out_of_tolerance(found: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Expected values that are missing or off, and found ones that aren't expected."""
    a = found.select(*keys, F.col(value).alias("found"))
    b = expected.select(*keys, F.col(value).alias("expected"))
    off = F.col("found").isNull() | F.col("expected").isNull() | (F.abs(F.col("found") - F.col("expected")) >= tolerance)
    return a.join(b, keys, "full_outer").filter(off)
