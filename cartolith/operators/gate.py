"""Gate of published results: a table of constraints against a table of what was found, one join and one aggregate.

A measure is a value under scope, model, protocol, scale, metric and field. A constraint says what a measure has to be, within
a tolerance, or that it has to be absent. The list of conditions, the length of their schema and the constants are fixed; the
values themselves are a table that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["scope", "model", "protocol", "scale", "metric", "field"]

# Models that were probed and tuned, those with one protocol, and the two scales.
TUNED = ("SatlasPretrain S1", "SatlasPretrain S2", "CROMA", "Prithvi-EO-2.0", "OlmoEarth v1.1-Base", "DINOv3 ViT-L/16")
ONE_WAY = (("AlphaEarth Foundations", "LP"), ("Supervised ResNet-18", "Sup"), ("Random Features", "LP"))
SCALES = ("1.0x", "0.3x")
#: Classes of the schema, rows of a seed's test, rows of each sector in the condition that is looked into.
ENTRIES = 13
CONSTANTS = {"test_n_per_seed": 2689, "test_n_per_seed_13class": 2813}
SECTOR_ROWS = {"transport": 862, "telecom": 100, "water": 802, "energy": 925}
LOOKED_INTO = ("DINOv3 ViT-L/16", "FT", "1.0x")
COUNT_TOLERANCE = 0.5


def conditions() -> list[tuple[str, str, str]]:
    """The thirty conditions: model, protocol, scale."""
    both = [(m, p) for m in TUNED for p in ("LP", "FT")]
    return [(m, p, s) for m, p in [*both, *ONE_WAY] for s in SCALES]


def measures(found: DataFrame, meta: DataFrame) -> DataFrame:
    """Results as measures: KEY and value.

    found: model, protocol, scale, entries (of the per-class list), sector_rows (map), values (map of metric to mean and
    std); meta: name, value.
    """
    own = [F.lit("condition").alias("scope"), "model", "protocol", "scale"]
    entries = found.select(*own, F.lit("entries").alias("metric"), F.lit("n").alias("field"), F.col("entries").cast("double").alias("value"))
    sectors = found.select(*own, F.explode("sector_rows").alias("metric", "n")).select(*KEY[:4], F.concat(F.lit("rows."), "metric").alias("metric"), F.lit("n").alias("field"), F.col("n").cast("double").alias("value"))
    pairs = found.select(*own, F.explode("values").alias("metric", "v"))
    values = pairs.select(*KEY[:4], "metric", F.explode(F.create_map(F.lit("mean"), F.col("v.mean"), F.lit("std"), F.col("v.std"))).alias("field", "value"))
    none = [F.lit("").alias(c) for c in KEY[1:4]]
    known = meta.select(F.lit("meta").alias("scope"), *none, F.col("name").alias("metric"), F.lit("n").alias("field"), F.col("value").cast("double").alias("value"))
    number = found.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("meta").alias("scope"), *none, F.lit("conditions").alias("metric"), F.lit("n").alias("field"), "value")
    return entries.union(sectors).union(values).union(known).union(number)


def constraints(spark: SparkSession, expected: DataFrame, constants: dict[str, float] | None = None, sector_rows: dict[str, float] | None = None) -> DataFrame:
    """KEY, expected, tolerance, absent. expected: model, protocol, scale, metric, field, expected (null: absent), tolerance."""
    constants, sector_rows = CONSTANTS if constants is None else constants, SECTOR_ROWS if sector_rows is None else sector_rows
    rows = [("condition", *c, "entries", "n", float(ENTRIES)) for c in conditions()]
    rows += [("condition", *LOOKED_INTO, f"rows.{k}", "n", float(v)) for k, v in sector_rows.items()]
    rows += [("meta", "", "", "", k, "n", float(v)) for k, v in {**constants, "conditions": len(conditions())}.items()]
    fixed = spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in KEY), "expected double"])).withColumn("tolerance", F.lit(COUNT_TOLERANCE))
    return fixed.unionByName(expected.withColumn("scope", F.lit("condition")).select(*fixed.columns)).withColumn("absent", F.col("expected").isNull())


def judged(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Each constraint, and each found condition that none names, with its verdict: ok, off, missing, unexpected, unlisted."""
    both = found.join(rules, KEY, "full_outer")
    ruled, there = F.col("absent").isNotNull(), F.col("value").isNotNull()
    near = F.abs(F.col("value") - F.col("expected")) < F.col("tolerance")
    verdict = (
        F.when(~ruled, F.when(F.col("metric") == "entries", "unlisted"))
        .when(F.col("absent"), F.when(there, "unexpected").otherwise("ok"))
        .when(~there, "missing")
        .when(near & ~F.isnan("value"), "ok")
        .otherwise("off")
    )
    return both.withColumn("verdict", verdict).filter("verdict is not null").select(*KEY, F.col("value").alias("found"), "expected", "verdict")


def verdicts(judged_: DataFrame) -> DataFrame:
    """Constraints by scope, metric and verdict, with the largest difference."""
    return judged_.groupBy("scope", "metric", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("found") - F.col("expected"))).alias("largest"))
