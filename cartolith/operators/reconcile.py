"""Attempted against kept: yields, failures, reconciliation, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), 2)


def funnel(assets: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Stages and their yields. assets: fetched, passed, accepted."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = assets.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("extracted"), n("fetched").alias("n_fetched"), n("passed").alias("n_passed"), n("accepted").alias("n_accepted"))
    return out.withColumn("fetch_pct", pct(F.col("n_fetched"), F.col("extracted"))).withColumn("qc_pct", pct(F.col("n_passed"), F.col("n_fetched"))).withColumn("overall_pct", pct(F.col("n_accepted"), F.col("extracted")))


def failed(attempted: DataFrame, kept: DataFrame, cell: list[str]) -> DataFrame:
    """Attempted assets that weren't kept in their cell; ids are compared as text."""
    a = attempted.withColumn("asset_id", F.col("asset_id").cast("string"))
    b = kept.select(*cell, F.col("asset_id").cast("string").alias("asset_id")).distinct()
    return a.join(b, [*cell, "asset_id"], "left_anti")


def marked_complete(results: DataFrame, cell: list[str], status: str = "status") -> DataFrame:
    """A completion marker for each cell all of whose rows ended in some way: cell, n, n_ok."""
    done = F.count(F.when(F.col(status).isNotNull(), 1))
    n = F.count(F.lit(1))
    out = results.groupBy(*cell).agg(n.alias("n"), done.alias("done"), F.count(F.when(F.col(status) == "ok", 1)).alias("n_ok"))
    return out.filter("n = done").drop("done")


def skip_done(cells: DataFrame, markers: DataFrame, cell: list[str]) -> DataFrame:
    """The cells without a completion marker."""
    return cells.join(markers.select(*cell).distinct(), cell, "left_anti")


def with_fallback(first: DataFrame, second: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of the first input, and of the second one those of cells that the first lacks."""
    return first.unionByName(second.join(first.select(*cell).distinct(), cell, "left_anti"))


def pending(assets: DataFrame, completed: DataFrame, key: str = "asset_id") -> DataFrame:
    return assets.join(completed.select(key), key, "left_anti")


def yield_grid(attempted: DataFrame, kept: DataFrame, degrees: float = 5.0, least: int = 50) -> DataFrame:
    """Yield of each grid cell with enough attempts. Both: lat, lon."""
    cell = lambda c: (F.floor(F.col(c) / degrees) * degrees).cast("double")
    count = lambda df, name: df.groupBy(cell("lat").alias("lat0"), cell("lon").alias("lon0")).agg(F.count(F.lit(1)).alias(name))
    out = count(attempted, "attempted").filter(F.col("attempted") >= least).join(count(kept, "kept"), ["lat0", "lon0"], "left").fillna({"kept": 0})
    return out.withColumn("yield_pct", pct(F.col("kept"), F.col("attempted")))


def bands(df: DataFrame, column: str, edges: list[tuple[str, float, float]]) -> DataFrame:
    """Rows of each named half-open band of a coordinate."""
    name = None
    for label, low, high in edges:
        test = (F.col(column) >= low) & (F.col(column) < high)
        name = F.when(test, label) if name is None else name.when(test, label)
    return df.withColumn("band", name).filter("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def reconciled(table: DataFrame, tiles: DataFrame, key: str = "asset_id") -> DataFrame:
    """status of each id: kept (in both), orphan (tile only), missing (table only)."""
    a = table.select(key).distinct().withColumn("in_table", F.lit(True))
    b = tiles.select(key).distinct().withColumn("in_tiles", F.lit(True))
    status = F.when(F.col("in_table") & F.col("in_tiles"), "kept").when(F.col("in_tiles"), "orphan").otherwise("missing")
    return a.join(b, key, "full_outer").fillna(False).select(key, status.alias("status"))


def run_log(entries: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each region: the latest value given for each field; fields that the entries lack are refused.

    entries: region, seq and fields, nulls where not given; any other column is unknown and raises.
    """
    unknown = set(entries.columns) ^ {"region", "seq", *fields}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    region = F.lower(F.trim("region")).alias("region")
    latest = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return entries.groupBy(region).agg(*latest)


def modality_counts(records: DataFrame) -> DataFrame:
    """Tiles of each modality from combinations joined by +."""
    return records.select(F.explode(F.split("modalities", r"\+")).alias("modality")).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


def latest_results(earlier: DataFrame, new: DataFrame, key: str = "asset_id", order: str = "seq") -> DataFrame:
    """Earlier and new results, the latest of each id."""
    both = earlier.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")
