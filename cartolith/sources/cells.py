"""Tables kept by cell: a run replaces its own cells only, and marks each one complete after its data.

Layout: ``data`` holds a folder for each cell, ``markers`` a log of what became of the cells. A run logs that it began its
cells, replaces their data (each cell's folder at once, others' files stay as they are), counts what lies there and logs the
counts. A cell counts as done if the last that the log says of it is "done": one whose run was killed anywhere between is
done again, however much of its data was written, and readers leave it out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_run() -> str:
    """A name for a run; later ones sort after."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _log(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{path}/markers")


def begin(cells: DataFrame, path: str, run: str) -> None:
    """Logs that a run is about to replace these cells."""
    rows = cells.distinct().select("*", F.lit(run).alias("run"), F.lit("begun").alias("state"), F.lit(0).cast("long").alias("n"))
    _log(rows, path)


def save(rows: DataFrame, path: str, cell: list[str]) -> None:
    """Replaces the data of the cells that rows has; of a cell with many rows several tasks write files."""
    dealt = rows.hint("rebalance", *cell)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell).parquet(f"{path}/data")


def finish(cells: DataFrame, path: str, cell: list[str], run: str, counts: dict[str, Column] | None = None) -> None:
    """Logs what lies in the data of the cells: n rows, and other counts, once it's all written. Cells without rows have none."""
    spark, counts = cells.sparkSession, counts or {}
    own = cells.select(*cell).distinct()
    found = own.withColumn("n", F.lit(0).cast("long"))
    if _exists(spark, f"{path}/data"):
        rows = _typed(spark.read.parquet(f"{path}/data"), own, cell).join(F.broadcast(own), cell, "left_semi")
        found = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items()))
        found = own.join(found, cell, "left").fillna(0)
    _log(found.select(*cell, F.lit(run).alias("run"), F.lit("done").alias("state"), "n", *counts), path)


def markers(spark: SparkSession, path: str, cell: list[str]) -> DataFrame:
    """The cells that are done: cell, run, n, counts."""
    log = spark.read.option("mergeSchema", "true").parquet(f"{path}/markers")
    rest = [c for c in log.columns if c not in cell]
    last = log.groupBy(*cell).agg(F.max_by(F.struct(*rest), F.struct("run", F.col("state") == "done")).alias("e"))
    return last.filter("e.state = 'done'").select(*cell, *(F.col(f"e.{c}") for c in rest if c != "state"))


def pending(cells: DataFrame, path: str, cell: list[str]) -> DataFrame:
    """The cells that aren't done."""
    spark = cells.sparkSession
    if not _exists(spark, f"{path}/markers"):
        return cells
    return cells.join(F.broadcast(markers(spark, path, cell).select(*cell)), cell, "left_anti")


def load(spark: SparkSession, path: str, cell: list[str]) -> DataFrame:
    """The rows of the cells that are done."""
    done = markers(spark, path, cell).filter("n > 0").select(*cell)
    return _typed(spark.read.parquet(f"{path}/data"), done, cell).join(F.broadcast(done), cell, "left_semi")


def damaged(spark: SparkSession, path: str, cell: list[str]) -> DataFrame:
    """Done cells whose data isn't what their marker counted: cell, n, found."""
    done = markers(spark, path, cell).select(*cell, "n")
    rows = _typed(spark.read.parquet(f"{path}/data"), done, cell).groupBy(*cell).agg(F.count(F.lit(1)).alias("found"))
    return done.join(rows, cell, "left").fillna(0, ["found"]).filter("n > 0 and n <> found")


def run_cells(cells: DataFrame, path: str, cell: list[str], work: Callable[[DataFrame], DataFrame], counts: dict[str, Column] | None = None) -> str:
    """Does the cells that aren't done: work makes the rows of the cells that it gets. Cells are few: a grid of regions and sectors."""
    run = new_run()
    open_ = pending(cells.select(*cell).distinct(), path, cell)
    # what is open is read off the log, which grows in this run
    rows = open_.collect()
    if rows:
        open_ = cells.sparkSession.createDataFrame(rows, open_.schema)
        begin(open_, path, run)
        save(work(open_), path, cell)
        finish(open_, path, cell, run, counts)
    return run


def _typed(data: DataFrame, like: DataFrame, cell: list[str]) -> DataFrame:
    """Cells' names read off folders have the types that the reader guesses."""
    types = dict(like.dtypes)
    return data.withColumns({c: F.col(c).cast(types[c]) for c in cell})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
