"""Spark helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.session import settled as settled
from cartolith.session import written as written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. If the reader makes fewer splits than there are cores, its rows are dealt to all of them.

    Spark cuts files of any size into at least a split a core, down to spark.sql.files.openCostInBytes (4 MB); only a
    table below that a core is moved.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow, giving memory back between batches.

    Batches are bounded by the session's limits of rows and of bytes (spark.sql.execution.arrow.maxRecordsPerBatch and
    maxBytesPerBatch, 64 MB), whatever the texts' length; ``run`` works on blocks of some 256 KB of them.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for out in run(batches):
            yield out
            pool.release_unused()

    return df.mapInArrow(lean, schema)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of the taken ones, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; null counts as empty."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, "[\\x20\\x09-\\x0D]+", "")).cast("long")


#: Rows of one range partition in ``running_totals``; narrow rows, so a partition is some MB.
RANGE_ROWS = 250_000


def running_totals(df: DataFrame, order: list[str], value: str, group: list[str] | None = None) -> DataFrame:
    """Exclusive running total and row number, in a total order, without a task that sees all rows.

    Adds ``before`` (sum of ``value`` over the earlier rows of the same group) and ``position`` (their number).
    Narrow rows are range-partitioned by group and order, so a group of any share of the rows is spread over many
    partitions; the totals of each partition are summed up into offsets (one row for each partition and group), and
    windows run only inside a partition. The range-partitioned rows are written once: both passes see the same split.
    Rows that tie in group and order stay in one partition and are numbered in an unspecified but fixed order,
    so ``order`` should end in columns that tell rows apart. ``df`` is read several times: pass a written table.
    """
    group = group or []
    spark = df.sparkSession
    count = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "totals-ranged")
    own = ["__part", *(f"__g{i}" for i in range(len(group)))]
    keyed = ranged.select("*", *(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)))
    totals = keyed.groupBy(*own).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    # One row for each partition and group that meet: partitions plus groups at most.
    earlier = Window.partitionBy(*own[1:]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(c).alias(f"{c}_") for c in own),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum_before"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n_before"),
    )
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.select(
        "*",
        F.coalesce(F.sum(value).over(inside), F.lit(0)).alias("__in_sum"),
        F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)).alias("__in_n"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) if c != "__part" else F.col(c) == F.col("__part_") for c in own]
    out = placed.join(offsets, same, "inner")
    return out.select(
        *df.columns,
        (F.col("__sum_before") + F.col("__in_sum")).cast("long").alias("before"),
        (F.col("__n_before") + F.col("__in_n")).cast("long").alias("position"),
    )


#: Most rows of a table that is broadcast after its rows were counted.
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame) -> bool:
    """Whether the table, of a bounded width, has few enough rows to broadcast it."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """Ask for a broadcast if the table has few rows; else leave the join to the optimizer and its skew handling."""
    return F.broadcast(df) if is_small(df) else df


#: A key is heavy if it has more than this share of the rows, so that fewer than 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.001


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, bounded: bool = True) -> DataFrame:
    """Join on a column that few values may dominate on the left; on the right its values are distinct.

    Rows of heavy keys meet their fewer than 1000 partners by broadcast, where they are; all others are shuffled. If all of
    ``right`` has BROADCAST_ROWS at most, of a bounded width, it is broadcast whole. ``left`` may be read several times;
    ``counted`` is a narrower table with the keys that matter. how: inner or left; null keys match nothing.
    """
    if bounded and is_small(right):
        return left.join(F.broadcast(right), key, how)
    counted = left if counted is None else counted
    total = counted.count()
    heavy = counted.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > total * HEAVY_SHARE)).select(key)
    found = heavy.collect()  # fewer than 1 / HEAVY_SHARE rows
    if not found:
        return left.join(right, key, how)
    heavy = F.broadcast(left.sparkSession.createDataFrame(found, heavy.schema))
    few = F.broadcast(right.join(heavy, key, "left_semi"))
    hot = left.join(heavy, key, "left_semi").join(few, key, how)
    rest = left.join(heavy, key, "left_anti").join(right, key, how)
    return hot.unionByName(rest)
