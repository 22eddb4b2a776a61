"""Global dense order without a task that sees all rows, equal chunks, keep-first, top rows of groups."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import written


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of the taken ones, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def dense_order(df: DataFrame, order: list, name: str = "order") -> DataFrame:
    """Adds a gapless number from 0 in a total order; df's columns may have any names.

    Rows are dealt to range partitions and written; the counts of the partitions, a row each, make the offsets.
    """
    part, inside, ahead = free_names(df.columns, "part__", "inside__", "before__")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "order")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(inside))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(inside).over(before), F.lit(0)).alias(ahead))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    out = ranged.withColumn(inside, own).join(F.broadcast(offsets), part)
    return out.select(*df.columns, (F.col(ahead) + F.col(inside) - 1).cast("long").alias(name))


def numbered(df: DataFrame, group: list[str], order: list, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds each row's number from 1 in its group, and on request the group's size, without a task that sees a whole group.

    Rows are range-partitioned by group and order and written, so that a group of any share of the rows is spread over
    many partitions; a row for each group and partition gives the offsets. ``order`` should tell all rows of a group apart;
    df's columns may have any names.
    """
    part, inside, before, total = free_names(df.columns, "part__", "inside__", "before__", "total__")
    own = [*free_names(df.columns, *(f"group{i}__" for i in range(len(group)))), part]
    theirs = free_names([*df.columns, *own, inside], *(f"{o}o" for o in own))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *(F.col(c) for c in group), *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged.withColumns({o: F.col(c) for o, c in zip(own, group)}), "numbered")
    counts = ranged.groupBy(*own).agg(F.count(F.lit(1)).alias("n__"))
    mine = Window.partitionBy(*own[:-1])
    earlier = F.sum("n__").over(mine.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(o).alias(t) for o, t in zip(own, theirs)), F.coalesce(earlier, F.lit(0)).alias(before), F.sum("n__").over(mine).alias(total))
    placed = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    same = [F.col(o).eqNullSafe(F.col(t)) for o, t in zip(own[:-1], theirs)] + [F.col(part) == F.col(theirs[-1])]
    out = placed.join(offsets, same)
    extra = [F.col(total).cast("long").alias(size)] if size else []
    return out.select(*df.columns, (F.col(before) + F.col(inside)).cast("long").alias(rank), *extra)


def running_sums(df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds before_<value>, the sum over the earlier rows of the group, for each value, without a task that sees a whole group.

    As ``numbered``: range partitions, written once, and a row of sums for each group and partition.
    """
    part, *inside = free_names(df.columns, "part__", *(f"inside_{v}__" for v in values))
    own = [*free_names(df.columns, *(f"group{i}__" for i in range(len(group)))), part]
    theirs = free_names([*df.columns, *own, *inside], *(f"{o}o" for o in own))
    totals = free_names([*df.columns, *own, *inside, *theirs], *(f"total_{v}__" for v in values))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged.withColumns({o: F.col(c) for o, c in zip(own, group)}), "running")
    earlier = Window.partitionBy(*own[:-1]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*own).agg(*(F.sum(v).alias(t) for v, t in zip(values, totals)))
    offsets = sums.select(*(F.col(o).alias(t) for o, t in zip(own, theirs)), *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(t) for t in totals))
    mine = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({i: F.coalesce(F.sum(v).over(mine), F.lit(0)) for v, i in zip(values, inside)})
    same = [F.col(o).eqNullSafe(F.col(t)) for o, t in zip(own[:-1], theirs)] + [F.col(part) == F.col(theirs[-1])]
    found = [(F.col(t) + F.col(i)).cast("long").alias(f"before_{v}") for v, t, i in zip(values, totals, inside)]
    return placed.join(offsets, same).select(*df.columns, *found)


#: Rows of one group that a draw may have to put in order in one task: those of one bin of its digest.
BIN_ROWS = 100_000
#: Groups of which a row each is broadcast.
BROADCAST_GROUPS = 100_000


def pieces(df: DataFrame, group: list[str], draw: Column, tie: str, limits: Callable[[DataFrame], DataFrame], name: str = "piece") -> DataFrame:
    """Adds how many of its group's limits a row's rank in the order (draw, tie) exceeds, without moving or numbering the rows.

    draw: a hex digest. limits: from a table of group and size to one of group and limits, an ascending array of as many
    ranks for every group. Rows are counted by group and first digits of the digest. A limit falls into one such bin: rows of
    bins before it are within, those of bins after it beyond, and only the rows of the bin itself are put in order, some
    BIN_ROWS of a group. So a draw is two passes over narrow counts, one filter by a small table, and no shuffle of the rows.
    """
    digest, bin_, at, order, cuts = free_names(df.columns, "draw__", "bin__", "at__", "order__", "cuts__")
    keys = free_names(df.columns, *(f"group{i}__" for i in range(len(group))))
    rows = df.withColumn(digest, draw)

    def counted(digits: int) -> DataFrame:
        own = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(group, keys)), F.substring(digest, 1, digits).alias(bin_))
        return written(own.agg(F.count(F.lit(1)).alias("n")), "draw-bins")

    digits, bins = 2, counted(2)
    groups, fullest = bins.agg(F.count_distinct(F.struct(*keys) if keys else F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if fullest > BIN_ROWS:
        digits += math.ceil(math.log(fullest / BIN_ROWS, 16))
        bins = counted(digits)
    sizes = bins.groupBy(*keys).agg(F.sum("n").cast("long").alias("size"))
    wanted = limits(sizes.select(*(F.col(k).alias(c) for c, k in zip(group, keys)), "size"))
    wanted = wanted.select(*(F.col(c).alias(f"{k}_") for c, k in zip(group, keys)), F.posexplode("limits").alias("i", "limit"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(bin_))  # a row a bin
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    found = bins.withColumn("upto", upto).join(wanted, same if keys else F.lit(True)).filter("upto >= limit")
    found = found.groupBy(*keys, "i", "limit").agg(F.min(F.struct(F.col(bin_).alias("bin"), (F.col("limit") - F.col("upto") + F.col("n")).alias("rest"))).alias("c"))
    # a limit of none is before all bins, one beyond the group's size after all
    none = F.struct(F.lit("").alias("bin"), F.lit(0).cast("long").alias("rest"))
    all_ = F.struct(F.lit("~").alias("bin"), F.lit(0).cast("long").alias("rest"))
    ends = wanted.join(found.select(*keys, F.col("i").alias("i_"), "c"), [*same, F.col("i") == F.col("i_")], "left")
    cut = F.when(F.col("limit") <= 0, none).otherwise(F.coalesce("c", all_))
    table = ends.groupBy(*(f"{k}_" for k in keys)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", cut.alias("c")))), lambda x: x["c"]).alias(cuts))
    table = F.broadcast(table) if groups <= BROADCAST_GROUPS else written(table, "draw-cuts")
    placed = rows.withColumn(bin_, F.substring(digest, 1, digits)).join(table, [F.col(c).eqNullSafe(F.col(f"{k}_")) for c, k in zip(group, keys)] or F.lit(True))
    edge = F.exists(cuts, lambda c: c["bin"] == F.col(bin_))
    beyond = lambda k: F.size(F.filter(cuts, lambda c: (F.col(bin_) > c["bin"]) | ((F.col(bin_) == c["bin"]) & (k > c["rest"])))).alias(name)
    inner = placed.filter(edge).withColumn(order, F.row_number().over(Window.partitionBy(*group, bin_).orderBy(digest, tie)))
    return placed.filter(~edge).select(*df.columns, beyond(F.lit(0))).unionByName(inner.select(*df.columns, beyond(F.col(order))))


def equal_chunks(df: DataFrame, order: list, chunks: int) -> DataFrame:
    """Adds chunk, 0 to chunks - 1: consecutive rows, sizes at most one apart, the larger ones first."""
    numbered = written(dense_order(df, order, "__at"), "chunks")
    n = numbered.count()
    size, rest = divmod(n, chunks)
    at = F.col("__at")
    late = F.lit(rest) + F.floor((at - rest * (size + 1)) / max(size, 1))
    chunk = F.when(at < rest * (size + 1), F.floor(at / (size + 1))).otherwise(late)
    return numbered.withColumn("chunk", chunk.cast("int")).drop("__at")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: of a key with many rows each task passes one on."""
    return top_of_each(df, keys, order, 1)


def top_of_each(df: DataFrame, keys: list[str], order: list, n: int | Column) -> DataFrame:
    """Up to n rows of each key. A literal n is applied in each task before rows are moved (a limit of the window's groups)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def batches(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Adds batch, from 0, of ``size`` rows of each key."""
    out = numbered(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], "number__")
    return out.withColumn("batch", F.floor((F.col("number__") - 1) / size).cast("long")).drop("number__")


def draw_key(seed: int, *columns: str) -> Column:
    """The order of every draw: a digest of seed and columns, so it doesn't depend on how rows are dealt."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))
