"""Balanced contiguous shards from global byte-size prefix sums (operator 9).

Rows get one global order (text digest, then id), so equal texts are neighbours. Per-partition totals give every row
its global byte offset; cuts at equal byte targets make the shards. A cut that falls inside a group of equal texts moves
to the nearer end of the group if that shifts it by at most ``slack`` of a shard's bytes; larger groups, which no shard
could hold in balance, are cut at the row nearest to the target.

Defined results: a null text has no bytes and counts as the empty text; an empty table gives no rows; repeated rows are
rows of their own; with fewer rows than shards some shards are empty; only the columns named here are read, so others
may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.shared import documents, running_totals, settled, written

SHARDS = 40
OVERHEAD = 16
SLACK = 0.02


def byte_cuts(placed: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """Byte offsets of the shards - 1 cuts, at row boundaries. placed: running totals with columns digest, size, before."""
    aims = [total * j / shards for j in range(1, shards)]
    if not total:
        return []
    end = F.col("before") + F.col("size")
    # The rows that hold an aim: shards - 1 at most. The number of aims below an offset tells without a join.
    below = lambda x: F.ceil(x * shards / F.lit(float(total))).cast("long")
    held = (
        placed.filter(below(end) > below(F.col("before")))
        .select("digest", "before", "size")
        .collect()
    )
    groups = sorted({r["digest"] for r in held})
    spans = {
        r["digest"]: (r["start"], r["stop"])
        for r in placed.filter(F.col("digest").isin(groups))
        .groupBy("digest")
        .agg(F.min("before").alias("start"), F.max(end).alias("stop"))
        .collect()
    }
    held.sort(key=lambda r: r["before"])
    starts = [r["before"] for r in held]
    cuts = []
    for aim in aims:
        row = held[max(0, bisect_right(starts, aim) - 1)]
        ends = min(spans[row["digest"]], key=lambda x: (abs(x - aim), x))
        if abs(ends - aim) > slack * total / shards:
            ends = min((row["before"], row["before"] + row["size"]), key=lambda x: (abs(x - aim), x))
        cuts.append(ends)
    return cuts


@settled
def shard(rows: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """Shard and slot of every row. rows: columns doc_id, digest, size (long) and any others, cheap to read again.

    Adds shard (int) and slot (long, gapless from 0 inside a shard). The other columns go along as one, so their names clash
    with none of those used here.
    """
    others = [c for c in rows.columns if c not in ("doc_id", "digest", "size")]
    own = ["doc_id", "digest", "size", *([F.struct(*others).alias("others")] if others else [])]
    placed = written(running_totals(rows.select(*own), ["digest", "doc_id"], "size"), "sharding-placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    cuts = byte_cuts(placed, total, shards, slack)
    dealt = numbered(placed, cuts)
    first = dealt.groupBy("shard").agg(F.min("position").alias("first"))  # one row a shard
    back = [F.col("others")[c].alias(c) if c in others else c for c in rows.columns]
    return dealt.join(F.broadcast(first), "shard").select(*back, "shard", (F.col("position") - F.col("first")).alias("slot"))


def numbered(placed: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds shard, the number of cuts at or below a row's offset, by binary search over the different cuts."""
    edges = sorted(set(cuts))
    if not edges:
        return placed.withColumn("shard", F.lit(0))
    splits = [-math.inf, *map(float, edges), math.inf]
    at = Bucketizer(splits=splits, inputCol="at_", outputCol="edge_").transform(placed.withColumn("at_", F.col("before").cast("double")))
    # a row larger than a shard can hold several cuts: as many shards stay empty
    below = F.array(F.lit(0), *(F.lit(bisect_right(cuts, e)) for e in edges))
    return at.withColumn("shard", F.get(below, F.col("edge_").cast("int"))).drop("at_", "edge_")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    return shard(written(rows, "sharding-rows")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
