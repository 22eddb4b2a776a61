"""Greedy spatial de-duplication."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.geo import DEDUP_R, radius_join
from cartolith.ontology import FALLBACK_RADIUS_M, registry
from cartolith.session import settled, written


def with_radius(assets: DataFrame, fallback: float = FALLBACK_RADIUS_M) -> DataFrame:
    """Adds radius_m: the class's own, else the fallback. The registry has a fixed number of rows."""
    known = registry(assets.sparkSession).select(F.col("name").alias("asset_type"), F.col("radius_m"))
    return assets.join(F.broadcast(known), "asset_type", "left").fillna({"radius_m": fallback})


def neighbours(assets: DataFrame) -> DataFrame:
    """lo, hi, distance_m: pairs of the same class within its radius, lo before hi in (pos, asset_id)."""
    rows = assets.select("asset_type", "radius_m", "lat", "lon", "asset_id", "pos")
    pairs = radius_join(rows, rows, F.col("radius_m"), ("asset_type",), DEDUP_R)
    pairs = pairs.filter(F.struct("pos", "asset_id") < F.struct("r_pos", "r_asset_id"))
    return pairs.select(F.col("asset_id").alias("lo"), F.col("r_asset_id").alias("hi"), "distance_m")


COLUMNS = ["asset_type", "radius_m", "lat", "lon", "asset_id", "pos"]
#: Side of the narrowest blocks, in radii; each wider level is so many times as wide.
NARROWEST, WIDER = 32, 2
#: Rows that one block should have at most; more are walked too, but wider blocks are for fewer rows.
BLOCK_ROWS = 200_000


def in_blocks(assets: DataFrame, side: Column, shift: float) -> DataFrame:
    """Adds the block that a row lies in, block_y and block_x, and blocks, a list of all that it is within its radius of.

    Blocks are bands of latitude ``side`` degrees high, cut into cells as wide at least; ``shift`` moves the grid by a part of a side.
    """
    radius = F.degrees(F.col("radius_m") / DEDUP_R) * (1 + 1e-9)
    band = lambda lat: F.floor((lat + 90.0) / side + shift).cast("long")
    below, above = band(F.col("lat") - radius), band(F.col("lat") + radius)
    reach = F.greatest(F.abs(F.col("lat") - radius), F.abs(F.col("lat") + radius))
    reach = F.when(reach > 89.9, 360.0).otherwise(radius / F.cos(F.radians(F.least(reach, F.lit(89.9)))))

    def cells(y: Column) -> Column:
        low, high = (y - shift) * side - 90.0, (y + 1 - shift) * side - 90.0
        widest = F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(high), F.lit(90.0)))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) * widest / side)).cast("long")

    def cell(lon: Column, n: Column) -> Column:
        return F.floor((lon + 180.0) / F.lit(360.0) * n + shift).cast("long")

    def met(y: Column) -> Column:
        n, lon = cells(y), F.col("lon")
        first, last = cell(lon - reach, n), cell(lon + reach, n)
        some = F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda x: F.struct(y.alias("block_y"), F.pmod(x, n).alias("block_x")))
        return F.array_distinct(some)

    own = band(F.col("lat"))
    found = F.flatten(F.transform(F.sequence(below, above), met))
    return assets.select("*", own.alias("block_y"), F.pmod(cell(F.col("lon"), cells(own)), cells(own)).alias("block_x"), found.alias("blocks"))


def _side(level: int) -> Column:
    return F.degrees(F.col("radius_m") / DEDUP_R) * float(NARROWEST * WIDER**level)


def widest_level(open_: DataFrame, shift: float) -> int:
    """The widest level whose fullest block has BLOCK_ROWS rows at most; -1 if the narrowest blocks have more."""
    top, least = 0, open_.agg(F.min("radius_m")).first()[0]
    while math.degrees(least / DEDUP_R) * NARROWEST * WIDER**top < 720:
        top += 1
    if open_.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        return top
    fits, full = -1, top + 1
    while full - fits > 1:
        level = (fits + full) // 2
        blocks = in_blocks(open_, _side(level), shift).groupBy("asset_type", "block_y", "block_x").count()
        if blocks.agg(F.max("count")).first()[0] <= BLOCK_ROWS:
            fits = level
        else:
            full = level
    return fits


#: Undecided rows of a cell that are remembered one by one; a cell with more counts as undecided anywhere.
REMEMBERED = 32


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each block's rows in order; of its own rows passes on those it keeps (kept) and those it can't decide.

    A row next to the block isn't the block's to keep: unless a kept row suppresses it, it is undecided, and so is a row with
    an undecided earlier neighbour and no kept one. Held in memory: kept rows, which are a radius apart, and undecided ones.
    """
    block, kept, undecided = None, {}, {}
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        lat, lon, radius = (columns[c].to_numpy() for c in ("lat", "lon", "radius_m"))
        step = np.degrees(radius / DEDUP_R) * (1 + 1e-9)
        band = np.floor(lat / step).astype(np.int64)
        near = []
        for d in (0, -1, 1):
            top = np.minimum(90.0, np.maximum(np.abs((band + d - 1) * step), np.abs((band + d + 2) * step)))
            n = np.where(top > 89.9, 1, np.maximum(1, np.floor(360.0 / step * np.maximum(np.cos(np.radians(top)), 1e-9)))).astype(np.int64)
            cell = np.floor((lon + 180.0) / (360.0 / n)).astype(np.int64)
            near += [((band + d) * (1 << 32) + (cell + e) % n).tolist() for e in (0, -1, 1)]
        blocks = list(zip(*(columns[c].to_pylist() for c in ("asset_type", "block_y", "block_x")), strict=True))
        own, limit = columns["own"].to_pylist(), radius.tolist()
        cosines, lats, lons = (x.tolist() for x in (np.cos(np.radians(lat)), np.radians(lat), np.radians(lon)))
        out, states = [], []
        for i in range(batch.num_rows):
            if blocks[i] != block:
                block, kept, undecided = blocks[i], {}, {}
            y, x, c, r = lats[i], lons[i], cosines[i], limit[i]

            def close(rows: list) -> bool:
                for y2, x2, c2 in rows:
                    a = math.sin((y2 - y) / 2) ** 2 + c * c2 * math.sin((x2 - x) / 2) ** 2
                    if 2 * DEDUP_R * math.asin(min(1.0, math.sqrt(a))) <= r:
                        return True
                return False

            keys = [k[i] for k in near]
            if any(close(kept[k]) for k in keys if k in kept):
                continue
            waits = not own[i]
            for k in () if waits else keys:
                rows = undecided.get(k)
                if rows is not None and (len(rows) >= REMEMBERED or close(rows)):
                    waits = True
                    break
            (undecided if waits else kept).setdefault(keys[0], [])
            rows = (undecided if waits else kept)[keys[0]]
            if len(rows) < REMEMBERED or not waits:
                rows.append((y, x, c))
            if own[i]:
                out.append(i)
                states.append(not waits)
        some = batch.take(pa.array(out, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in [*COLUMNS, "copies"]), pa.array(states, pa.bool_())], [*COLUMNS, "copies", "kept"])


def walked(open_: DataFrame, level: int, shift: float) -> DataFrame:
    """The open rows that walks of blocks keep or leave undecided: COLUMNS, copies (blocks that saw the row), kept."""
    placed = in_blocks(open_, _side(level), shift)
    seen = placed.select(*COLUMNS, F.col("block_y").alias("y"), F.col("block_x").alias("x"), F.size("blocks").alias("copies"), F.inline("blocks"))
    seen = seen.select(*COLUMNS, "copies", "block_y", "block_x", ((F.col("y") == F.col("block_y")) & (F.col("x") == F.col("block_x"))).alias("own"))
    key = ["asset_type", "block_y", "block_x"]
    types = dict(open_.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in COLUMNS), "copies int", "kept boolean"])
    return seen.repartition(*key).sortWithinPartitions(*key, "pos", "asset_id").mapInArrow(walk, schema)


def in_fine_cells(assets: DataFrame) -> DataFrame:
    """Adds fine_y and fine_x: cells so small that all rows of a class in one are within its radius of each other."""
    step = F.degrees(F.col("radius_m") / DEDUP_R) * 0.7
    y = F.floor(F.col("lat") / step)
    # the band's edge next to the equator, where a degree of longitude is longest
    edge = F.least(F.abs(y * step), F.abs((y + 1) * step))
    edge = F.when(y == -1, F.lit(0.0)).otherwise(edge)
    x = F.floor(F.col("lon") * F.cos(F.radians(edge)) / step)
    return assets.withColumn("fine_y", y.cast("long")).withColumn("fine_x", x.cast("long"))


def first_rows(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rows of fine cells that no earlier open row is near, which stay, and the open rows that they leave open.

    A crowd of any density is closed without pairs but those of cells' first rows.
    """
    first = in_fine_cells(open_).groupBy("asset_type", "fine_y", "fine_x").agg(F.min(F.struct("pos", "asset_id", "lat", "lon", "radius_m")).alias("h"))
    heads = first.select("asset_type", *(f"h.{c}" for c in COLUMNS[1:]))
    near = radius_join(heads, open_, F.col("radius_m"), ("asset_type",), DEDUP_R)
    earlier = F.struct("r_pos", "r_asset_id") < F.struct("pos", "asset_id")
    near = written(near.select("asset_id", F.col("r_asset_id").alias("closes"), earlier.alias("earlier")), "dedup-near")
    free = near.groupBy("asset_id").agg(F.bool_or("earlier").alias("waits")).filter("not waits").select("asset_id")
    free = written(free, "dedup-free")
    closed = near.join(free, "asset_id", "left_semi").select(F.col("closes").alias("asset_id")).distinct()
    return open_.join(free, "asset_id", "left_semi").select(*COLUMNS), open_.join(closed, "asset_id", "left_anti")


def survivors(assets: DataFrame) -> DataFrame:
    """The rows that a walk in order (pos, asset_id) keeps if each kept row suppresses its later neighbours.

    Rounds: blocks of the ground, as wide as their rows allow, are walked each by itself, with the rows around them. What depends
    on rows beyond is left undecided; kept rows at an edge close the undecided ones across it; the rest, some rows along edges,
    goes to the next round, whose blocks are wider and lie elsewhere. A chain of rows that wait for each other so takes a round
    for each block that it crosses, at most, not one for each row. Where even the narrowest blocks hold too many rows, a round
    keeps cells' first rows instead. Each round's tables are written. assets: written table with radius_m.
    """
    open_, kept, number = assets.select(*COLUMNS), [], 0
    while True:
        shift = number * 0.381966 % 1.0
        level = widest_level(open_, shift)
        if level >= 0:
            found = written(walked(open_, level, shift), "dedup-walked")
            stays, rest = found.filter("kept").select(*COLUMNS), found.filter("not kept").select(*COLUMNS)
            if not rest.isEmpty():
                edge = found.filter("kept and copies > 1").select("asset_type", "radius_m", "lat", "lon")
                closed = radius_join(edge, rest, F.col("radius_m"), ("asset_type",), DEDUP_R).select(F.col("r_asset_id").alias("asset_id")).distinct()
                rest = written(rest.join(closed, "asset_id", "left_anti"), "dedup-open")
        else:
            stays, rest = (written(x, "dedup-first") for x in first_rows(open_))
        kept.append(stays)
        open_, number = rest, number + 1
        if open_.isEmpty():
            return reduce(DataFrame.union, kept)


@settled
def deduplicate(assets: DataFrame) -> DataFrame:
    """The assets with kept and deduplicated_by, the nearest kept neighbour of a removed row (ties to the lesser id)."""
    rows = written(with_radius(assets), "dedup-assets")
    if rows.isEmpty():
        return rows.select("*", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("deduplicated_by"), F.lit(None).cast("double").alias("by_distance_m"))
    stays = survivors(rows)
    near = radius_join(stays, rows.select("asset_type", "radius_m", "lat", "lon", "asset_id"), F.col("radius_m"), ("asset_type",), DEDUP_R)
    near = near.groupBy(F.col("r_asset_id").alias("asset_id")).agg(
        F.min(F.struct("distance_m", F.col("asset_id").alias("by"))).alias("near"), F.bool_or(F.col("asset_id") == F.col("r_asset_id")).alias("kept")
    )
    by = lambda c: F.when(~F.col("kept"), F.col(f"near.{c}"))
    out = rows.join(near, "asset_id")
    return out.select(*assets.columns, "radius_m", "kept", by("by").alias("deduplicated_by"), by("distance_m").alias("by_distance_m"))


def summary(deduplicated: DataFrame) -> DataFrame:
    """Kept, removed and share removed by class, with the radius used."""
    kept = F.count(F.when(F.col("kept"), 1))
    total = F.count(F.lit(1))
    return deduplicated.groupBy("asset_type").agg(
        kept.alias("kept"),
        (total - kept).alias("removed"),
        total.alias("total"),
        F.round(F.lit(100.0) * (total - kept) / total, 2).alias("removed_pct"),
        F.max("radius_m").alias("radius_m"),
    )


def conservation(before: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Violations: rows lost or invented, removed rows without a kept survivor."""
    lost = before.select("asset_id").exceptAll(deduplicated.select("asset_id")).withColumn("rule", F.lit("lost"))
    new = deduplicated.select("asset_id").exceptAll(before.select("asset_id")).withColumn("rule", F.lit("invented"))
    kept = deduplicated.filter("kept").select(F.col("asset_id").alias("deduplicated_by"))
    orphan = deduplicated.filter("not kept").join(kept, "deduplicated_by", "left_anti")
    return lost.union(new).union(orphan.select("asset_id", F.lit("no_survivor").alias("rule")))
