"""Image tiles: pixel scaling, quality checks, triage, scene choice, manifests.

A tile's pixels are a struct c, h, w, data (row-major floats). Array work runs in mapInArrow, on stacks of a
batch's tiles of one shape; every verdict is SQL over the numbers that come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modality: bands, optical (uint8), resolution in metres, range of a good mean (fixed values).
MODALITIES = {
    "sentinel2_ms": (7, True, 10, (15.0, 220.0)),
    "sentinel2_rgb": (3, True, 10, (15.0, 220.0)),
    "sentinel1": (2, False, 10, (-28.0, 5.0)),
    "landsat_thermal": (1, False, 30, (220.0, 340.0)),
    "naip": (4, True, 1, (15.0, 220.0)),
}
#: Triage rules: class, signal, least, most (fixed values); classes that aren't listed use "".
RULES = (
    ("energy.transmission.substation", "texture", 8.0, 9999.0),
    ("energy.transmission.substation", "mean_brightness", 20.0, 210.0),
    ("energy.distribution.substation", "texture", 6.0, 9999.0),
    ("energy.distribution.substation", "mean_brightness", 20.0, 210.0),
    ("energy.distribution.substation_untyped", "texture", 5.0, 9999.0),
    ("energy.distribution.substation_untyped", "mean_brightness", 20.0, 210.0),
    ("energy.generation.power_plant", "texture", 5.0, 9999.0),
    ("energy.generation.power_plant", "mean_brightness", 20.0, 210.0),
    ("energy.generation.solar_farm", "mean_brightness", 10.0, 180.0),
    ("energy.generation.solar_farm", "rg_ratio", 0.5, 1.5),
    ("energy.generation.wind_farm", "texture", 2.0, 9999.0),
    ("energy.generation.wind_farm", "mean_brightness", 20.0, 220.0),
    ("energy.generation.generator", "texture", 3.0, 9999.0),
    ("energy.generation.generator", "mean_brightness", 20.0, 210.0),
    ("", "mean_brightness", 15.0, 220.0),
    ("", "valid_ratio", 0.8, 1.0),
)
SIGNALS = ("mean_brightness", "std_brightness", "rg_ratio", "rb_ratio", "texture", "valid_ratio", "center_brightness", "center_vs_full")


#: Pixels of a stack at most, one tile at least.
STACK = 1 << 21


def stacks(images: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch that share a shape, and their pixels (row, band, y, x), straight from the list's values."""
    fields = dict(zip((f.name for f in images.type), images.flatten(), strict=True))  # a null struct has null fields
    has = fields["c"].is_valid().to_numpy(zero_copy_only=False) & fields["data"].is_valid().to_numpy(zero_copy_only=False)
    shapes = np.stack([pc.fill_null(fields[k], 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in "chw"], 1)
    for shape in np.unique(shapes[has], axis=0):
        rows = np.flatnonzero(has & (shapes == shape).all(1))
        step = max(1, STACK // max(1, int(shape.prod())))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            values = fields["data"].take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, values.astype(float, copy=False).reshape(len(some), *shape)


def restacked(images: pa.StructArray, made: list[tuple[np.ndarray, np.ndarray]]) -> pa.StructArray:
    """New images from stacks, in the rows' order; rows in none are null."""
    kind, order = images.type, np.full(len(images), -1)
    data, sizes, at = [], [], 0
    for rows, stack in made:
        n, size = len(rows), int(np.prod(stack.shape[1:]))
        order[rows] = at + np.arange(n)
        at += n
        data.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(stack.reshape(-1))).cast(kind.field("data").type))
        sizes.append(np.tile(stack.shape[1:], (n, 1)))
    if not made:
        return pa.nulls(len(images), kind)
    index, sizes = pa.array(np.where(order < 0, 0, order), mask=order < 0), np.concatenate(sizes)
    columns = {"data": pa.concat_arrays(data).take(index)} | {k: pa.array(sizes[:, i]).cast(kind.field(k).type).take(index) for i, k in enumerate("chw")}
    return pa.StructArray.from_arrays([columns[f.name] for f in kind], fields=list(kind), mask=pa.array(order < 0))


def optical_bands(modalities) -> int:
    """Bands of the optical modalities, which lie in front."""
    return sum(MODALITIES[m][0] for m in modalities if m in MODALITIES and MODALITIES[m][1] and m != "naip")


def checks(stack: np.ndarray, bands: np.ndarray, margin: int = 5) -> np.ndarray:
    """Numbers behind the quality checks of a stack's tiles: valid_ratio, edge_zero, side, mean_value.

    bands: optical bands of each tile; the whole tile counts if there are none or too few.
    """
    n, c, h, w = stack.shape
    out, empty = np.zeros((n, 4)), (stack == 0).all(1)
    strips = [empty[:, :margin], empty[:, -margin:], empty[:, :, :margin], empty[:, :, -margin:]]
    out[:, 1] = 1.0 if min(h, w) < 2 * margin else np.max([x.mean((1, 2)) for x in strips], 0)
    out[:, 2] = min(h, w)
    front = np.where((bands > 0) & (bands <= c), bands, c)
    for k in np.unique(front):
        own = front == k
        eye = stack[own, :k]
        some = (eye != 0).sum((1, 2, 3))
        out[own, 0] = (eye != 0).any(1).mean((1, 2))
        out[own, 3] = eye.sum((1, 2, 3)) / np.maximum(some, 1)
    return out


def signals(stack: np.ndarray) -> np.ndarray:
    """SIGNALS of a stack's tiles with three bands or more; fewer are repeated."""
    n, c, h, w = stack.shape
    r, g, b = (stack[:, min(i, c - 1)] for i in range(3))
    cut, mean = min(h, w) // 4, stack.mean((1, 2, 3))
    centre = stack[:, :, h // 2 - cut : h // 2 + cut, w // 2 - cut : w // 2 + cut]
    middle = centre.mean((1, 2, 3)) if centre.size else np.zeros(n)
    over = lambda x: (r / np.where(x > 0, x, 1)).mean((1, 2))
    texture = np.abs(np.diff(r, axis=2)).mean((1, 2)) + np.abs(np.diff(r, axis=1)).mean((1, 2))
    valid = (stack > 0).any(1).mean((1, 2))
    return np.stack([mean, stack.std((1, 2, 3)), over(g), over(b), texture, valid, middle, middle / np.maximum(mean, 1)], 1)


_QC = (("valid_ratio", "double"), ("edge_zero", "double"), ("side", "int"), ("mean_value", "double"))


def measured(tiles: DataFrame) -> DataFrame:
    """asset_id, asset_type, modality, has_image, qc (numbers of the checks), signals. tiles: asset_id, asset_type, modalities, image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names = batch.num_rows, [x or [] for x in batch.column("modalities").to_pylist()]
            bands = np.fromiter(map(optical_bands, names), np.int64, n)
            has, qc, found = np.zeros(n, bool), np.zeros((n, len(_QC))), np.zeros((n, len(SIGNALS)))
            for rows, stack in stacks(batch.column("image")):
                has[rows], qc[rows], found[rows] = True, checks(stack, bands[rows]), signals(stack)
            none = pa.array(~has)
            kinds = {"double": pa.float64(), "int": pa.int32()}
            qc = pa.StructArray.from_arrays([pa.array(qc[:, i]).cast(kinds[k]) for i, (_, k) in enumerate(_QC)], [name for name, _ in _QC], mask=none)
            found = pa.StructArray.from_arrays([pa.array(x) for x in found.T], list(SIGNALS), mask=none)
            modality = pa.array([x[0] if x else "sentinel2_rgb" for x in names], pa.string())
            columns = [batch.column("asset_id"), batch.column("asset_type"), modality, pa.array(has), qc, found]
            yield pa.RecordBatch.from_arrays(columns, ["asset_id", "asset_type", "modality", "has_image", "qc", "signals"])

    schema = f"asset_id string, asset_type string, modality string, has_image boolean, qc struct<{','.join(f'{k}:{t}' for k, t in _QC)}>, "
    schema += f"signals struct<{','.join(f'{s}:double' for s in SIGNALS)}>"
    return tiles.select("asset_id", "asset_type", "modalities", "image").mapInArrow(run, schema)


def qc_verdict(measured_: DataFrame, least_valid: float = 0.80, most_edge: float = 0.90, least_side: int = 20) -> DataFrame:
    """Adds status: pass, or the first check that fails in fixed order."""
    low, high = F.lit(15.0), F.lit(220.0)
    for name, (_, _, _, (a, b)) in MODALITIES.items():
        low, high = F.when(F.col("modality") == name, a).otherwise(low), F.when(F.col("modality") == name, b).otherwise(high)
    q = lambda c: F.col(f"qc.{c}")
    status = (
        F.when(~F.col("has_image"), "fail_no_image")
        .when(q("valid_ratio") < least_valid, "fail_valid_pixels")
        .when(q("edge_zero") > most_edge, "fail_edge_artifacts")
        .when(q("side") < least_side, "fail_min_size")
        .when((q("mean_value") == 0) | ~q("mean_value").between(low, high), "fail_value_range")
        .otherwise("pass")
    )
    return measured_.withColumn("status", status)


def triage(measured_: DataFrame, low: int = 1, contradiction: int = 3, rules=RULES) -> DataFrame:
    """Adds confidence (high, low, contradiction), flag_for_human, failures and reason."""
    spark = measured_.sparkSession
    table = F.broadcast(spark.createDataFrame(list(rules), "rule_type string, signal string, least double, most double"))
    known = sorted({r[0] for r in rules if r[0]})
    own = F.when(F.col("asset_type").isin(known), F.col("asset_type")).otherwise("")
    long = measured_.filter("has_image").select("asset_id", own.alias("rule_type"), F.explode(F.create_map(*(x for s in SIGNALS for x in (F.lit(s), F.col(f"signals.{s}"))))).alias("signal", "value"))
    bad = long.join(table, ["rule_type", "signal"]).filter(~F.col("value").between(F.col("least"), F.col("most")))
    text = F.format_string("%s=%.2f outside [%s, %s]", "signal", "value", "least", "most")
    bad = bad.groupBy("asset_id").agg(F.count(F.lit(1)).alias("failures"), F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("why"))
    out = measured_.join(bad, "asset_id", "left").fillna({"failures": 0})
    n = F.col("failures")
    confidence = F.when(~F.col("has_image") | (n >= contradiction), "contradiction").when(n >= low, "low").otherwise("high")
    reason = F.when(~F.col("has_image"), "No image available").when(n == 0, "All signals within expected range").otherwise(F.concat(n.cast("string"), F.lit(" signal(s): "), "why"))
    return out.withColumn("confidence", confidence).withColumn("flag_for_human", confidence == "low").withColumn("reason", reason).drop("why")


def normalised(data: Column, kind: str) -> Column:
    """Pixels of one tile scaled by modality: optical to 0-255, radar to decibel, thermal to Kelvin."""
    if kind == "optical":
        scale = F.when(F.array_max(data) > 1, 1 / 10_000).otherwise(1.0)
        return F.transform(data, lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x * scale * 255.0))))
    if kind == "sar":
        return F.transform(data, lambda x: F.least(F.lit(10.0), F.greatest(F.lit(-30.0), F.when(x > 0, 10 * F.log10(x)).otherwise(-30.0))))
    return F.transform(data, lambda x: F.least(F.lit(350.0), F.greatest(F.lit(200.0), x * 0.00341802 + 149.0)))


def rescaled(data: Column, low: float, high: float) -> Column:
    """Values clipped to a range and mapped to 0 to 1."""
    return F.transform(data, lambda x: (F.least(F.lit(high), F.greatest(F.lit(low), x)) - low) / (high - low))


def with_bands(tiles: DataFrame, bands: list[int | None]) -> DataFrame:
    """Tiles with the given bands (from 0) in this order, None for an empty one; tiles that lack one of them go."""
    size = (F.col("image.h") * F.col("image.w")).cast("int")
    one = lambda b: F.array_repeat(F.lit(0.0), size) if b is None else F.slice(F.col("image.data").cast("array<double>"), size * b + 1, size)
    image = F.struct(F.lit(len(bands)).alias("c"), F.col("image.h").alias("h"), F.col("image.w").alias("w"), F.flatten(F.array(*(one(b) for b in bands))).alias("data"))
    return tiles.filter(F.col("image.c") > max(b for b in bands if b is not None)).withColumn("image", image)


def _with_images(tiles: DataFrame, change) -> DataFrame:
    """Tiles whose images are changed a stack at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch.column("image")
            new = restacked(images, [(rows, change(stack)) for rows, stack in stacks(images)])
            at = batch.schema.get_field_index("image")
            yield batch.set_column(at, batch.schema.field(at), new)

    return tiles.mapInArrow(run, tiles.schema)


def resampled(tiles: DataFrame, side: int, bilinear: bool = False) -> DataFrame:
    """Every band of image at side x side, nearest or bilinear."""

    def change(stack: np.ndarray) -> np.ndarray:
        h, w = stack.shape[2:]
        if not bilinear:
            return stack[:, :, np.arange(side) * h // side][:, :, :, np.arange(side) * w // side]
        y, x = (np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1) for n in (h, w))
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        fy, fx = (y - y0)[:, None], x - x0
        left = stack[:, :, y0][:, :, :, x0] * (1 - fy) + stack[:, :, y1][:, :, :, x0] * fy
        right = stack[:, :, y0][:, :, :, x1] * (1 - fy) + stack[:, :, y1][:, :, :, x1] * fy
        return left * (1 - fx) + right * fx

    return _with_images(tiles, change)


def stretched(tiles: DataFrame, low: float = 2, high: float = 98) -> DataFrame:
    """Pixels between two percentiles stretched to 0-1; a flat tile is divided by 255."""

    def change(stack: np.ndarray) -> np.ndarray:
        a, b = (x[:, None, None, None] for x in np.percentile(stack, [low, high], axis=(1, 2, 3)))
        return np.where(b > a, np.clip((stack - a) / np.where(b > a, b - a, 1), 0, 1), stack / 255)

    return _with_images(tiles, change)


def best_scenes(tiles: DataFrame, scenes: DataFrame, start: str, end: str, platform: str | None = None, cell: float = 2.0) -> DataFrame:
    """asset_id, item_id, cloud, below_limit: the least cloudy scene over a tile in a window of dates; missing cloud is 100.

    tiles: asset_id, minx .. maxy; scenes: item_id, taken, cloud_cover, platform, minx .. maxy, scene_rank. Both meet in the
    cells of a grid that their boxes touch. ``cell`` is the side of a cell in degrees, best near that of a scene; a smaller one
    means fewer scenes a tile and more copies of each scene.
    """
    found = scenes.filter((F.col("taken") >= start) & (F.col("taken") < end))
    if platform:
        found = found.filter(F.col("platform") == platform)

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return df.withColumn(f"{p}x", F.explode(span("minx", "maxx"))).withColumn(f"{p}y", F.explode(span("miny", "maxy")))

    one = cells(tiles.select("asset_id", "minx", "miny", "maxx", "maxy"), "t")
    two = cells(found, "s").select("item_id", "cloud_cover", "scene_rank", "sx", "sy", *(F.col(c).alias(f"s_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    both = one.join(two, (F.col("tx") == F.col("sx")) & (F.col("ty") == F.col("sy")))
    both = both.filter("minx <= s_maxx and maxx >= s_minx and miny <= s_maxy and maxy >= s_miny")
    cloud = F.coalesce("cloud_cover", F.lit(100.0))
    best = both.groupBy("asset_id").agg(F.min(F.struct(cloud.alias("cloud"), "scene_rank", "item_id")).alias("b"))
    return best.select("asset_id", "b.item_id", "b.cloud", (F.col("b.cloud") <= 20).alias("below_limit"))


def pins(tiles: DataFrame) -> DataFrame:
    """asset_id, pinned (modality to item id), pinnable. tiles: scenes, a map of modality to struct with item_id."""
    ids = F.transform_values(F.map_filter("scenes", lambda k, v: v["item_id"].isNotNull()), lambda k, v: v["item_id"])
    return tiles.select("asset_id", ids.alias("pinned")).withColumn("pinnable", F.size("pinned") > 0)


def manifest_rollup(records: DataFrame) -> DataFrame:
    """One row: tiles, distinct types, sources, modalities and shapes, tiles of each combination of modalities, extent.

    Rows are first summed up by combination, type, source and shape, which are few.
    records: asset_type, source, modalities, n_timesteps, shape, lat, lon.
    """
    low, high = ({f"{p}_{c}": f(c).alias(f"{p}_{c}") for c in ("lat", "lon")} for p, f in (("min", F.min), ("max", F.max)))
    few = records.groupBy("modalities", "asset_type", "source", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("n_timesteps") > 1).alias("temporal"), *low.values(), *high.values()
    )
    combos = few.groupBy(F.array_join("modalities", "+").alias("name")).agg(F.sum("n").alias("n"))
    combos = combos.agg(F.array_sort(F.collect_list(F.format_string("%s:%d", "name", "n"))).alias("combinations"))
    distinct = lambda c: F.array_sort(F.collect_set(c))
    one = few.agg(
        F.sum("n").alias("n_tiles"), distinct("asset_type").alias("asset_types"), distinct("source").alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("modalities")))).alias("modalities"), distinct("shape").alias("shapes"),
        F.bool_or("temporal").alias("has_temporal"), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high),
    )
    key = F.lit(0).alias("key")  # a row each
    return one.select("*", key).join(combos.select("*", key), "key").select(*one.columns[:4], "combinations", *one.columns[4:])


def windows(end: str, count: int, days: int, spark) -> DataFrame:
    """count windows of dates, the newest last."""
    k = F.lit(count - 1) - F.col("id")
    return spark.range(count).select("id", F.date_sub(F.lit(end).cast("date"), ((k + 1) * days).cast("int")).alias("start"), F.date_sub(F.lit(end).cast("date"), (k * days).cast("int")).alias("stop"))


#: First and last day of the seasons of a year (fixed values).
SEASONS = (("01-01", "03-31"), ("04-01", "06-30"), ("07-01", "09-30"), ("10-01", "12-31"))


def seasons(years: DataFrame, count: int) -> DataFrame:
    """year, season, start, stop, place: the seasons of ``count`` years up to each last one, in the order of a stack.

    Years ascend, and inside a year the seasons descend, as in a list built from the newest year back and reversed.
    """
    year = years.select(F.explode(F.sequence(F.col("last") - (count - 1), F.col("last"))).alias("year")).distinct()
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SEASONS))
    rows = year.select("year", F.posexplode(spans).alias("season", "d"))
    day = lambda c: F.concat(F.col("year").cast("string"), F.lit("-"), F.col(f"d.{c}"))
    place = F.row_number().over(Window.orderBy("year", F.desc("season"))) - 1  # four rows a year
    return rows.select("year", "season", day("a").alias("start"), day("b").alias("stop"), place.alias("place"))


def stacked(frames: DataFrame, count: int, packed: bool = False) -> DataFrame:
    """One row for each asset with count frames in order; missing ones are null, or at the end if packed. frames: asset_id, window, frame."""
    listed = frames.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "frame"))).alias("m"))
    aligned = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.try_element_at("m", i))
    stack = F.concat(F.filter(aligned, lambda x: x.isNotNull()), F.filter(aligned, lambda x: x.isNull())) if packed else aligned
    return listed.select("asset_id", stack.alias("frames"), F.element_at(F.filter(aligned, lambda x: x.isNotNull()), -1).alias("last_frame"))


def with_triage(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records with their triage confidence, high where there is none."""
    out = records.join(results.select("asset_id", "source", "confidence"), ["asset_id", "source"], "left")
    return out.fillna({"confidence": "high"})


def numbered_windows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("window", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
