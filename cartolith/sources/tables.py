"""Readers and writers of asset tables, manifests, results, logs and arrays."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.session import move
from cartolith.sources.arrays import load_arrays as load_arrays
from cartolith.sources.arrays import save_arrays as save_arrays
from cartolith.sources.geojson import tolerant_geojson as tolerant_geojson

TAGS = "map<string,string>"
SPLIT_COLUMNS = {
    "asset_id": "string", "region": "string", "sector": "string", "asset_type": "string", "lat": "double", "lon": "double",
    "block_id_x": "bigint", "block_id_y": "bigint", "split": "string", "split_protocol": "string",
}
ASSETS = "asset_id string, asset_type string, lat double, lon double, name string, source string, osm_tags string"
#: Keys that may wrap a run's results.
WRAPPERS = ("linear_probe", "finetune", "supervised", "random_features")


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """An asset table from parquet or csv, by suffix; osm_tags is decoded from JSON text."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, schema=ASSETS, escape='"')
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")
    if dict(df.dtypes).get("osm_tags") == "string":
        df = df.withColumn("osm_tags", F.from_json("osm_tags", TAGS))
    return df


def save_assets(df: DataFrame, path: str) -> None:
    """Parquet and csv without the tags."""
    flat = df.drop("osm_tags")
    flat.write.mode("overwrite").parquet(f"{path}.parquet")
    flat.write.mode("overwrite").csv(f"{path}.csv", header=True)


def candidates(nodes: DataFrame, ways: DataFrame, areas: DataFrame) -> DataFrame:
    """One table of element candidates from landed nodes, ways and areas; areas stand for closed ways and relations."""
    return nodes.unionByName(ways, allowMissingColumns=True).unionByName(areas, allowMissingColumns=True)


def load_manifests(spark: SparkSession, pattern: str, record: str) -> DataFrame:
    """Records of many manifests with region and sector from the names of their folders, dataset_<region>_<sector>_..."""
    raw = spark.read.schema(f"records array<struct<{record}>>").json(pattern, multiLine=True)
    raw = raw.withColumn("path", F.input_file_name())
    name = r"dataset_([a-z-]+)_([a-z]+)"
    return raw.select(
        F.regexp_extract("path", name, 1).alias("region"), F.regexp_extract("path", name, 2).alias("sector"), F.explode("records").alias("r")
    ).select("region", "sector", "r.*")


def save_dataset(records: DataFrame, path: str) -> None:
    """Records by cell as JSON, and a flat summary with joined modalities."""
    records.write.mode("overwrite").partitionBy("region", "sector").json(f"{path}/records")
    arrays = [c for c, t in records.dtypes if t.startswith("array") and c != "modalities"]
    flat = records.drop(*arrays).withColumn("modalities", F.array_join("modalities", "+"))
    flat.write.mode("overwrite").csv(f"{path}/summary", header=True)


def save_split(df: DataFrame, path: str) -> None:
    """The split artifact: required columns in fixed order and types."""
    missing = set(SPLIT_COLUMNS) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df.select(*(F.col(c).cast(t).alias(c) for c, t in SPLIT_COLUMNS.items())).write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("asset_id", "split")


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """region, sector, target, threshold, sample_rows, run of each cell."""
    cell = "struct<target int, threshold int, sample_rows int, run string>"
    raw = spark.read.schema(f"seed int, cells map<string,{cell}>").json(path, multiLine=True)
    rows = raw.select(F.explode("cells").alias("cell", "v"))
    return rows.select(F.split("cell", "/")[0].alias("region"), F.split("cell", "/")[1].alias("sector"), "v.*")


DECISION = "asset_id string, reviewer string, decision string, label string, note string, at timestamp"
#: Appended logs sort after all files that reviewers' names begin.
APPENDED = "decisions_~"


def load_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decision logs decisions_*.jsonl with the order of their lines: file, then line.

    A large log is read by many tasks, a range of bytes each: line is the range's first byte and the row in it, which sorts as
    the lines do.
    """
    meta, row = F.col("_metadata"), F.monotonically_increasing_id()
    text = spark.read.text(f"{folder}/decisions_*.jsonl")
    line = F.struct(meta["file_block_start"].alias("byte"), row.alias("row"))
    lines = text.select(meta["file_path"].alias("file"), line.alias("line"), "value").filter("trim(value) <> ''")
    return lines.select("file", "line", F.from_json("value", DECISION).alias("e")).select("e.*", "file", "line")


def append_decisions(df: DataFrame, folder: str) -> None:
    """Appends rows, in their order, to the logs that load_decisions reads: a folder that appears once it is whole."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.select("asset_id", "reviewer", "decision", "label", "note", "at").write.json(f"{folder}/_{name}")
    move(df.sparkSession, f"{folder}/_{name}", f"{folder}/{APPENDED}{name}.jsonl")


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-seed results whatever key wraps them: path, confusion, per_class_f1, history."""
    run = "struct<history array<struct<epoch int, train_loss double, val_acc double, val_macro_f1 double, time_s double>>, test struct<confusion array<array<bigint>>, per_class_f1 array<double>>>"
    fields = ", ".join(f"{w} {run}" for w in WRAPPERS)
    raw = spark.read.schema(f"{fields}, {run[7:-1]}").json(pattern, multiLine=True)
    found = F.coalesce(*(F.col(w) for w in WRAPPERS), F.struct("history", "test"))
    return raw.select(F.input_file_name().alias("path"), found.alias("r")).select("path", "r.test.confusion", "r.test.per_class_f1", "r.history")


def confusion_rows(results: DataFrame) -> DataFrame:
    """path, truth, pred, n from nested matrices."""
    rows = results.select("path", F.posexplode("confusion").alias("truth", "row"))
    return rows.select("path", "truth", F.posexplode("row").alias("pred", "n"))


def save_results(conditions: DataFrame, path: str) -> None:
    """One document with all conditions."""
    conditions.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(*conditions.columns)).alias("conditions"))).alias("value")).write.mode("overwrite").text(path)


def load_batches(spark: SparkSession, folder: str, record: str) -> DataFrame:
    """decisions.json of every batch_* folder in the order of the batches."""
    raw = spark.read.schema(record).json(f"{folder}/batch_*/decisions.json", multiLine=True)
    return raw.withColumn("batch", F.regexp_extract(F.input_file_name(), r"(batch_[^/]+)", 1))


def missing_batches(spark: SparkSession, packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Batches with a packet and no decisions."""
    return packets.select("batch").distinct().join(decisions.select("batch").distinct(), "batch", "left_anti")
