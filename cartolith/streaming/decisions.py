"""The decision log as a stream: latest decisions and their status kept current.

The state of an asset is the latest decision of each of its reviewers, kept in the engine's state store by asset; a batch
touches the assets that it brings decisions for, and the buckets of the status table that hold them are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartolith.operators.review import status
from cartolith.session import remove

LOG_SCHEMA = "asset_id string, reviewer string, decision string, label string, note string, at timestamp, line long"
#: Latest decisions of an asset: one entry for each reviewer, in parallel arrays.
STATE = "reviewer array<string>, decision array<string>, label array<string>, at array<long>, line array<long>"
ENTRY = "asset_id string, reviewer string, decision string, label string, version long"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, files: int = 1) -> DataFrame:
    """JSON-lines files as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def latest_stream(log: DataFrame) -> DataFrame:
    """The last decision of each asset and reviewer, in update mode."""
    last = F.max_by(F.struct("decision", "label", "note", "line"), F.struct("at", "line")).alias("e")
    return log.groupBy("asset_id", "reviewer").agg(last).select("asset_id", "reviewer", "e.*")


def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes an asset's new decisions into its state and returns all its latest ones."""
    held = {}
    if state.exists:
        held = {r: (at, line, d, label) for r, d, label, at, line in zip(*state.get, strict=True)}
    for part in parts:
        times = part["at"].astype("int64")
        for reviewer, decision, label, at, line in zip(part.reviewer, part.decision, part.label, times, part.line, strict=True):
            new = (int(at), int(line), decision, label)
            if reviewer not in held or new[:2] > held[reviewer][:2]:
                held[reviewer] = new
    names = sorted(held)
    columns = [[held[n][i] for n in names] for i in (2, 3, 0, 1)]
    state.update((names, *columns))
    yield pd.DataFrame({"asset_id": key[0], "reviewer": names, "decision": columns[0], "label": columns[1], "version": max(columns[3])})


STATUS = "asset_id string, status string, final_label string, reviewers array<string>"
#: Buckets of the status table; a batch rewrites those that hold an asset it changes.
BUCKETS = 64


def _versions(spark: SparkSession, status_path: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket and came to an end, latest first. A few folders for each bucket."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{status_path}/batch=*")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for found in system.globStatus(at) or []:
        folder = found.getPath()
        if system.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            number = int(folder.getName().split("=")[1])
            for bucket in system.listStatus(folder):
                name = bucket.getPath().getName()
                if name.startswith("bucket="):
                    out.setdefault(int(name.split("=")[1]), []).append(number)
    return {k: sorted(v, reverse=True) for k, v in out.items()}


def _read(spark: SparkSession, status_path: str, heads: dict[int, int]) -> DataFrame:
    """The rows of these buckets as of these batches."""
    if not heads:
        return spark.createDataFrame([], STATUS)
    folders = [f"{status_path}/batch={n}/bucket={k}" for k, n in sorted(heads.items())]
    return spark.read.schema(STATUS).parquet(*folders)


def merge_status(changed: DataFrame, number: int, status_path: str, buckets: int = BUCKETS) -> None:
    """Puts changed statuses into the table as batch ``number``.

    The buckets that they fall into are written anew, old rows and new, so the table grows with assets, not with batches. A
    batch's buckets count once all are written (a marker of the writer); of each bucket the version before is kept, from
    which a batch that is run again starts, and older ones are removed.
    """
    spark = changed.sparkSession
    placed = changed.withColumn("bucket", F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
        if not touched:
            return
        before = {k: [n for n in v if n < number] for k, v in _versions(spark, status_path).items() if k in touched}
        held = _read(spark, status_path, {k: v[0] for k, v in before.items() if v}).join(placed.select("asset_id"), "asset_id", "left_anti")
        held = held.withColumn("bucket", F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int"))
        rows = held.unionByName(placed.select(*held.columns)).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{status_path}/batch={number}")
        remove(spark, [f"{status_path}/batch={n}/bucket={k}" for k, v in before.items() for n in v[1:]])
    finally:
        placed.unpersist()


def keep_status(log: DataFrame, status_path: str, checkpoint: str):
    """Starts a query that merges the status of the assets that each batch changes into a table. ``current_status`` reads it."""
    rows = log.select("asset_id", "reviewer", "decision", "label", "at", "line").groupBy("asset_id")
    latest = rows.applyInPandasWithState(fold, ENTRY, STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        merge_status(status(batch), number, status_path)

    return latest.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, status_path: str) -> DataFrame:
    """The latest status of each asset; none before the first batch."""
    return _read(spark, status_path, {k: v[0] for k, v in _versions(spark, status_path).items()})


def pending_stream(assets: DataFrame, completed: DataFrame, key: str = "asset_id") -> DataFrame:
    """Assets of a file stream that no earlier run completed; the checkpoint of the writer makes restarts resume."""
    return assets.join(completed.select(key), key, "left_anti")
