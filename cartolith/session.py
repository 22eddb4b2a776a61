"""Session settings and the shared folder for cut lineages."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: The folder of each local application that has none set.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a new local folder; a cluster raises, since its machines share no local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting itself can't be changed in a running application
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _own_folders[application]
    return folder.rstrip("/")


class _Scopes(threading.local):
    """Paths written inside each call of a ``settled`` function that is running in this thread, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Writes the function's result as a table and removes every table that was written on the way to it."""

    @functools.wraps(run)
    def wrapper(*args, **kwargs) -> DataFrame:
        _scopes.open.append([])
        try:
            out = run(*args, **kwargs)
        finally:
            paths = _scopes.open.pop()
        out = written(out, run.__name__)
        remove(out.sparkSession, paths)
        return out

    return wrapper


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder, at once; the target must not exist."""
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(to) or not system.rename(at, to):
        raise OSError(f"can't move {source} to {target}")
