"""Arrays as .npy files on any file system, as a data source: ``df.write.format("npy").mode("append").save(folder)``.

Each task writes its files to a folder of its own and tells the driver their names; once all tasks are through, the commit
moves them to their places, and an abort removes them. A task that is killed, or runs twice, so leaves no file behind.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def file_name(path: str) -> str:
    return f"{hashlib.md5(path.encode()).hexdigest()}.npy"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.folder)
        own, names = f"{folder}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(own)
        for batch in iterator:
            for path, shape, data in zip(*(batch.column(c) for c in ("path", "shape", "data")), strict=True):
                body = io.BytesIO()
                values = np.asarray(data.values.to_numpy(zero_copy_only=False), "float32")
                np.save(body, values.reshape(shape.as_py()), allow_pickle=False)
                names.append(file_name(path.as_py()))
                with system.open_output_stream(f"{own}/{names[-1]}") as f:
                    f.write(body.getbuffer())
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.folder)
        for message in filter(None, messages):
            for name in message.names:
                system.move(f"{message.folder}/{name}", f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.staging}")


class Arrays(DataSource):
    """Rows of path, shape, data; a row's file is named by a hash of its path, so a later row of the path replaces it."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, shape array<int>, data array<float>"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("arrays are appended; mode must be append")
        return ArrayWriter(self.options["path"])


def save_arrays(df: DataFrame, folder: str) -> None:
    """Arrays (path, shape, data) as .npy files, one a row."""
    df.sparkSession.dataSource.register(Arrays)
    typed = df.selectExpr("path", "cast(shape AS array<int>) AS shape", "cast(data AS array<float>) AS data")
    typed.write.format("npy").mode("append").save(folder)


def load_arrays(spark: SparkSession, pattern: str) -> DataFrame:
    """path, shape, data of .npy files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch.content]
            yield pd.DataFrame({"path": batch.path, "shape": [list(a.shape) for a in arrays], "data": [a.astype("float32").ravel() for a in arrays]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, shape array<int>, data array<float>")
