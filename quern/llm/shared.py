"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the
master is local (tests, a single machine) a temporary folder is made and set. Whatever is written here survives
the loss of an executor, and cuts the lineage of what is read back.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder, removed when the driver's JVM ends."""
    path = f"{root(spark)}/quern/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it has ended, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with the same schema."""
    path = fresh(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote of these tables, which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of that many rows at most in what is stored inside, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One-dimensional arrays as one Arrow file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    batch = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), pa.array(x)) for x in arrays.values()], list(arrays))
    with fs.open_output_stream(path) as f, pa.ipc.new_file(f, batch.schema) as w:
        w.write_batch(batch)


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    """What save_arrays wrote: views of a mapped file where that is local."""
    fs, path = pafs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    return {name: batch.column(k).values.to_numpy() for k, name in enumerate(batch.schema.names)}
