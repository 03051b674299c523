"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset on a local master, as in tests, a temporary folder is made and set. On any other master that would
    be a folder of each machine's own, of which a reader would see a part, hence an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path for an intermediate table; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/strandlog/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a scan of it.

    Cuts the lineage with replicated files instead of executor storage, so that a lost executor costs
    no recomputation, and the table may be read several times at the price of one computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a folder; none if it isn't there."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def age_files(spark: SparkSession, path: str) -> None:
    """Gives the files of a folder rising times of change in the order of their names, by which streams read them."""
    fs, _ = _file_system(spark, path)
    names = [n for n in list_names(spark, path) if n[0] not in "_."]
    for i, name in enumerate(names):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), 1_700_000_000_000 + 1000 * i, -1)


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables of all queries whose results have been consumed; results not consumed yet are lost."""
    for s, path in _written:
        if s is spark:
            drop_path(spark, path)
    _written[:] = [x for x in _written if x[0] is not spark]


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; nothing to remove then
            return


atexit.register(_clean)
