"""Small files and tables in the folder that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, removed at the session's end. Where none is set, a local session takes one
    below the warehouse; on a cluster that might be a folder of the driver alone, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    store, path = _at(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store.deleteOnExit(path)
    return path.toString()


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once to a shared folder and read back: what is used twice is computed once, and a lost executor costs nothing."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in order; none if it isn't there."""
    store, path = _at(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    store, at = _at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, by a new name and a rename; False where the file is there already."""
    store, at = _at(spark, path)
    if store.exists(at):
        return False
    _, new = _at(spark, f"{at.getParent().toString()}/.{at.getName()}-{uuid.uuid4().hex}")
    stream = store.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if store.rename(new, at):
        return True
    store.delete(new, False)
    return False
