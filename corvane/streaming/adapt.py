"""Adapting a dataset that is read as a shuffled stream, until there are enough examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapter
from ..sources.dataset import POSITION, ShuffledDataset
from .append import AppendLog

ENTRIES = "uuid string, subset_name string, question string, target_tools string, tools string, messages string"


def entries(spark: SparkSession, path: str, ddl: str = ENTRIES, stream: bool = True, **options) -> DataFrame:
    """The dataset's rows in its shuffled order, with their place; options are those of the data source."""
    spark.dataSource.register(ShuffledDataset)
    reader = spark.readStream if stream else spark.read
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.format("shuffled").schema(f"{ddl}, {POSITION} long").load(path)


def examples(batch: DataFrame, left: int | None, least: int = 5, most: int = 100) -> DataFrame:
    """Trajectories of a batch of entries; the first `left` in the order of entries and their turns."""
    turned = adapter.turns(batch, least, most, keep=(POSITION,)).where("status = 'ok'")
    ready = adapter.trajectories(adapter.with_call_params(turned))
    return ready if left is None else ready.orderBy(POSITION, "turn").limit(left)


def adapted(spark: SparkSession, path: str, output: str, max_examples: int = 10_000, least: int = 5, most: int = 100, rows_per_batch: int = 10_000, **options) -> int:
    """Append trajectories of the dataset's entries to `output` until there are max_examples, the first ones in the dataset's
    order; stopped and run again, it goes on where it was. Gives how many there are."""
    stream = entries(spark, path, rows_per_batch=rows_per_batch, progress=f"{output}/progress.json", **options)
    return AppendLog(spark, output).run(stream, f"{output}/checkpoint", lambda df, left: examples(df, left, least, most), max_examples)
