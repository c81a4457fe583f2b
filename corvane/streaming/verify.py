"""Incremental verification and deduplication of trajectories as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import strip
from ..operators import repl
from ..operators import verify as V
from ..sources import schema as S
from .append import AppendLog


def read_stream(spark: SparkSession, folder: str, ddl: str = S.TRAJECTORY, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.where(strip(F.col("value")) != "").select(F.from_json("value", ddl).alias("r")).select("r.*")


def verified(stream: DataFrame) -> DataFrame:
    """The format stage, which needs no state, on each row as it comes."""
    return V.staged(stream.drop("reject_stage", "reject_reason"), V.format_reason(F.col("messages"), F.coalesce("turns", F.lit(0))))


def verified_whole(stream: DataFrame, tools: DataFrame, expected: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """All three stages on rows that have blocks and failed already: each micro-batch joins the tools, the expected parameters and the
    verdicts, which are tables. Needs no state. expected and verdicts have one row for a key, or the last counts, as in V.verify()."""
    return V.verify(stream.drop("reject_stage", "reject_reason"), tools, expected, verdicts)


def append_verified(stream: DataFrame, folder: str, tools: DataFrame, expected: DataFrame | None = None, verdicts: DataFrame | None = None) -> int:
    """The same on rows(traj_id, registry, query, correct_tool, turns, messages) whose code blocks are answered from the registry
    first, inside each micro-batch; batches are appended to `folder` once each. Gives the number of rows; run again, it goes on."""
    def make(batch: DataFrame, _: int | None) -> DataFrame:
        return V.verify(repl.executed(batch, tools), tools, expected, verdicts)

    return AppendLog(stream.sparkSession, folder).run(stream, f"{folder}/checkpoint", make)


def roles_checked(stream: DataFrame) -> DataFrame:
    return stream.withColumn("reason", F.coalesce(V.role_reason(F.col("messages")), F.lit("ok")))


def first_seen(stream: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark, so that state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, once each, and stop; a later run goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
