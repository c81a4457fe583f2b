"""Append as you go: each micro-batch is written once, however often it is tried, and what is written can be read at any time.

Below the folder, data/batch=N holds the rows of batch N and commits/N says that it is whole, how many rows it has and how many
all have so far. A batch is written to its own folder, over what a broken attempt may have left, and only then committed, by
a rename; a batch that is committed already isn't written again. A log that was filled to a limit stays as it is: its last batch was
cut there, so a higher limit for it is an error. Readers take committed batches only. So a run that is stopped at
any point and started again gives each row once. One stream writes to a folder, as its batch numbers are those of its checkpoint.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import store


class AppendLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> dict[int, dict]:
        """What each committed batch says, by number; as many as there were micro-batches."""
        found = sorted(int(n) for n in store.names(self.spark, f"{self.folder}/commits") if n.isdigit())
        return {n: self._commit(n) for n in found}

    def _commit(self, n: int) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.folder}/commits/{n:012d}"))

    def last(self) -> dict:
        """What the last committed batch says."""
        found = [int(n) for n in store.names(self.spark, f"{self.folder}/commits") if n.isdigit()]
        return self._commit(max(found)) if found else {"rows": 0, "total": 0, "full": False}

    def total(self) -> int:
        """Rows of all committed batches."""
        return self.last()["total"]

    def append(self, batch: int, rows: DataFrame | Callable[[int | None], DataFrame], most: int | None = None) -> bool:
        """Write a batch; False if it was committed before. With `most`, rows is a function of how many rows are still wanted, and
        isn't called once none are."""
        if store.read_text(self.spark, f"{self.folder}/commits/{batch:012d}") is not None:
            return False
        last = self.last()
        had = last["total"]
        if last["full"] and (most is None or most > had):
            raise ValueError("the log was filled to its limit and cut there: append to a new folder")
        n, left = 0, None if most is None else most - had
        if left is None or left > 0:
            df, to = rows(left) if callable(rows) else rows, f"{self.folder}/data/batch={batch}"
            df.write.mode("overwrite").parquet(to)
            n = self.spark.read.schema(df.schema).parquet(to).count()
        return store.put_once(self.spark, f"{self.folder}/commits/{batch:012d}", json.dumps({"rows": n, "total": had + n, "full": left is not None and n >= left}))

    def read(self, schema: StructType | str) -> DataFrame:
        """Rows of all committed batches, with the batch."""
        whole = [f"{self.folder}/data/batch={n}" for n, c in self.commits().items() if c["rows"]]
        if not whole:
            empty = self.spark.createDataFrame([], schema)
            return empty.selectExpr("*", "CAST(NULL AS int) AS batch")
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*whole)

    def start(self, stream: DataFrame, checkpoint: str, make: Callable[[DataFrame, int | None], DataFrame] = lambda df, left: df, most: int | None = None) -> StreamingQuery:
        """A query that appends make(micro-batch, rows still wanted)."""
        def each(df: DataFrame, batch: int) -> None:
            self.append(batch, lambda left: make(df, left), most)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()

    def run(self, stream: DataFrame, checkpoint: str, make: Callable[[DataFrame, int | None], DataFrame] = lambda df, left: df, most: int | None = None) -> int:
        """Append until `most` rows are there or the source has no more; gives the number of rows. Run again, it goes on."""
        if most is not None and self.total() >= most:
            return self.total()
        query, idle = self.start(stream, checkpoint, make, most), 0
        try:
            while query.isActive and idle < 3 and (most is None or self.total() < most):
                time.sleep(0.2)
                now = query.status
                idle = idle + 1 if not now["isDataAvailable"] and not now["isTriggerActive"] and now["message"].startswith("Waiting") else 0
            if (failed := query.exception()) is not None:
                raise failed
        finally:
            query.stop()
        return self.total()
