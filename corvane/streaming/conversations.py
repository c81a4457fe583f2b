"""Conversations put together from turns that arrive in any order, as a keyed state with a timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "conv_id long, messages array<struct<turn:long,role:string,content:string>>, complete boolean"


class Assembly(StatefulProcessor):
    """Turns (conv_id, turn from 0, role, text, last, at) of a conversation, until all up to the one marked last are there, or no
    turn has come for `wait` milliseconds of event time: then it is given as it is, not complete.

    Of turns with one number the first that comes stays. What comes for a conversation that was given is dropped for another
    `wait`; then its state is gone. So state holds the conversations of the last two waits and nothing else."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, text string")
        self.about = handle.getValueState("about", "final long, timer long, closed boolean")

    def _timer(self, old: int | None, at: int, final: int | None, closed: bool) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.about.update((final, at, closed))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        final, timer, closed = self.about.get() if self.about.exists() else (None, None, False)
        if closed:
            return
        newest = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r.turn is None:
                continue
            if not self.turns.containsKey((r.turn,)):
                self.turns.updateValue((r.turn,), (r.role, r.text))
            if r["last"]:
                final = r.turn if final is None else min(final, r.turn)
            newest = max(newest, int(r["at"].timestamp() * 1000))
        have = [k[0] for k in self.turns.keys()]
        if final is not None and sum(0 <= k <= final for k in have) == final + 1:
            yield self._given(key, final, True)
            self.turns.clear()
            self._timer(timer, newest + self.wait, final, True)
        elif have:
            self._timer(timer, newest + self.wait, final, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        final, timer, closed = self.about.get()
        if closed:
            self.about.clear()
            return
        yield self._given(key, final, False)
        self.turns.clear()
        at = expiredTimerInfo.getExpiryTimeInMs() + self.wait
        self.handle.registerTimer(at)
        self.about.update((final, at, True))

    def _given(self, key, final: int | None, complete: bool) -> Row:
        turns = sorted((k[0], v[0], v[1]) for k, v in self.turns.iterator() if final is None or k[0] <= final)
        return Row(conv_id=key[0], messages=[Row(turn=t, role=role, content=text) for t, role, text in turns], complete=complete)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def assembled(turns: DataFrame, wait_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(conv_id, messages, complete) of a stream of turns; turns that come more than `delay` behind the newest event time may be
    dropped as late. Rows with a null conv_id are left out."""
    use_rocksdb(turns.sparkSession)
    known = turns.where("conv_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    return known.groupBy("conv_id").transformWithState(statefulProcessor=Assembly(1000 * wait_seconds), outputStructType=StructType.fromDDL(RESULT), outputMode="Append", timeMode="EventTime")
