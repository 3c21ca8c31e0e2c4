"""Streaming twins of batch operators: file admission and recent lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import files as file_ops

RECENT = "user_id long, item string, rank int"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_admit(spark: SparkSession, path: str, limits: DataFrame, kind: str, out: str, checkpoint: str, once: bool = True):
    """Admits files as they come: ``out``/ok and ``out``/rejected. A micro-batch is the batch whose size is limited."""
    source = spark.readStream.format("binaryFile").schema(file_ops.BINARY_FILE).option("recursiveFileLookup", "true").load(path)
    return admit_rows(source, limits, kind, out, checkpoint, once)


def admit_rows(source: DataFrame, limits: DataFrame, kind: str, out: str, checkpoint: str, once: bool = True):
    """As ``stream_admit`` for a stream of (path, length) rows."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        named = file_ops.inventory_of(batch).select(F.lit(str(batch_id)).alias("batch_id"), F.lit(kind).alias("kind"), "name", F.lit("").alias("mime"), F.col("length").alias("size"), "path")
        judged = file_ops.admit(named, limits)
        # a micro-batch that is run again replaces what it wrote before
        judged.where("ok").write.mode("overwrite").parquet(f"{out}/ok/batch={batch_id}")
        judged.where("not ok").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")

    writer = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class RecentItems(StatefulProcessor):
    """Keeps a user's ``k`` latest distinct items. An item's time only ever grows, so the order of arrival does not matter.

    With ``idle_ms`` a timer is set anew by each use. When it rings the state is gone and a row without an item says so; the state
    also has that time to live, in case no timer could be kept.
    """

    def __init__(self, k: int, idle_ms: int | None = None):
        self.k, self.idle_ms = k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recent", "items array<string>, times array<long>, ties array<long>", self.idle_ms and 2 * self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[int, int]] = {}
        if self.state.exists():
            items, times, ties = self.state.get()
            held = {i: (int(t), int(e)) for i, t, e in zip(items, times, ties)}
        for frame in rows:
            for item, ts, tie in zip(frame["item"], frame["ts"], frame["tie"]):
                held[item] = max(held.get(item, (int(ts), int(tie))), (int(ts), int(tie)))
        best = sorted(held.items(), key=lambda x: ((-x[1][0], -x[1][1]), x[0]))[: self.k]
        self.state.update(([i for i, _ in best], [t for _, (t, _) in best], [e for _, (_, e) in best]))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]] * len(best), "item": [i for i, _ in best], "rank": range(1, len(best) + 1)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "item": [None], "rank": [0]})

    def close(self) -> None:
        pass


def stream_recent(events: DataFrame, k: int = 6, idle_ms: int | None = None) -> DataFrame:
    """user_id, item and rank of a stream (user_id, item, ts as microseconds, tie): the whole list again on each change.

    Needs the state store in STATE_STORE. State holds ``k`` items for each user; with ``idle_ms`` a user who has not been seen for
    so long (by the clock of the machine) leaves it, and a row with no item and rank 0 says so. A late row of a user who is there
    moves nothing that is newer; one of a user who has left starts a new list.
    """
    mode = "ProcessingTime" if idle_ms else "None"
    return events.groupBy("user_id").transformWithStateInPandas(RecentItems(k, idle_ms), RECENT, "Update", mode)
