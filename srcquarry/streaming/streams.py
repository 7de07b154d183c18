"""Structured Streaming forms: incremental ingest, heartbeats, streaks, tails, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from srcquarry.schemas import schema


def tail(spark: SparkSession, path: str, name: str = "audit_log", files_per_batch: int = 1) -> DataFrame:
    """New rows of an append-only relation, in files of its folder."""
    return spark.readStream.schema(schema(name)).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, changed: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``changed`` for each micro-batch of file versions, the latest row of a file only.

    Each applied batch id is kept below the checkpoint, so a batch that is replayed after a restart is not applied again. A failure within
    ``changed`` replays it: it has to bear that (``ingest.index`` does, it compares digests).
    """
    spark = stream.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = paths.Path(checkpoint).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batch(df: DataFrame, epoch: int) -> None:
        done = paths.Path(f"{checkpoint}/applied/{epoch}")
        if fs.exists(done):
            return
        changed(df.groupBy("file").agg(*[F.max_by(c, "seq").alias(c) for c in df.columns if c not in ("file", "seq")]), epoch)
        fs.create(done, True).close()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def heartbeats(stream: DataFrame, key: str = "run_id", at: str = "at") -> DataFrame:
    """Latest heartbeat per run (update mode; the state is one row per run)."""
    return stream.groupBy(key).agg(F.max(at).alias("last_heartbeat_at"))


def silent_runs(stream: DataFrame, gap: str = "10 minutes", late: str = "1 minute", key: str = "run_id", at: str = "at") -> DataFrame:
    """(run, start, end, beats): sessions of heartbeats that ended, a run gone silent for ``gap`` (append mode)."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def windowed(stream: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window with a watermark for late rows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(w.alias("w"), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def _step(state: dict, signature: str, size: int, repeat: int, recur: int, idle: int) -> dict:
    """State of one loop after one more attempt (the same rules as ``operators.rows.breaker``)."""
    streak = 0 if not signature else state["streak"] + 1 if signature == state["last"] else 1
    seen = signature in state["seen"]
    again = state["again"] + int(seen and streak == 1)
    better = state["low"] is None or size < state["low"]
    still = 0 if better else state["idle"] + 1
    verdict = state["verdict"] or ("repeat" if streak >= repeat else "oscillation" if again >= recur else "no progress" if still >= idle else "")
    return {"last": signature, "streak": streak, "seen": state["seen"] | {signature}, "again": again, "low": size if better else state["low"], "idle": still, "verdict": verdict}


EMPTY: dict[str, Any] = {"last": None, "streak": 0, "seen": frozenset(), "again": 0, "low": None, "idle": 0, "verdict": ""}


class Breaker(StatefulProcessor):
    """Per key: streak, reappearances and attempts without progress; the verdict is sticky.

    The signatures seen live in a map state, one entry each; the rest is one row.
    """

    def __init__(self, repeat: int = 3, recur: int = 2, idle: int = 5):
        self.limits = (repeat, recur, idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "last string, streak int, again int, low bigint, idle int, verdict string")
        self.seen = handle.getMapState("seen", "signature string", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        state = dict(EMPTY)
        if self.row.exists():
            last, streak, again, low, idle, verdict = self.row.get()
            state |= {"last": last, "streak": streak, "again": again, "low": low, "idle": idle, "verdict": verdict}
        frame = pd.concat(list(rows)).sort_values("id")
        out = []
        for i, signature, size in zip(frame["id"], frame["signature"], frame["size"]):
            known = self.seen.containsKey((signature,))
            state["seen"] = {signature} if known else set()
            state = _step(state, signature, int(size), *self.limits)
            self.seen.updateValue((signature,), (1,))
            out.append((key[0], int(i), state["streak"], state["again"], state["idle"], state["verdict"]))
        self.row.update((state["last"], state["streak"], state["again"], state["low"], state["idle"], state["verdict"]))
        yield pd.DataFrame(out, columns=["key", "id", "streak", "recurrences", "idle", "verdict"])

    def close(self) -> None:
        pass


def breaker(stream: DataFrame, key: str = "run_id", repeat: int = 3, recur: int = 2, idle: int = 5) -> DataFrame:
    """(key, id, streak, recurrences, idle, verdict) of a stream of (key, id, signature, size); needs the RocksDB state store."""
    return stream.select(F.col(key).alias("key"), "id", "signature", "size").groupBy("key").transformWithStateInPandas(
        statefulProcessor=Breaker(repeat, recur, idle), outputStructType="key string, id bigint, streak int, recurrences int, idle int, verdict string", outputMode="Append", timeMode="None"
    )


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is available, through a memory sink (tests and small jobs)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
