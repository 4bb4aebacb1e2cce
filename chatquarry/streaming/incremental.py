"""Incremental runs on Structured Streaming: chunked scoring with resume, running totals, a monitor with state, alerts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import monitor
from . import manifest


def chunks(spark: SparkSession, path: str, schema: str, files: int = 1, form: str = "json") -> DataFrame:
    """A stream over the files of a folder, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def files_a_batch(spark: SparkSession, path: str, batches: int) -> int:
    """How many files a micro-batch of chunks() must take so that a folder's Parquet files make no more than so many batches."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // batches))


def started(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """A query over all that is there, committing each chunk's result with its manifest; a rerun resumes after the last chunk.

    A chunk that was committed before the checkpoint knew of it isn't computed again. manifest.committed() reads them.
    """

    def append(batch: DataFrame, number: int) -> None:
        manifest.commit(step(batch), out, number)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Runs started() to its end."""
    started(stream, step, out, checkpoint).awaitTermination()


def running_totals(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Attempts, right ones and keepers so far, as a table in memory."""
    totals = stream.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("correct").alias("correct"), F.count_if("kept").alias("kept"))
    totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spikes(stream: DataFrame) -> DataFrame:
    """Events of a log whose divergence spikes; stateless."""
    return stream.where(monitor.kl_spike(F.col("step"), F.col("kl")))


#: What the monitor needs as the session's spark.sql.streaming.stateStore.providerClass.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of runs that rolling_signal() holds as one state each; the rows held of a bucket must fit a task's memory.
BUCKETS = 1024


def _packed(df: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_all().to_pandas()


def _means(values: np.ndarray, first: np.ndarray, rows: int, stretch: int = 20_000) -> np.ndarray:
    """The mean of each value and those before it, `rows` in all at most, none of them before place first[k]."""
    back, out = np.arange(rows), np.empty(len(values))
    for a in range(0, len(values), stretch):
        at = np.arange(a, min(a + stretch, len(values)))
        places = at[:, None] - back
        within = places >= first[at, None]
        out[at] = np.where(within, values[np.maximum(places, 0)], 0.0).sum(1) / within.sum(1)
    return out


def _monitor(rows: int) -> StatefulProcessor:
    level, warns, errs = monitor.SIGNAL_LEVEL, monitor.WARN_STEP, monitor.ERROR_STEP

    class Monitor(StatefulProcessor):
        """Holds the rows of a bucket of runs back until the watermark has passed them, then gives them out in order.

        Rows are held in blocks, one for what a batch brings, and put in order and averaged as arrays, all runs at once.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "block binary")
            self.last = handle.getValueState("last", "block binary")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            new = pd.concat([batch[["run", "at", "step", "value"]] for batch in rows], ignore_index=True)
            new = new[new["value"].notna()]
            if len(new):
                self.handle.registerTimer(int(new["at"].max()) // 1000 + 1)
            yield self.passed(new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            yield self.passed(None, timerValues.getCurrentWatermarkInMs())

        def passed(self, new: pd.DataFrame | None, watermark: int) -> pd.DataFrame:
            old = [_unpacked(r[0]) for r in self.held.get()]
            all_ = [*old, *([new] if new is not None and len(new) else [])]
            all_ = pd.concat(all_, ignore_index=True) if all_ else None
            ready = None if all_ is None else all_[all_["at"] <= watermark * 1000].sort_values(["at", "step", "value"], kind="stable")
            if ready is None or not len(ready):
                if new is not None and len(new):
                    self.held.appendValue((_packed(new),))
                return pd.DataFrame({"run": pd.Series(dtype=object), "step": pd.Series(dtype="int64"), "rolling_mean": pd.Series(dtype="float64"), "alert": pd.Series(dtype=object)})
            rest = all_[all_["at"] > watermark * 1000]
            self.held.put([(_packed(rest),)]) if len(rest) else self.held.clear()
            before = [_unpacked(self.last.get()[0])] if self.last.exists() else []
            both = pd.concat([*before, ready.assign(now=True)], ignore_index=True).sort_values("run", kind="stable", ignore_index=True)  # what came out before stays ahead
            place = both.groupby("run", sort=False).cumcount()
            first = np.arange(len(both)) - place.to_numpy()
            mean = _means(both["value"].to_numpy(np.float64), first, rows)
            kept = both[both.groupby("run", sort=False).cumcount(ascending=False) < rows - 1]
            self.last.update((_packed(kept.assign(now=False)),))
            now = both["now"].to_numpy(bool)
            step, high = both["step"].to_numpy("int64"), mean > level
            alert = np.where(high & (step >= errs), "error", np.where(high & (step >= warns), "warn", "ok"))
            return pd.DataFrame({"run": both["run"][now], "step": step[now], "rolling_mean": mean[now], "alert": alert[now].astype(object)})

        def close(self) -> None:
            pass

    return Monitor()


def rolling_signal(stream: DataFrame, late: str, run: str = "run", rows: int = monitor.SIGNAL_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """The monitor of operators.monitor over a stream of (run, ts timestamp, step, value) whose rows may come in any order.

    Rows of a run are held in state until the watermark, `late` (an interval) behind the latest ts of all runs, has
    passed them, and come out in order of ts, then step; rows without a value are left out. What comes later than that
    is dropped and counted, see progress.Progress. The last rows come out when a row far ahead, of any run and without
    a value, has moved the watermark over them. Runs are hashed into buckets, whose number must stay the same over a
    checkpoint. A row without a run is left out. Needs the state store ROCKS.
    """
    kind = dict(stream.dtypes)[run]
    some = stream.select(F.col(run).alias("run"), "ts", F.unix_micros("ts").alias("at"), "step", "value", F.pmod(F.xxhash64(run), F.lit(buckets)).alias("bucket")).withWatermark("ts", late)
    out = some.groupBy("bucket").transformWithStateInPandas(_monitor(rows), f"run {kind}, step long, rolling_mean double, alert string", "Append", "EventTime")
    return out.withColumnRenamed("run", run)
