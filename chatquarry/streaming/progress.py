"""Progress of a stream as rows: a document a micro-batch, with what the stream observes of its rows."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources import sinks


class Progress(StreamingQueryListener):
    """Writes (batch, input_rows, late_rows, state_rows, observed metrics) of each micro-batch of one query to a folder.

    late_rows are those that operators with state dropped behind the watermark. A batch without rows is one, too.
    Files are named by run and batch, so that a batch that runs again after a restart is a second file; rows() takes
    the last.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name, self.ended = spark, folder, name, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.name:
            return
        row = {"batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        for metrics in (p.observedMetrics or {}).values():
            row |= metrics.asDict()
        sinks.text(self.spark, json.dumps(row), f"{self.folder}/{p.batchId:012d}-{p.runId}.json")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def watched(spark: SparkSession, folder: str, name: str, start) -> StreamingQuery:
    """Starts a query by start(name), waits for its end, and writes its progress to the folder; errors of the query are raised."""
    listener = Progress(spark, folder, name)
    spark.streams.addListener(listener)
    try:
        query = start(name)
        query.awaitTermination()
        listener.ended.wait(60)  # events come on a thread of their own, the end's last
        return query
    finally:
        spark.streams.removeListener(listener)


def rows(spark: SparkSession, folder: str, metrics: str = "") -> DataFrame:
    """(batch, at, input_rows, late_rows, state_rows, metrics ...) of the batches watched, each once."""
    kind = "batch long, at string, input_rows long, late_rows long, state_rows long" + (f", {metrics}" if metrics else "")
    some = spark.read.schema(kind).json(folder)
    return some.groupBy("batch").agg(F.max_by(F.struct(*[c for c in some.columns if c != "batch"]), "at").alias("x")).select("batch", "x.*")


def agreeing(found: DataFrame, told: DataFrame, columns: list[str]) -> DataFrame:
    """found, whose sums of the columns must be those of the batches' observed metrics in rows(); else an error when it is read."""
    sums = lambda df, name: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_{c}") for c in columns])
    same = [F.col(f"__a_{c}") == F.col(f"__b_{c}") for c in columns]
    both = sums(found, "__a").crossJoin(sums(told, "__b")).select(F.forall(F.array(*same), lambda x: x).alias("__same"))  # one row
    checked = F.when(~F.col("__same"), F.raise_error(F.lit("what was observed differs from what was committed")).cast("boolean")).otherwise(F.lit(True))
    return found.crossJoin(F.broadcast(both)).where(checked).drop("__same")
