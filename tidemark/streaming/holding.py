"""Records of one audit id are held in Spark's state store until their id is idle, whatever batches they come in.

Every id of every host is a group of its own, so one busy host spreads over all tasks, and a group holds a few lines.
Time is the records' own. An id closes when the watermark is `idle` past its time: the newest time seen, less `lateness`,
of all hosts. A timer for each id does this; no batch has to touch it. As the records of an id share one time, one that comes
after its id was closed is behind the watermark: Spark drops it and counts it (numRowsDroppedByWatermark; see
streaming/metrics.py). What is still held can be read from the checkpoint by Spark's state reader (`held`).

Null values are no records. Records without a usable header are let go (the batch plan does not read them either). Repeated lines are
held and released as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions import text as T
from tidemark.operators.events import record_class
from tidemark.operators.hosts import host_of
from tidemark.sources.logs import split_lines

LINE = "file string, line_no long, value string"
IDLE, LATENESS = 2.0, 5.0
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HoldUntilIdle(StatefulProcessor):
    """Lines of one (host, audit_id); all of them go when its timer fires."""

    def __init__(self, idle: float):
        self.idle_ms = max(1, int(idle * 1000))

    def init(self, handle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", LINE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = not self.lines.exists()
        at = None
        for r in rows:
            self.lines.appendValue((r["file"], r["line_no"], r["value"]))
            at = r["at_ms"]
        if new and at is not None:
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        released = [Row(file=x[0], line_no=x[1], value=x[2]) for x in self.lines.get()]
        self.lines.clear()
        yield from released

    def close(self) -> None:
        pass


def headed(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, value) -> the records among them that are read, with host, audit_id and at, their time."""
    good = split_lines(lines)[0]
    typed = good.where(record_class(T.record_type(F.col("value"))).isNotNull()).withColumn("header", T.audit_header(F.col("value")))
    known = typed.where("header is not null").select("file", "line_no", "value", host_of(F.col("value")).alias("host"), F.col("header.id").alias("audit_id"), F.coalesce("header.epoch", F.lit(0.0)).alias("epoch"))
    return known.withColumn("at", F.timestamp_millis((F.col("epoch") * 1000).cast("long"))).drop("epoch")


def hold(lines: DataFrame, idle: float = IDLE, lateness: float = LATENESS) -> DataFrame:
    """A stream of lines -> the same, an id's records all in one batch."""
    rows = headed(lines).withWatermark("at", f"{int(lateness * 1000)} milliseconds").withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("host", "audit_id").transformWithState(HoldUntilIdle(idle), LINE, "append", "eventTime")


def use_state_store(spark: SparkSession) -> None:
    """Timers and lists need Spark's RocksDB store; a session keeps the choice for its queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file, line_no, value) of the records that a query's last finished batch left in its state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "lines").load()
    return rows.select("list_element.*")
