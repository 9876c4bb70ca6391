"""What a session did, told by Spark with each micro-batch: no job of its own, nothing counted on the driver.

Lines are counted by `observe` where they pass through the plan; records that came after their id was closed, and records
held, are figures of the state store.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.sources.logs import line_class

OBSERVED = "tidemark_lines"


def observe_lines(lines: DataFrame) -> DataFrame:
    """The lines as they are; a query over them reports how many passed, and how many were records or no such thing."""
    kind = line_class(F.col("value"))
    return lines.observe(OBSERVED, F.count(F.lit(1)).alias("lines"), F.count_if(kind == "record").alias("records"), F.count_if(kind == "error").alias("errors"))


class SessionMetrics(StreamingQueryListener):
    """Sums over a session's batches: lines, records, errors (lines that are no records), late (records of closed ids). `held`
    is the number of ids that wait after the last batch, `batch_id` that batch."""

    def __init__(self) -> None:
        self.query_id: str | None = None
        self.batch_id, self.batches, self.lines, self.records, self.errors, self.late, self.held = -1, 0, 0, 0, 0, 0, 0
        self._seen = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.query_id is not None and str(p.id) != self.query_id:
            return
        with self._seen:
            self.batch_id, self.batches = p.batchId, self.batches + 1
            row = p.observedMetrics.get(OBSERVED)
            if row is not None:
                self.lines, self.records, self.errors = self.lines + row["lines"], self.records + row["records"], self.errors + row["errors"]
            self.late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.held = sum(int(s.numRowsTotal) for s in p.stateOperators)
            self._seen.notify_all()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def wait_for(self, batch_id: int, seconds: float = 30) -> bool:
        """Reports come behind their batch: wait for that of a batch."""
        with self._seen:
            return self._seen.wait_for(lambda: self.batch_id >= batch_id, seconds)

    def summary(self) -> str:
        return f"{self.lines} lines · {self.records} records · {self.errors} unparseable · {self.late} late · {self.held} held"
