"""Incidents as files of JSON lines, each batch once.

A batch is a folder of its own, written by the executors under Spark's commit protocol and marked when it is complete. A batch
that was killed leaves an unmarked folder, which readers pass over; run again, it replaces that folder. So no incident is
doubled or lost, whatever is killed. A flush is a batch of its own, behind the one it follows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incidents import at_least
from tidemark.operators.report import json_lines

_PART = re.compile(r"batch=((-?[0-9]+)(?:-([0-9]+))?)")


class IncidentFiles:
    """For `StreamSession(emit=...)`: incidents of a severity or more go to folder/batch=N (or N-F for the Fth flush behind N)."""

    def __init__(self, folder: str, least: int = 0):
        self.folder, self.least = folder.rstrip("/"), least

    def __call__(self, incidents: DataFrame, batch: int | str) -> None:
        rows = json_lines(at_least(incidents, self.least))
        rows.select("value").write.mode("overwrite").text(f"{self.folder}/batch={batch}")

    def batches(self, spark: SparkSession) -> list[str]:
        """The complete ones, in order."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.folder)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        named = [(s.getPath(), _PART.fullmatch(s.getPath().getName())) for s in fs.listStatus(top)]
        done = [(int(m[2]), int(m[3] or 0), m[1]) for p, m in named if m and fs.exists(hadoop.Path(p, "_SUCCESS"))]
        return [x[2] for x in sorted(done)]

    def read(self, spark: SparkSession) -> DataFrame:
        """(batch, value) of all complete batches."""
        empty = spark.createDataFrame([], "batch string, value string")
        paths = [f"{self.folder}/batch={b}" for b in self.batches(spark)]
        if not paths:
            return empty
        rows = spark.read.schema("value string").text(paths)
        return rows.select(F.regexp_extract(F.input_file_name(), r"batch=([0-9-]+)", 1).alias("batch"), "value")
