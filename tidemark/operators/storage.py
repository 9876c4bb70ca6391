"""Tables written to the cluster's shared folder, to cut the lineage of loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode,
    in which all tasks see it; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not _LOCAL:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


def save(df: DataFrame, *by: str) -> DataFrame:
    """Write df under the shared folder, with a folder for each value of `by` (never null), and read it back."""
    path = f"{scratch(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
