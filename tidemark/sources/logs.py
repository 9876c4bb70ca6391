"""Batch sources: raw audit logs and normalized JSON lines."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import U, strip, strip_end
from tidemark.operators.ordering import number_by_time, number_lines
from tidemark.operators.storage import save
from tidemark.schemas import EVENT


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of one file or many, split at line feeds in parallel. Invalid UTF-8 is
    replaced. `-` reads standard input on the driver."""
    if path == "-":
        rows = [("-", i + 1, v) for i, v in enumerate(sys.stdin.read().split("\n"))]
        return spark.createDataFrame(rows, "file string, line_no long, value string")
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("value"))
    return number_lines(raw).select("file", "line_no", "value")


def as_lines(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a string, for small inputs."""
    return spark.createDataFrame([("text", i + 1, v) for i, v in enumerate(text.split("\n"))], "file string, line_no long, value string")


def line_class(value: Column) -> Column:
    """`blank` (or a comment), `record`, or `error`."""
    empty = value.rlike(U + r"^\s*(?:#|\z)")
    return F.when(value.isNull() | empty, "blank").when(value.contains("type=") | value.contains("msg=audit("), "record").otherwise("error")


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors): blank lines and comments go; what is no record becomes an error with the line's first 60 characters."""
    own = lines.withColumn("value", strip_end(F.col("value"))).withColumn("line_class", line_class(F.col("value")))
    errors = own.where("line_class = 'error'").select("file", "line_no", F.concat(F.lit("unparseable line: "), F.substring("value", 1, 60)).alias("error"))
    return own.where("line_class = 'record'").drop("line_class"), errors


_DEFAULTS = {"long": 0, "int": 0, "string": "", "boolean": False}


def parse_jsonl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with pos and extra, errors) of lines (line_no, value): one JSON event each, absent fields
    filled in, unknown keys kept in `extra`. A null where a value must stand, a number out of range
    or anything but an object is an error."""
    fields = [f.strip().split(" ", 1) for f in EVENT.split(", ")]
    nullable = {"epoch", "auth"}
    own = lines.withColumn("value", strip(F.col("value"))).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    parsed = own.withColumn("j", F.from_json("value", EVENT + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    parsed = parsed.withColumn("keys", F.json_object_keys("value"))
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull() | F.col("keys").isNull()
    for name, _ in fields:
        if name not in nullable:
            bad = bad | (F.array_contains("keys", name) & F.col(f"j.{name}").isNull())
    for name in ("pid", "ppid", "seq"):
        bad = bad | F.coalesce((F.col(f"j.{name}") < 0) | (F.col(f"j.{name}") > (4294967295 if name != "seq" else 9223372036854775807)), F.lit(False))
    bad = bad | (F.size("keys") != F.size(F.array_distinct("keys")))
    parsed = parsed.withColumn("bad", F.coalesce(bad, F.lit(True)))
    errors = parsed.where("bad").select("line_no", F.concat(F.lit("line "), F.col("line_no"), F.lit(": not a valid event")).alias("error"))
    columns = []
    for name, kind in fields:
        value = F.col(f"j.{name}")
        if name in ("uid", "ses"):
            value = F.coalesce(value, F.lit(0))
        elif kind.startswith("array"):
            value = F.coalesce(value, F.array().cast("array<string>"))
        elif name not in nullable:
            value = F.coalesce(value, F.lit(_DEFAULTS[kind]))
        columns.append(value.cast(kind).alias(name))
    known = [n for n, _ in fields]
    extra = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, v: ~k.isin(*known)).alias("extra")
    events = parsed.where("not bad").select("line_no", *columns, extra)
    events = events.withColumn("seq", F.when(F.col("seq") == 0, F.col("line_no")).otherwise(F.col("seq"))).withColumn("row_kind", F.when(F.col("row_kind") == "", F.col("kind")).otherwise(F.col("row_kind")))
    return number_by_time(save(events), "epoch", ["seq", "line_no"], "pos").drop("line_no"), errors
