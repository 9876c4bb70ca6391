"""Hosts. Process numbers and paths are a host's own, so those of different hosts must not meet.

Every host has a number, and a process of host h is h * 2**32 + pid: the operators work on these as on any process
numbers, and what is shown is `own_pid` of them. Host 0 has its pids as they are. Paths meet within a host as they carry
its number in front where taint is followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import number_in_order
from tidemark.operators.storage import save

PIDS = 1 << 32


def host_of(line: Column) -> Column:
    """The name that the audit daemon writes in front of a record; empty if it writes none."""
    return F.regexp_extract(line, r"^\s*node=(\S+)", 1)


def own_pid(pid: Column) -> Column:
    return pid.bitwiseAND(F.lit(PIDS - 1))


def own_pids(pids: Column) -> Column:
    return F.transform(pids, own_pid)


def number_hosts(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (host) -> (host, host_no), from 0 in order of names; behind the numbers of `known`, if there are some, which stay."""
    hosts = rows.select("host").distinct()
    if known is None:
        return number_in_order(save(hosts), ["host"], "host_no").withColumn("host_no", F.col("host_no") - 1)
    last = known.agg(F.max("host_no")).first()[0]
    new = number_in_order(save(hosts.join(known, "host", "left_anti")), ["host"], "host_no")
    return known.select("host", "host_no").unionByName(new.withColumn("host_no", F.col("host_no") + (-1 if last is None else last)))


def keyed(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """Events with host, their pid and ppid as numbers over all hosts, and host_no."""
    joined = events.join(hosts, "host")
    return joined.withColumns({c: F.col("host_no") * PIDS + F.col(c) for c in ("pid", "ppid")})


def with_host(rows: DataFrame, pid: str, hosts: DataFrame) -> DataFrame:
    """Adds the host of a process."""
    return rows.join(hosts.select("host", F.col("host_no").alias("of_no")), F.floor(F.col(pid) / PIDS) == F.col("of_no")).drop("of_no")
