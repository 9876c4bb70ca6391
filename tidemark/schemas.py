"""Row types and ordered vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = (
    "seq long, ts string, epoch double, pid long, ppid long, uid long, kind string, row_kind string, exe string, cmdline string, target string, success boolean, arch string, "
    "syscall_nr string, syscall_name string, audit_key string, audit_id string, ses int, uid_name string, auth string, danger array<string>, raw array<string>"
)
AUTH_FAILURE = "ts string, epoch double, acct string, addr string, host string, terminal string, exe string, reason string"
FINDING = "rule_id string, title string, severity int, seq long, pid long, exe string, detail string, taints array<string>"
FLOW = "taint struct<kind:string,origin_pid:bigint,carrier:string>, sink_pid long, origin_pid long, sink_seq long, sink_kind string, sink_target string, chain string, carrier string"
INCIDENT = (
    "root long, title string, severity int, actors array<bigint>, chain string, findings array<string>, taints array<string>, carriers array<string>, seq_from long, seq_to long, summary string, "
    "edges array<struct<from_pid: bigint, to_pid: bigint, label: string, edge_kind: string>>, host string"
)

#: Severities in ascending order; rows carry the place, output the label.
SEVERITIES = ("info", "low", "medium", "high", "critical")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
#: Kinds of sensitive data in the order in which flows of one event are listed.
TAINT_KINDS = ("credentials", "crypto-key", "session-token", "cloud-credentials", "database-dump", "personal-data")


def severity_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def severity_rank(label: Column) -> Column:
    """The place of a label; null if it is none."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def taint_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in TAINT_KINDS]), rank + 1)


def taint_rank(label: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in TAINT_KINDS]), label)
    return F.when(at > 0, (at - 1).cast("int"))
