"""Audit records to events: routing, joining records by audit id, admission and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.paths import ESCALATION_TOOLS, NoiseConfig, danger_labels, is_sensitive
from tidemark.functions.tokens import with_fields
from tidemark.operators.hosts import host_of
from tidemark.operators.ordering import number_by_time
from tidemark.operators.storage import save
from tidemark.operators.syscalls import with_syscall
from tidemark.schemas import EVENT

# Record types by class.
EXEC_TYPES = ["SYSCALL", "EXECVE", "CWD", "PROCTITLE", "PATH", "SOCKADDR"]
SESSION_TYPES = ["LOGIN", "USER_LOGIN", "USER_START", "USER_END", "USER_ACCT", "USER_AUTH", "USER_ERR"]
ACCOUNT_TYPES = ["USER_MGMT", "GRP_MGMT", "ADD_USER", "DEL_USER", "ADD_GROUP", "DEL_GROUP", "CHGRP_ID", "CHUSER_ID", "USER_CHAUTHTOK", "USER_ADD", "GRP_ADD", "GRP_DEL", "GRP_CHAUTHTOK", "ACCT_LOCK"]
SERVICE_TYPES = ["SERVICE_START", "SERVICE_STOP"]
ANOMALY_TYPES = ["ANOM_PROMISCUOUS", "ANOM_LOGIN_FAILURES", "ANOM_ABEND"]
USER_ADD_TYPES = ["ADD_USER", "USER_ADD", "USER_MGMT"]
#: Seconds from an escalation's exec within which a verdict is about it.
AUTH_WINDOW = 30.0

#: Fields of SYSCALL records that events are made of, by name.
PICKED = {"arch": "arch", "nr": "syscall", "success": "success", "exit": "exit", "pid": "pid", "ppid": "ppid", "uid": "uid", "ses": "ses", "comm": "comm", "exe": "exe", "key": "key", "uid_name": "UID", "call_name": "SYSCALL"}

EVENT_COLUMNS = [f.strip().split(" ", 1)[0] for f in EVENT.split(", ")]


def record_class(record_type: Column) -> Column:
    return (
        F.when(record_type.isin(*EXEC_TYPES), "exec").when(record_type.isin(*SESSION_TYPES), "session").when(record_type.isin(*ACCOUNT_TYPES), "account")
        .when(record_type.isin(*SERVICE_TYPES), "service").when(record_type.isin(*ANOMALY_TYPES), "anomaly").when(record_type == "CONFIG_CHANGE", "config")
    )


def headed_records(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) -> the records of a class that is read, with a header: adds record_type, class, audit_id, epoch and host."""
    typed = lines.withColumn("record_type", T.record_type(F.col("value"))).withColumn("class", T.bind(F.col("record_type"), record_class)).where("class is not null")
    headed = typed.withColumn("header", T.audit_header(F.col("value"))).where("header is not null")
    headed = headed.withColumn("audit_id", F.col("header.id")).withColumn("epoch", F.coalesce("header.epoch", F.lit(0.0))).drop("header")
    return headed.withColumn("host", host_of(F.col("value")))


def parse_records(lines: DataFrame) -> DataFrame:
    """headed_records with pairs and fields. The class filter stands before the field tokenizer."""
    return with_fields(headed_records(lines))


def staple(records: DataFrame) -> DataFrame:
    """Records of class exec, joined by audit id wherever they stand; per key of a record type, the last
    one that has it wins. Values are picked by partial aggregates; only argv and the raw lines are lists."""
    at = F.struct("file", "line_no")
    kind, fields = F.col("record_type"), F.col("fields")

    def last(record_type: str, key: str) -> Column:
        has = (kind == record_type) & F.map_contains_key(fields, key)
        return F.max_by(F.when(has, fields[key]), F.when(has, at))

    listed = lambda what, when: F.array_sort(F.collect_list(F.when(when, F.struct(at.alias("at"), what.alias("x")))))
    grouped = records.where("class = 'exec'").groupBy("host", "audit_id").agg(
        F.min("epoch").alias("epoch"),
        F.min(at).alias("first_at"),
        F.bool_or(kind == "SYSCALL").alias("has_syscall"),
        F.bool_or(kind == "EXECVE").alias("has_execve"),
        *[last("SYSCALL", key).alias(f"s_{name}") for name, key in PICKED.items()],
        last("PATH", "name").alias("path_name"),
        last("PROCTITLE", "proctitle").alias("proctitle"),
        last("SOCKADDR", "saddr").alias("saddr"),
        F.flatten(F.transform(listed(F.col("pairs"), kind == "EXECVE"), lambda e: e["x"])).alias("argv"),
        F.transform(listed(F.col("value"), F.lit(True)), lambda e: e["x"]).alias("raw"),
    )
    return grouped.where("has_syscall").withColumn("argv_line", T.command_line(F.col("argv"))).drop("argv")


def last_verdicts(records: DataFrame) -> DataFrame:
    """(auth_host, auth_pid, auth_epoch, auth_ok): each process's last USER_AUTH outcome, in file order."""
    own = records.where("record_type = 'USER_AUTH'").withColumn("auth_pid", T.integer(F.col("fields")["pid"], -1)).where("auth_pid >= 0")
    ok = T.unquote(F.col("fields")["res"]) != "failed"
    picked = own.groupBy(F.col("host").alias("auth_host"), T.unsigned(F.col("auth_pid")).alias("auth_pid")).agg(F.max_by(F.struct(F.col("epoch").alias("e"), ok.alias("ok")), F.struct("file", "line_no")).alias("v"))
    return picked.select("auth_host", "auth_pid", F.col("v.e").alias("auth_epoch"), F.col("v.ok").alias("auth_ok"))


def auth_failures(records: DataFrame) -> DataFrame:
    """Every rejected authentication, with its place in the log."""
    f = F.col("fields")
    res, kind = T.unquote(f["res"]), F.col("record_type")
    failed = (kind.isin("USER_AUTH", "USER_LOGIN") & (res == "failed")) | ((kind == "USER_ACCT") & res.isin("failed", "0")) | (kind == "USER_ERR")
    return records.where("class = 'session'").where(failed).select(
        "file", "line_no", T.show_epoch(F.col("epoch")).alias("ts"), "epoch", T.field(f["acct"]).alias("acct"), T.clean(f["addr"]).alias("addr"), T.field(f["hostname"]).alias("host"), T.field(f["terminal"]).alias("terminal"),
        T.field(f["exe"]).alias("exe"), F.when(kind == "USER_ERR", F.replace(T.clean(f["op"]), F.lit("PAM:"), F.lit(""))).otherwise("auth failed").alias("reason"),
    )


def syscall_events(stapled: DataFrame, dimension: DataFrame, verdicts: DataFrame, noise: NoiseConfig) -> DataFrame:
    """Stapled records to events: admission, target, command and the escalation verdict. Their danger is left to `with_danger`."""
    df = stapled.select("*", T.unquote(F.col("s_arch")).alias("arch"), T.unquote(F.col("s_nr")).alias("syscall_nr"))
    df = with_syscall(df, dimension).withColumn("syscall_kind", F.coalesce("syscall_kind", F.lit("other")))
    df = df.withColumn("is_exec", F.col("has_execve") | (F.col("syscall_kind") == "exec")).withColumn("has_key", T.clean(F.col("s_key")) != "").withColumn("path", T.field(F.col("path_name")))
    path, named = F.col("path"), F.col("path") != ""
    followed = F.col("syscall_kind").isin("file", "net-connect", "net-accept", "net-send", "net-recv", "socket")
    dropped = named & (noise.is_excluded(path) | (noise.is_noise(path) & ~is_sensitive(path)))
    df = df.where(F.col("is_exec") | F.col("has_key") | (followed & ~dropped))

    df = df.withColumn("typed", F.when(F.col("argv_line") != "", F.col("argv_line")).otherwise(T.decode(F.col("proctitle"))))
    df = df.withColumn("exe", F.coalesce(F.nullif(T.unquote(F.col("s_exe")), F.lit("")), F.substring_index("typed", " ", 1))).withColumn("cmdline", F.coalesce(F.nullif(F.col("typed"), F.lit("")), T.unquote(F.col("s_comm"))))
    kind = F.when(F.col("is_exec"), "exec").when(F.col("syscall_kind").isin("other", "exec"), "watch").otherwise(F.col("syscall_kind"))
    df = df.withColumn("kind", kind).withColumn("pid", T.unsigned(T.integer(F.col("s_pid"), 0)))
    address = F.when(F.col("kind").startswith("net-") | (F.col("kind") == "socket"), T.socket_address(F.col("saddr")))
    success = T.unquote(F.col("s_success"))

    df = df.join(verdicts, (F.col("host") == F.col("auth_host")) & (F.col("pid") == F.col("auth_pid")), "left")
    within = F.col("auth_epoch") - F.col("epoch")
    denied = F.col("is_exec") & T.basename(F.col("exe")).isin(*ESCALATION_TOOLS) & ~F.col("auth_ok") & (within >= 0) & (within < AUTH_WINDOW)
    denied = F.coalesce(denied, F.lit(False))
    signed = lambda c: F.pmod(c + 2147483648, F.lit(4294967296)) - 2147483648
    return df.select(
        T.show_epoch(F.col("epoch")).alias("ts"), "epoch", "pid", T.unsigned(T.integer(F.col("s_ppid"), 0)).alias("ppid"), T.integer(T.unquote(F.col("s_uid")), -1).alias("uid"), "kind",
        F.when(F.col("is_exec"), "exec").otherwise("watch").alias("row_kind"), "exe", "cmdline", F.coalesce(F.nullif(path, F.lit("")), address, F.lit("")).alias("target"),
        F.when(success == "no", False).when(success == "yes", True).otherwise(T.integer(F.col("s_exit"), 0) >= 0).alias("success"), "arch", "syscall_nr", F.coalesce("syscall_name", T.unquote(F.col("s_call_name"))).alias("syscall_name"),
        F.replace(T.unquote(F.col("s_key")), F.lit("\x01"), F.lit(", ")).alias("audit_key"), "audit_id", signed(T.integer(F.col("s_ses"), -1)).cast("int").alias("ses"), T.unquote(F.col("s_uid_name")).alias("uid_name"),
        F.when(denied, "failed").alias("auth"), F.lit(None).cast("array<string>").alias("danger"), "raw", F.lit(1).alias("is_syscall"), "first_at", "host",
    )


def system_events(records: DataFrame) -> DataFrame:
    """Account, service, configuration and anomaly records, an event each."""
    own = records.where("class in ('account', 'service', 'anomaly', 'config')")
    f, kind, cls = F.col("fields"), F.col("record_type"), F.col("class")
    res = F.when(F.map_contains_key(f, "res"), T.unquote(f["res"])).otherwise("-")
    op, named = T.clean(f["op"]), T.clean(f["id"])
    account_target = F.when(named == "", T.field(f["acct"])).otherwise(named)
    unit = T.field(f["unit"])
    detail = F.when(op.isin("add_rule", "remove_rule"), T.clean(f["key"])).otherwise(op)
    cmdline = (
        F.when(cls == "account", F.concat_ws(" ", F.when(op == "", F.lower(kind)).otherwise(op), account_target))
        .when(cls == "service", F.concat(unit, F.when(kind == "SERVICE_START", " started").otherwise(" stopped")))
        .when(cls == "config", F.concat(op, F.lit(": "), detail)).otherwise(F.lower(kind))
    )
    df = own.withColumn("res", res).withColumn("cmdline", cmdline)
    danger = F.array(F.when(F.col("res").isin("failed", "0"), "failed account/group change"), F.when((cls == "config") | F.col("cmdline").contains("audit"), "audit config change"))
    return df.select(
        T.show_epoch(F.col("epoch")).alias("ts"), "epoch", T.unsigned(T.integer(f["pid"], 0)).alias("pid"), F.lit(0).cast("long").alias("ppid"), T.integer(f["auid"], -1).alias("uid"),
        F.when(kind.isin(*USER_ADD_TYPES), "user-add").otherwise(cls).alias("kind"), cls.alias("row_kind"), F.when(cls == "account", T.basename(T.field(f["exe"]))).otherwise("-").alias("exe"), "cmdline",
        F.when(cls == "account", account_target).when(cls == "service", unit).when(cls == "config", detail).otherwise("").alias("target"), F.col("res").isin("success", "1", "-").alias("success"),
        F.lit("").alias("arch"), F.lit("").alias("syscall_nr"), F.lit("").alias("syscall_name"), F.lit("").alias("audit_key"), "audit_id", F.lit(0).alias("ses"), T.unquote(f["UID"]).alias("uid_name"),
        F.lit(None).cast("string").alias("auth"), F.array_compact(danger).alias("danger"), F.array("value").alias("raw"), F.lit(0).alias("is_syscall"), F.struct("file", "line_no").alias("first_at"), "host",
    )


def build_events(records: DataFrame, dimension: DataFrame, noise: NoiseConfig | None = None) -> DataFrame:
    """All events of parsed records in order, seq and pos from 1, with their host."""
    return _numbered(staple(records), records, dimension, noise)


def events_of_lines(lines: DataFrame, dimension: DataFrame, noise: NoiseConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """lines (file, line_no, value) -> (build_events of their records, the parsed records that are no part of a system call).
    Records of system calls are joined in the blocks where they stand (operators/staple.py)."""
    from tidemark.operators.staple import staple_lines

    # written, as both passes read them: no line is searched for its header twice, and each class is a table of its own size
    headed = save(headed_records(lines).sortWithinPartitions("class", "file", "line_no"), "class")
    others = save(with_fields(headed.where("class <> 'exec'")))
    return _numbered(staple_lines(headed.where("class = 'exec'")), others, dimension, noise), others


def _numbered(stapled: DataFrame, others: DataFrame, dimension: DataFrame, noise: NoiseConfig | None) -> DataFrame:
    every = syscall_events(stapled, dimension, last_verdicts(others), noise or NoiseConfig()).unionByName(system_events(others))
    ordered = number_by_time(save(every), "epoch", ["pid", "is_syscall", "first_at"], "pos")
    # behind a written table: in one method with the columns above, the JVM doesn't compile the danger patterns
    return with_danger(ordered).withColumn("seq", F.col("pos")).select("pos", *EVENT_COLUMNS, "host")


def with_danger(events: DataFrame) -> DataFrame:
    """Events with the danger of those that `syscall_events` gives."""
    found = danger_labels(F.col("exe"), F.col("cmdline"), F.when(F.col("auth") == "failed", "authentication failed"))
    return events.withColumn("danger", F.when(F.col("is_syscall") == 1, found).otherwise(F.col("danger")))


def auth_source(last_resort: str = "-") -> Column:
    shown = [F.nullif(F.col(c), F.lit("")) for c in ("addr", "host", "terminal")]
    return F.coalesce(*shown, F.lit(last_resort))


def auth_failure_groups(failures: DataFrame) -> DataFrame:
    """One row per account, source, reason and program: count, first and last time (empty if the same)."""
    grouped = failures.groupBy("acct", auth_source().alias("source"), "reason", "exe").agg(F.count(F.lit(1)).alias("failures"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return grouped.withColumn("last", F.when(F.col("last") == F.col("first"), "").otherwise(F.col("last")))


def session_groups(failures: DataFrame) -> DataFrame:
    """Rejections by account, source and reason."""
    return failures.groupBy("acct", auth_source("").alias("source"), "reason").agg(F.count(F.lit(1)).alias("failures"))
