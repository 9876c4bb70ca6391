"""Registered queries of the audit engine, and the same results in SQL."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import text as T
from tidemark.operators import events as E
from tidemark.operators import incidents as I
from tidemark.operators import process_tree as tree_ops
from tidemark.operators import report as R
from tidemark.operators import rules as rule_ops
from tidemark.operators import syscalls as S
from tidemark.operators.storage import save
from tidemark.operators.taint import taint_flows
from tidemark.plans import oracle_values as V
from tidemark.plans.analysis import analyze, analyze_lines
from tidemark.plans.bindings import audit_events, audit_lines, auth_lines, duckdb, log_lines
from tidemark.schemas import SEVERITIES, severity_label, taint_label, taint_rank
from tidemark.sources.logs import parse_jsonl, split_lines

#: Files of all the calls of a kernel, by table.
CALLS = {table: str(Path(__file__).with_name("calls") / f"{table}.tbl") for table in ("x86_64", "i386", "aarch64")}

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a query, with SQL over the bound views, or over the tables alone if plain."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if plain else duckdb(sql)
        return f

    return register


def _records(spark, sf_dir, lines=audit_lines):
    return save(E.parse_records(split_lines(lines(spark, sf_dir))[0]))


def _tree(events):
    tree = save(tree_ops.build_tree(events))
    paths = save(tree_ops.ancestor_paths(tree, save))
    return tree, paths, save(tree_ops.chains(tree, paths))


# --- field extraction -----------------------------------------------------------------------

_PARSED = """
select line_no, k[1] as k, k[2] as v from (
  select line_no, unnest(list_zip(regexp_extract_all(body, '([^\\s=]+)=("[^"]*"|\\([^)]*\\)|\\S+)', 1), regexp_extract_all(body, '([^\\s=]+)=("[^"]*"|\\([^)]*\\)|\\S+)', 2))) as k
  from (select line_no, regexp_extract(value, '\\):\\s*(.*)$', 1) as body from lines) b) e"""


@query(_PARSED)
def fn_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("line_no", F.explode("fields").alias("k", "v"))


@query("select line_no, regexp_extract(value, 'type=(\\S+)', 1) as record_type, regexp_extract(value, 'audit\\(([^)]*)\\)', 1) as audit_id, cast(regexp_extract(value, 'audit\\(([^:]*):', 1) as double) as epoch from lines")
def fn_header(spark, sf_dir):
    """fn_record_type, fn_audit_id and fn_body_split."""
    return _records(spark, sf_dir).select("line_no", "record_type", "audit_id", "epoch")


@query("select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as digest from documents", plain=True)
def fn_audit_decode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(T.decode(F.lower(F.hex(F.encode("text", "utf-8")))).cast("binary")).alias("digest"))


@query("select event_id, '10.' || cast(event_id % 256 as varchar) || '.' || cast(pid % 256 as varchar) || '.7:' || cast(event_id % 60000 as varchar) as address from audit")
def fn_decode_sockaddr(spark, sf_dir):
    blob = F.format_string("0200%04X0A%02X%02X07", F.col("event_id") % 60000, F.col("event_id") % 256, F.col("pid") % 256)
    return audit_events(spark, sf_dir).select("event_id", T.socket_address(blob).alias("address"))


@query("select event_id, '[2001:db8:0:0:0:0:' || printf('%x', event_id % 65536) || ':' || printf('%x', pid % 65536) || ']:' || cast(event_id % 60000 as varchar) as address from audit")
def fn_decode_sockaddr6(spark, sf_dir):
    blob = F.format_string("0A00%04X0000000020010DB80000000000000000%04X%04X", F.col("event_id") % 60000, F.col("event_id") % 65536, F.col("pid") % 65536)
    return audit_events(spark, sf_dir).select("event_id", T.socket_address(blob).alias("address"))


@query("select event_id, strftime(make_timestamp(cast(epoch as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') as shown from audit")
def fn_fmt_epoch(spark, sf_dir):
    return audit_events(spark, sf_dir).select("event_id", T.show_epoch(F.col("epoch") + 0.75).alias("shown"))


@query("select event_id, case kind when 'exec' then 'exec ' || exe when 'net-connect' then 'connect ' || target else kind || ' ' || target end as label, string_split(exe, '/')[-1] as base from audit")
def fn_event_label(spark, sf_dir):
    """fn_event_label and fn_basename."""
    return audit_events(spark, sf_dir).select("event_id", T.event_label(F.col("kind"), F.col("exe"), F.col("target")).alias("label"), T.basename(F.col("exe")).alias("base"))


# --- system calls and predicates ------------------------------------------------------------

@query(f"""
select event_id, d.name as syscall_name, d.kind as syscall_kind from (
  select event_id, case event_id % 4 when 0 then 'x86_64' when 1 then 'i386' when 2 then 'aarch64' end as t, event_id % 440 as nr from audit) a
left join (values {V.CALLS}) d(t, nr, name, kind) on a.t = d.t and a.nr = d.nr""")
def sys_classify(spark, sf_dir):
    """sys_name, sys_classify_name, sys_classify and sys_is_execve, on a broadcast dimension of all calls of three kernels."""
    arch = F.element_at(F.array(*[F.lit(a) for a in ("c000003e", "40000003", "40000028", "deadbeef")]), (F.col("event_id") % 4 + 1).cast("int"))
    calls = audit_events(spark, sf_dir).select("event_id", arch.alias("arch"), (F.col("event_id") % 440).cast("string").alias("syscall_nr"))
    return S.with_syscall(calls, S.syscall_dimension(spark, CALLS)).select("event_id", "syscall_name", "syscall_kind")


def _like(c: str, parts: list[str], form: str = "contains({c}, '{p}')") -> str:
    return "(" + " or ".join(form.format(c=c, p=p) for p in parts) + ")"


@query(f"""
select event_id, {_like('lower(path)', V.SENSITIVE)} as sensitive, ({_like('path', V.NOISE, "starts_with({c}, '{p}')")} or ends_with(path, '.so') or contains(path, '.so.') or ends_with(path, 'ld.so.cache')) as noisy,
  starts_with(path, '/srv/u1') as excluded, contains(path, ':') as network, regexp_matches(lower(path), '(\\.tar|\\.tar\\.gz|\\.tgz|\\.zip|\\.7z)$') as archive
from (select event_id, case event_id % 10 when 0 then '/usr/lib/x' || target when 1 then '/proc/' || cast(pid as varchar) when 2 then target || '.so.1' when 3 then '/home/u/.ENV' else target end as path from audit) a""")
def flt_paths(spark, sf_dir):
    """flt_sensitive_path, flt_noise, flt_explicit_exclude, tnt_network_sink and tnt_archive_sink."""
    bound = audit_events(spark, sf_dir)
    path = F.expr("case event_id % 10 when 0 then '/usr/lib/x' || target when 1 then '/proc/' || cast(pid as string) when 2 then target || '.so.1' when 3 then '/home/u/.ENV' else target end")
    df = bound.select("event_id", path.alias("path"))
    p, own = F.col("path"), P.NoiseConfig(extra=("/srv/u1",))
    return df.select("event_id", P.is_sensitive(p).alias("sensitive"), P.NoiseConfig().is_noise(p).alias("noisy"), own.is_excluded(p).alias("excluded"), P.is_network_sink(p).alias("network"), P.is_archive(p).alias("archive"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DANGER = (
    "select event_id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"case when regexp_matches(both_, {_sql_text(p)}) then {_sql_text(label)} end" for p, label in V.DANGER_PATTERNS)
    + ", case base " + " ".join(f"when '{k}' then {_sql_text(v)}" for k, v in V.DANGER_PROGRAMS.items()) + " end, case when starts_with(exe, '/tmp/') then 'binary in world-writable dir' end], lambda x: x is not null))), ',') as danger "
    "from (select event_id, exe, cmdline || ' ' || exe as both_, string_split(exe, '/')[-1] as base from audit) a"
)


@query(_DANGER)
def dng_classify(spark, sf_dir):
    """dng_exe, dng_rules, dng_world_writable and dng_classify."""
    return audit_events(spark, sf_dir).select("event_id", F.array_join(P.danger_labels(F.col("exe"), F.col("cmdline")), ",").alias("danger"))


@query(f"select d.event_id, danger from ({_DANGER}) d join audit a on d.event_id = a.event_id where danger <> '' or auth = 'failed'")
def flt_flagged(spark, sf_dir):
    events = audit_events(spark, sf_dir).withColumn("danger", P.danger_labels(F.col("exe"), F.col("cmdline")))
    return R.flagged(events).select("event_id", F.array_join("danger", ",").alias("danger"))


# --- events ---------------------------------------------------------------------------------

_EVENTS = """
select row_number() over (order by epoch + 0.5, pid, pos) as seq, cast(cast(epoch as bigint) as varchar) || '.5:' || cast(event_id as varchar) as audit_id, pid, ppid, uid, kind, exe,
  case when kind = 'exec' then 'run --id=' || cast(event_id as varchar) else 'x' end as cmdline,
  case when kind = 'exec' then '' when kind = 'file' then case when event_id % 29 = 0 then '/proc/1/maps' else target end else '10.0.0.' || case uid when 0 then '10' when 1 then '255' else '1' end || ':443' end as target,
  success, case when event_id % 7 = 0 then 'watched' else '' end as audit_key, -1 as ses
from audit where kind = 'exec' or event_id % 7 = 0 or not (kind = 'file' and event_id % 29 = 0)"""


@query(_EVENTS)
def evt_syscall(spark, sf_dir):
    """agg_staple, evt_syscall, evt_target, flt_event_admission, fn_build_cmdline, fn_success and sort_events, from raw lines."""
    events, _ = E.events_of_lines(split_lines(audit_lines(spark, sf_dir))[0], S.syscall_dimension(spark))
    return events.select("seq", "audit_id", "pid", "ppid", "uid", "kind", "exe", "cmdline", "target", "success", "audit_key", "ses")


_AUTH = """
with rec as (
  select line_no, regexp_extract(value, 'type=(\\S+)', 1) as t, cast(regexp_extract(value, 'audit\\(([^:]*):', 1) as double) as epoch, cast(regexp_extract(value, 'pid=(\\d+)', 1) as bigint) as pid,
    regexp_extract(value, 'acct="([^"]*)"', 1) as acct, nullif(regexp_extract(value, ' addr=(\\S+)', 1), '?') as addr, nullif(regexp_extract(value, 'hostname=(\\S+)', 1), '?') as host, regexp_extract(value, 'res=(\\w+)', 1) as res
  from auth_lines),
fail as (select *, case when t = 'USER_ERR' then 'bad_ident' else 'auth failed' end as reason, strftime(make_timestamp(cast(epoch as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') as ts from rec where t = 'USER_ERR' or res = 'failed')
"""


@query(_AUTH + "select acct, coalesce(addr, host, 'ssh') as source, reason, '/usr/sbin/sshd' as exe, count(*) as failures, min(ts) as first, case when max(ts) = min(ts) then '' else max(ts) end as last from fail group by 1, 2, 3")
def agg_auth_failures(spark, sf_dir):
    """evt_auth_failure and agg_auth_failures."""
    return E.auth_failure_groups(E.auth_failures(_records(spark, sf_dir, auth_lines)))


@query(_AUTH + "select acct, coalesce(addr, host, 'ssh') as source, reason, count(*) as failures from fail group by 1, 2, 3")
def agg_sessions(spark, sf_dir):
    return E.session_groups(E.auth_failures(_records(spark, sf_dir, auth_lines)))


@query(_AUTH + "select pid as auth_pid, arg_max(epoch, line_no) as auth_epoch, arg_max(res <> 'failed', line_no) as auth_ok from rec where t = 'USER_AUTH' group by 1")
def agg_last_auth(spark, sf_dir):
    return E.last_verdicts(_records(spark, sf_dir, auth_lines)).drop("auth_host")


@query(_AUTH + """, last as (select pid, arg_max(epoch, line_no) as e, arg_max(res <> 'failed', line_no) as ok from rec where t = 'USER_AUTH' group by 1)
select a.event_id, coalesce(a.exe = '/usr/bin/sudo' and a.kind = 'exec' and not l.ok and l.e - (a.epoch + 0.5) >= 0 and l.e - (a.epoch + 0.5) < 30, false) as denied
from audit a left join last l on a.pid = l.pid where a.kind = 'exec'""")
def join_auth_verdict(spark, sf_dir):
    """The verdict of the same process within the half-open window after its exec."""
    events = E.events_of_lines(split_lines(log_lines(spark, sf_dir))[0], S.syscall_dimension(spark))[0].where("kind = 'exec'")
    return events.select(F.substring_index("audit_id", ":", -1).cast("bigint").alias("event_id"), F.coalesce(F.col("auth") == "failed", F.lit(False)).alias("denied"))


_SYSTEM = """
select event_id, case event_id % 4 when 0 then 'user-add' when 1 then 'service' when 2 then 'config' else 'account' end as kind,
  case event_id % 4 when 0 then 'adding-user e' || cast(uid as varchar) when 1 then 'auditd stopped' when 2 then 'add_rule: k' || cast(uid as varchar) else 'acct_lock e' || cast(uid as varchar) end as cmdline,
  case event_id % 4 when 0 then 'e' || cast(uid as varchar) when 1 then 'auditd' when 2 then 'k' || cast(uid as varchar) else 'e' || cast(uid as varchar) end as target,
  event_id % 5 <> 0 as success, array_to_string(list_filter([case when event_id % 5 = 0 then 'failed account/group change' end, case when event_id % 4 in (1, 2) then 'audit config change' end], lambda x: x is not null), ',') as danger
from audit"""


def _system_events(spark, sf_dir):
    who = "cast(uid as string)"
    value = F.expr(f"""concat('type=', case event_id % 4 when 0 then 'ADD_USER' when 1 then 'SERVICE_STOP' when 2 then 'CONFIG_CHANGE' else 'ACCT_LOCK' end, ' msg=audit(', cast(cast(epoch as bigint) as string), '.0:', cast(event_id as string), '): pid=1 auid=7 ',
      case event_id % 4 when 0 then concat('msg=\\'op=adding-user acct="e', {who}, '" exe="/usr/sbin/useradd"') when 1 then 'msg=\\'unit=auditd' when 2 then concat('op=add_rule key="k', {who}, '"') else concat('msg=\\'op=? id=e', {who}) end,
      ' res=', if(event_id % 5 = 0, 'failed', 'success'), if(event_id % 4 = 2, '', '\\''))""")
    return _events_of(spark, audit_events(spark, sf_dir).select(F.lit("system").alias("file"), F.col("pos").alias("line_no"), value.alias("value")))


def _events_of(spark, lines):
    """Events of bound lines, with the number that their audit id ends in."""
    events, _ = E.events_of_lines(save(lines), S.syscall_dimension(spark))
    return events.withColumn("event_id", F.substring_index("audit_id", ":", -1).cast("bigint"))


@query(_SYSTEM)
def evt_system(spark, sf_dir):
    """evt_account, evt_service, evt_config and evt_system_common."""
    return _system_events(spark, sf_dir).select("event_id", "kind", "cmdline", "target", "success", F.array_join("danger", ",").alias("danger"))


@query("select event_id, 'anomaly' as kind, case event_id % 3 when 0 then 'anom_promiscuous' when 1 then 'anom_login_failures' else 'anom_abend' end as cmdline, pid, '' as target, event_id % 5 <> 0 as success from audit")
def evt_anomaly(spark, sf_dir):
    value = F.expr("""concat('type=', case event_id % 3 when 0 then 'ANOM_PROMISCUOUS' when 1 then 'ANOM_LOGIN_FAILURES' else 'ANOM_ABEND' end, ' msg=audit(', cast(cast(epoch as bigint) as string), '.0:', cast(event_id as string), '): auid=7 pid=',
      cast(pid as string), ' dev=eth0', case when event_id % 5 = 0 then ' res=0' when event_id % 2 = 0 then ' res=1' else '' end)""")
    lines = audit_events(spark, sf_dir).select(F.lit("anomaly").alias("file"), F.col("pos").alias("line_no"), value.alias("value"))
    return _events_of(spark, lines).select("event_id", "kind", "cmdline", "pid", "target", "success")


@query("select event_id, 'exec' as kind, case when event_id % 3 = 0 then 'run -p ' || cast(event_id as varchar) else 'run --id=' || cast(event_id as varchar) || ' end' end as cmdline from audit")
def evt_argv(spark, sf_dir):
    """Arguments in chunks, of which each is decoded by itself, and the title of a process without arguments (fn_proctitle)."""
    head = "concat('msg=audit(', cast(cast(epoch as bigint) as string), '.5:', cast(event_id as string), '): ')"
    call = F.expr(f"concat('type=SYSCALL ', {head}, 'arch=c000003e syscall=59 success=yes exit=0 ppid=1 pid=', cast(pid as string), ' uid=0 comm=\"x\" exe=\"/bin/run\" key=(null)')")
    argv = F.expr(f"""case when event_id % 3 = 0 then concat('type=PROCTITLE ', {head}, 'proctitle=72756E002D7000', hex(cast(event_id as string)))
      else concat('type=EXECVE ', {head}, 'argc=3 a0="run" a2="end" a1_len=9 a1[1]="', cast(event_id as string), '" a1[0]=2D2D69643D') end""")
    line = F.explode(F.array(F.struct((2 * F.col("pos") - 1).alias("line_no"), call.alias("value")), F.struct((2 * F.col("pos")).alias("line_no"), argv.alias("value")))).alias("l")
    lines = audit_events(spark, sf_dir).select(F.lit("argv").alias("file"), line).select("file", "l.*")
    return _events_of(spark, lines).select("event_id", "kind", "cmdline")


@query("select seq, pid, kind, exe, target, success, cast(event_id as varchar) as host from audit")
def src_jsonl(spark, sf_dir):
    """Events written as JSON lines and read again, an unknown key kept aside."""
    row = audit_events(spark, sf_dir)
    line = F.to_json(F.struct("seq", "epoch", "pid", "ppid", "uid", "kind", "exe", "cmdline", "target", "success", F.col("event_id").cast("string").alias("host")))
    events, _ = parse_jsonl(row.select(F.col("pos").alias("line_no"), line.alias("value")))
    return events.select("seq", "pid", "kind", "exe", "target", "success", F.col("extra")["host"].cast("string").alias("host"))


@query("select 'unparseable line: ' || substr(text, 1, 60) as error from (select doc_id, unnest(string_split(text, chr(10))) as text from documents) where regexp_replace(text, '\\s+$', '') <> '' and not starts_with(trim(text), '#') and not contains(text, 'type=') and not contains(text, 'msg=audit(')".replace("substr(text, 1, 60)", "substr(regexp_replace(text, '\\s+$', ''), 1, 60)"), plain=True)
def src_audit_error(spark, sf_dir):
    """The lines of documents, none of which is an audit record."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.lit("d").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return split_lines(lines)[1].select("error")


# --- process tree ---------------------------------------------------------------------------

_CHAIN = """recursive with tree as (select pid, arg_max(ppid, pos) as ppid, arg_max(exe, pos) filter (where exe <> '') as exe from audit where pid <> 0 group by 1),
walk as (select pid, pid as node, 0 as hop from tree union all select w.pid, t.ppid, w.hop + 1 from walk w join tree t on w.node = t.pid where t.ppid <> w.node and w.hop < 65),
named as (select w.pid, w.node, w.hop, coalesce(string_split(t.exe, '/')[-1], '?') || '(' || cast(w.node as varchar) || ')' as shown from walk w left join tree t on w.node = t.pid),
chain as (select pid, arg_max(node, hop) as root, string_agg(shown, ' → ' order by hop desc) as chain from named group by 1)
"""


@query("select pid, arg_max(ppid, pos) as ppid, arg_max(exe, pos) filter (where exe <> '') as exe, arg_max(cmdline, pos) filter (where cmdline <> '') as cmdline from audit where pid <> 0 group by 1")
def tree_build(spark, sf_dir):
    return tree_ops.build_tree(audit_events(spark, sf_dir))


@query(_CHAIN + "select pid, root, chain from chain")
def tree_chain(spark, sf_dir):
    """tree_chain, tree_root, tree_chain_str and tree_label."""
    return _tree(audit_events(spark, sf_dir))[2].select("pid", "root", "chain")


@query(_CHAIN + "select distinct node as ancestor, pid from walk where hop > 0")
def tree_is_ancestor(spark, sf_dir):
    tree, paths, _ = _tree(audit_events(spark, sf_dir))
    return tree_ops.ancestry(tree, paths).select("ancestor", "pid")


# --- rules ----------------------------------------------------------------------------------

_RULE_SQL = {
    "LT001": "contains(cmdline, 'sh') and ((regexp_matches(cmdline, '/dev/tcp/|mkfifo|nc -e|ncat -e|socat EXEC') and contains(cmdline, '&')) or (contains(cmdline, '/dev/tcp/') and contains(cmdline, 'bash')))",
    "LT002": "kind = 'exec' and (ends_with(exe, '/sudo') or ends_with(exe, '/su') or starts_with(cmdline, 'sudo ')) and uid <> 0",
    "LT003": "kind = 'user-add'",
    "LT004": "kind = 'file' and contains(target, '/.ssh/') and (ends_with(target, 'id_rsa') or ends_with(target, 'id_ed25519') or contains(target, 'authorized_keys'))",
    "LT005": "kind = 'file' and regexp_matches(target, '\\.aws/credentials|\\.config/gcloud|\\.kube/config')",
    "LT006": "kind = 'net-connect' and success and regexp_matches(string_split(target, ':')[1], '^[0-9.]*\\.[0-9.]*$')",
    "LT007": "(kind = 'file' and regexp_matches(target, '/etc/cron|/etc/systemd/system|/\\.ssh/authorized_keys')) or (kind = 'exec' and regexp_matches(cmdline, 'crontab|systemctl enable|systemctl link'))",
    "LT008": "kind = 'file' and regexp_matches(target, '/\\.bash_history|/var/log/') and regexp_matches(cmdline, '> |truncate|shred|echo -n')",
    "LT009": "kind = 'exec' and (regexp_matches(cmdline, 'mysqldump|pg_dump') or (contains(cmdline, 'sqlite3') and contains(cmdline, '.dump')))",
    "LT010": "kind = 'exec' and regexp_matches(cmdline, 'tar |zip |7z ') and regexp_matches(cmdline, '\\.aws|\\.ssh|/etc/|home')",
    "ESC-001": "auth = 'failed'",
}
_FOUND = "found as (" + " union all ".join(
    f"select {_sql_text(i)} as rule_id, {_sql_text(V.TITLES[i][0])} as title, {V.TITLES[i][1]} as severity, seq, pid, pos, {int(i == 'ESC-001')} as phase, {n} as place from audit where {test}" for n, (i, test) in enumerate(_RULE_SQL.items())
) + ")"


@query(f"with {_FOUND} select rule_id, title, severity, seq, pid from found")
def rule_findings(spark, sf_dir):
    """rule_LT001 to rule_LT010 and rule_ESC001."""
    return rule_ops.findings(audit_events(spark, sf_dir)).select("rule_id", "title", "severity", "seq", "pid")


@query("select 'LT003' as rule_id, 'User account created' as title, 3 as severity, seq, cast(1 as bigint) as pid from (select event_id, row_number() over (order by cast(epoch as bigint), pos) as seq from audit) a where event_id % 4 = 0")
def rule_user_add(spark, sf_dir):
    """rule_LT003, on records of new accounts among others."""
    return rule_ops.findings(_system_events(spark, sf_dir)).select("rule_id", "title", "severity", "seq", "pid")


# --- taint ----------------------------------------------------------------------------------

_KINDS_SQL = """
select doc_id, array_to_string(list_filter([
  case when regexp_matches(p, '/id_rsa|/id_ed25519|\\.ssh/authorized_keys|/\\.ssh/control|/ssh-agent') or ends_with(p, '.pem') or ends_with(p, '.gnupg') or (contains(p, '.env') and not contains(p, '/proc/')) then '0' end,
  case when ends_with(p, '.kdbx') or ends_with(p, '.p12') or ends_with(p, '.pfx') or contains(p, '.gnupg/') or contains(p, '/keystore') then '1' end,
  case when regexp_matches(p, 'cookies|/login-data|\\.mozilla/|\\.config/google-chrome') then '2' end,
  case when regexp_matches(p, '\\.aws/credentials|\\.config/gcloud|\\.azure/|\\.kube/config') then '3' end,
  case when ends_with(p, '.sql') or contains(p, '.mysql/history') or (contains(p, 'dump') and ends_with(p, '.gz')) then '4' end,
  case when contains(p, '.csv') and regexp_matches(p, 'customer|user|klient') then '5' end], lambda x: x is not null), ',') as kinds
from (select doc_id, lower('/u' || cast(doc_id as varchar) || case doc_id % 11 when 0 then '/.ENV' when 1 then '/a.pem' when 2 then '/.gnupg/k.P12' when 3 then '/cookies' when 4 then '/.aws/credentials' when 5 then '/dump.gz' when 6 then '/users.csv'
  when 7 then '/proc/.env' when 8 then '/id_rsa' when 9 then '/x.sql' else '/plain' end) as p from documents) a"""


@query(_KINDS_SQL, plain=True)
def tnt_source_kinds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.expr("concat('/u', cast(doc_id as string), case doc_id % 11 when 0 then '/.ENV' when 1 then '/a.pem' when 2 then '/.gnupg/k.P12' when 3 then '/cookies' when 4 then '/.aws/credentials' when 5 then '/dump.gz' when 6 then '/users.csv' when 7 then '/proc/.env' when 8 then '/id_rsa' when 9 then '/x.sql' else '/plain' end)")
    return docs.select("doc_id", F.array_join(P.source_kinds(path).cast("array<string>"), ",").alias("kinds"))


@query("""select event_id, array_to_string(list_filter(string_split(cmdline || ' /k/id_rsa.' || cast(event_id as varchar) || ' id_rsa /k/a.PEM /k/plain', ' '), lambda x: contains(x, '/')
  and regexp_matches(lower(x), '/id_rsa|/id_ed25519|\\.pem$|\\.aws/credentials|\\.kube/config|\\.sql$|\\.p12$')), ' ') as tokens from audit""")
def fn_carrier_tokens(spark, sf_dir):
    cmdline = F.concat("cmdline", F.lit(" /k/id_rsa."), F.col("event_id").cast("string"), F.lit(" id_rsa /k/a.PEM /k/plain"))
    return audit_events(spark, sf_dir).select("event_id", F.array_join(P.carrier_tokens(cmdline), " ").alias("tokens"))


@query("""select event_id, case event_id % 6 when 0 then 'credentials' when 1 then 'crypto-key' when 2 then 'session-token' when 3 then 'cloud-credentials' when 4 then 'database-dump' else 'personal-data' end as label,
  case when event_id % 7 <> 0 then cast(event_id % 6 as integer) end as rank from audit""")
def fn_taint_label(spark, sf_dir):
    """Labels of kinds, and the kinds of labels; another word has none."""
    labelled = audit_events(spark, sf_dir).select("event_id", taint_label((F.col("event_id") % 6).cast("int")).alias("label"))
    return labelled.withColumn("rank", taint_rank(F.when(F.col("event_id") % 7 == 0, "other").otherwise(F.col("label"))))


_FLOWS = (
    _CHAIN.rstrip()
    + """, used as (select * from audit where success and kind in ('exec', 'file', 'net-connect', 'net-send', 'net-accept')),
words as (select pid, pos, unnest(regexp_split_to_array(cmdline, '\\s+')) as path from used where kind = 'exec'),
named_paths as (select distinct target as path from used where kind = 'file' union select distinct path from words where contains(path, '/')),
path_kinds as (select path, unnest(list_filter([
    case when regexp_matches(p, '/id_rsa|/id_ed25519|\\.ssh/authorized_keys|/\\.ssh/control|/ssh-agent|\\.pem$|\\.gnupg$') or (contains(p, '.env') and not contains(p, '/proc/')) then 0 end,
    case when regexp_matches(p, '\\.kdbx$|\\.p12$|\\.pfx$|\\.gnupg/|/keystore') then 1 end, case when regexp_matches(p, 'cookies|/login-data|\\.mozilla/|\\.config/google-chrome') then 2 end,
    case when regexp_matches(p, '\\.aws/credentials|\\.config/gcloud|\\.azure/|\\.kube/config') then 3 end, case when regexp_matches(p, '\\.sql$|\\.mysql/history|dump.*\\.gz$') then 4 end,
    case when contains(p, '.csv') and regexp_matches(p, 'customer|user|klient') then 5 end], lambda x: x is not null)) as k from (select path, lower(path) as p from named_paths) n),
sources as (select distinct path from path_kinds),
tokens as (select pid, pos, path from words where contains(path, '/') and path in (select path from sources)),
files as (select pid, pos, seq, target as path, target in (select path from sources) as is_source from used where kind = 'file'),
execs as (select pid, ppid, pos from used where kind = 'exec'),
reach as (
  select pid, cast(null as varchar) as path, pos, cast(null as bigint) as stainer from (select pid, pos from files where is_source union select pid, pos from tokens) s
  union (select e.pid, null, e.pos, null from reach r join execs e on e.ppid = r.pid and r.pos < e.pos
    union all select f.pid, null, f.pos, null from reach r join files f on f.path = r.path and r.pos < f.pos where not f.is_source
    union all select null, f.path, f.pos, f.pid from reach r join files f on f.pid = r.pid and r.pos < f.pos where not f.is_source)),
tainted as (select pid, min(pos) as since from reach where path is null group by 1),
stained as (select path, min(pos) as since, arg_min(stainer, pos) as stainer from reach where path is not null group by 1),
held as (
  select f.pid, k, f.pos from files f join path_kinds using (path) union select t.pid, k, t.pos from tokens t join path_kinds using (path)
  union (select e.pid, h.k, e.pos from held h join execs e on e.ppid = h.pid and h.pos < e.pos
    union all select f.pid, h.k, f.pos from held h join stained s on s.stainer = h.pid and h.pos < s.since join files f on f.path = s.path and not f.is_source and f.pos > s.since
    union all select t.pid, h.k, t.pos from held h join files f on f.pid = h.pid and f.is_source and f.pos >= h.pos join tokens t on t.path = f.path and t.pos > f.pos)),
holds as (select pid, k, min(pos) as since from held group by 1, 2),
spans as (select u.*, sum(case when kind = 'exec' then 1 else 0 end) over (partition by pid order by pos) as span, t.since as t_pos from used u left join tainted t using (pid)),
carried as (select *, coalesce(last_value(case when kind = 'file' and pos >= t_pos then target end ignore nulls) over (partition by pid, span order by pos rows between unbounded preceding and 1 preceding), '') as carrier from spans),
sinks as (select * from carried where starts_with(kind, 'net-') and contains(target, ':')),
own as (select s.*, h.k from sinks s join holds h on h.pid = s.pid and h.since < s.pos),
sent as (select * from own union all select s.*, h.k from sinks s join holds h on h.pid = s.ppid and h.since < s.pos where s.pos not in (select pos from own)),
outward as (select pos, seq, pid, target, carrier, k, case when kind = 'net-accept' then kind else 'net-exfil' end as sink_kind from sent
  union all select f.pos, f.seq, f.pid, f.path, f.path, h.k, 'archive-write' from files f join holds h on h.pid = f.pid and h.since <= f.pos where not f.is_source and regexp_matches(lower(f.path), '(\\.tar|\\.tar\\.gz|\\.tgz|\\.zip|\\.7z)$')),
origins as (select path, arg_min(pid, pos) as origin from (select pid, pos, path from files where is_source union all select pid, pos, path from tokens) o group by 1 union all select path, stainer from stained),
flows as (select o.pos, o.k, ['credentials', 'crypto-key', 'session-token', 'cloud-credentials', 'database-dump', 'personal-data'][o.k + 1] as kind, o.pid as sink_pid, coalesce(p.origin, o.pid) as origin_pid, o.seq as sink_seq, sink_kind, o.target as sink_target,
    coalesce(c.chain, '?(' || cast(o.pid as varchar) || ')') as chain, o.carrier
  from outward o left join origins p on o.carrier = p.path left join chain c on o.pid = c.pid)
"""
)


@query(_FLOWS + "select pos, kind, sink_pid, origin_pid, sink_seq, sink_kind, sink_target, chain, carrier from flows")
def tnt_flows(spark, sf_dir):
    """All of taint: tnt_exec, tnt_file_source, tnt_file_adopt, tnt_file_stage, tnt_net_sink and tnt_flow_row. Tests also hold it against a fold."""
    events = save(audit_events(spark, sf_dir))
    flows = taint_flows(events, _tree(events)[2])
    return flows.select(F.col("ord.pos").alias("pos"), F.col("taint.kind").alias("kind"), "sink_pid", "origin_pid", "sink_seq", "sink_kind", "sink_target", "chain", "carrier")


@query()
def tnt_carrier_cap(spark, sf_dir):
    """Taint where 64 paths are remembered, so that eviction decides. It has no SQL, tests hold it against a fold."""
    events = save(audit_events(spark, sf_dir))
    flows = taint_flows(events, _tree(events)[2], carrier_cap=64)
    return flows.select(F.col("ord.pos").alias("pos"), F.col("taint.kind").alias("kind"), "sink_pid", "origin_pid", "sink_seq", "sink_kind", "sink_target", "chain", "carrier")


@query(_FLOWS + f""", {_FOUND}, leaked as (select sink_pid as pid, array_to_string(list_sort(list_distinct(list(kind))), ',') as taints from flows group by 1)
select rule_id, seq, f.pid, coalesce(taints, '') as taints from found f left join leaked l on f.pid = l.pid""")
def fn_confirm_taints(spark, sf_dir):
    a = analyze(save(audit_events(spark, sf_dir)), confirm=True)
    return a.findings.select("rule_id", "seq", "pid", F.array_join("taints", ",").alias("taints"))


# --- correlation ----------------------------------------------------------------------------

_COR = _CHAIN + f""", {_FOUND}, rooted as (select f.*, coalesce(c.root, f.pid) as root from found f left join chain c on f.pid = c.pid),
bucket as (select root, count(*) as n, max(severity) as top, arg_min(title, (phase, pos, place)) as first_title, arg_max(pid, (severity, phase, pos, place)) as primary_pid, string_agg(rule_id, ', ' order by phase, pos, place) as signals,
  min(seq) as seq_from, max(seq) as seq_to, array_to_string(list_sort(list_distinct(list(pid))), ', ') as actors from rooted group by 1)
select b.root as root, case when n > 1 then 'Suspicious activity chain: ' || first_title || ' + ' || cast(n - 1 as varchar) || ' more signal(s)' else first_title end as title,
  case when n > 1 then least(top + 1, 4) else top end as severity, actors, c.chain, signals, seq_from, seq_to,
  'actor(s) [' || actors || ']; evidence seq ' || cast(seq_from as varchar) || '–' || cast(seq_to as varchar) || '; signals: ' || signals || '; no taint confirmation' as summary
from bucket b left join chain c on b.primary_pid = c.pid where not (n = 1 and top <= 1)"""


@query(_COR)
def cor_findings(spark, sf_dir):
    """cor_buckets, cor_lone_noise, cor_severity, cor_seq_range, cor_actors, cor_primary_chain, cor_title, cor_summary and cor_sort, with no flows."""
    events = audit_events(spark, sf_dir)
    _, _, chains = _tree(events)
    flows = spark.createDataFrame([], "ord struct<pos:bigint,kind_rank:int>, taint struct<kind:string,origin_pid:bigint,carrier:string>, sink_pid long, origin_pid long, sink_seq long, sink_kind string, sink_target string, chain string, carrier string")
    found = I.correlate(rule_ops.findings(events), flows, chains)
    return found.select("root", "title", "severity", F.array_join(F.col("actors").cast("array<string>"), ", ").alias("actors"), "chain", F.array_join("findings", ", ").alias("signals"), "seq_from", "seq_to", "summary")


def _analysis(spark, sf_dir):
    return analyze(save(audit_events(spark, sf_dir)))


_INCIDENTS = (
    _FLOWS.rstrip()
    + f""", {_FOUND}, rooted as (select f.*, coalesce(c.root, f.pid) as root from found f left join chain c on f.pid = c.pid),
signs as (select root, count(*) as n, max(severity) as top, arg_min(title, (phase, pos, place)) as first_title, arg_max(pid, (severity, phase, pos, place)) as primary_pid, list(rule_id order by phase, pos, place) as findings,
  min(seq) as f_from, max(seq) as f_to, list(distinct pid) as pids from rooted group by 1),
leaks as (select coalesce(c.root, f.sink_pid) as root, arg_min(f.sink_pid, (f.pos, f.k)) as primary_sink, min(sink_seq) as t_from, max(sink_seq) as t_to, list_concat(list(distinct f.sink_pid), list(distinct f.origin_pid)) as pids,
  list_sort(list(distinct f.kind)) as taints, list_sort(coalesce(list(distinct f.carrier) filter (where f.carrier <> ''), [])) as carriers from flows f left join chain c on f.sink_pid = c.pid group by 1),
met as (select coalesce(s.root, l.root) as root, coalesce(n, 0) as n, coalesce(top, 0) as top, first_title, primary_sink is not null as leaky, coalesce(primary_pid, primary_sink) as primary_pid, coalesce(findings, []) as findings, coalesce(taints, []) as taints,
  coalesce(carriers, []) as carriers, list_sort(list_distinct(list_concat(coalesce(s.pids, []), coalesce(l.pids, [])))) as actors, least(f_from, t_from) as seq_from, greatest(f_to, t_to) as seq_to from signs s full join leaks l on s.root = l.root),
incident as (select m.root as root, case when leaky then 'Data theft chain: ' || coalesce(first_title, 'Sensitive data') || ' → exfiltration of ' || array_to_string(taints, ' + ')
    when n > 1 then 'Suspicious activity chain: ' || first_title || ' + ' || cast(n - 1 as varchar) || ' more signal(s)' else first_title end as title,
  case when leaky then least(greatest(top, 3) + 1, 4) when n > 1 then least(top + 1, 4) else top end as rank, actors, coalesce(c.chain, '?(' || cast(primary_pid as varchar) || ')') as chain, findings, taints, carriers, seq_from, seq_to,
  'actor(s) [' || array_to_string(actors, ', ') || ']; evidence seq ' || cast(seq_from as varchar) || '–' || cast(seq_to as varchar) || '; signals: ' || case when n = 0 then 'none (taint-only)' else array_to_string(findings, ', ') end || '; '
    || case when leaky then 'taint flows confirmed: ' || array_to_string(taints, ', ') || case when len(carriers) > 0 then ' via ' || array_to_string(carriers, ', ') else '' end else 'no taint confirmation' end as summary
  from met m left join chain c on m.primary_pid = c.pid where not (n = 1 and not leaky and top <= 1)),
actor as (select root, unnest(actors) as pid from incident),
forks as (select a.root as root, arg_min(w.node, w.hop) as from_pid, a.pid as to_pid from actor a join walk w on w.pid = a.pid and w.hop > 0 join actor b on b.root = a.root and b.pid = w.node group by a.root, a.pid),
edges as (select root, from_pid, to_pid, '' as label, 'fork' as edge_kind from forks
  union all select distinct coalesce(c.root, f.sink_pid) as root, case when origin_pid = 0 then sink_pid else origin_pid end, sink_pid, sink_target, 'flow' from flows f left join chain c on f.sink_pid = c.pid)
"""
)
_LABEL = "['info', 'low', 'medium', 'high', 'critical'][rank + 1]"


@query(_INCIDENTS + f"select root, title, {_LABEL} as severity, array_to_string(actors, ',') as actors, chain, array_to_string(findings, ',') as findings, array_to_string(taints, ',') as taints, array_to_string(carriers, ',') as carriers, seq_from, seq_to, summary from incident where rank >= 1")
def incidents(spark, sf_dir):
    """The whole batch plan with taint: cor_union_roots, cor_taints and all of the above."""
    found = I.at_least(_analysis(spark, sf_dir).incidents, 1)
    return found.select("root", "title", severity_label(F.col("severity")).alias("severity"), F.array_join(F.col("actors").cast("array<string>"), ",").alias("actors"), "chain", F.array_join("findings", ",").alias("findings"), F.array_join("taints", ",").alias("taints"), F.array_join("carriers", ",").alias("carriers"), "seq_from", "seq_to", "summary")


@query(_INCIDENTS + "select root, from_pid, to_pid, label, edge_kind from edges")
def cor_edges(spark, sf_dir):
    """cor_edges_fork, cor_edges_flow and cor_edges."""
    return _analysis(spark, sf_dir).incidents.select("root", F.explode("edges").alias("e")).select("root", "e.*")


@query(
    _INCIDENTS.rstrip() + """, climb as (select root, pid, pid as node, 0 as depth from actor union all select c.root, c.pid, f.from_pid, c.depth + 1 from climb c join forks f on f.root = c.root and f.to_pid = c.node where c.depth < 65),
deep as (select root, pid, max(depth) as depth from climb group by 1, 2) select root, cast(depth as integer) as depth, array_to_string(list(pid order by pid), ',') as pids from deep group by 1, 2"""
)
def graph_layers(spark, sf_dir):
    return I.graph_layers(_analysis(spark, sf_dir).incidents).select("root", "depth", F.array_join(F.col("pids").cast("array<string>"), ",").alias("pids"))


@query(_INCIDENTS + "select root, from_pid, to_pid, label from edges e where edge_kind = 'flow' and not exists (select 1 from walk w where w.pid = e.to_pid and w.node = e.from_pid and w.hop > 0) and not exists (select 1 from tree t where t.pid = e.to_pid and t.ppid = t.pid and t.pid = e.from_pid)")
def graph_cross_hops(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return I.cross_hops(a.incidents, a.tree, a.paths)


_LOGGED = (
    _AUTH.strip().removeprefix("with ")
    + f""", verdict as (select pid, arg_max(epoch, line_no) as e, arg_max(res <> 'failed', line_no) as ok from rec where t = 'USER_AUTH' group by 1), event as (select *, cast(string_split(audit_id, ':')[1] as double) as epoch from ({_EVENTS.strip()}) x),
logged as (select seq as pos, seq, epoch, e.pid, ppid, uid, kind, exe, cmdline, target, success, case when exe = '/usr/bin/sudo' and kind = 'exec' and not v.ok and v.e - epoch >= 0 and v.e - epoch < 30 then 'failed' end as auth from event e left join verdict v on e.pid = v.pid), """
)


@query(f"recursive with {_LOGGED}" + re.sub(r"\baudit\b", "logged", _INCIDENTS).removeprefix("recursive with ") + f"select root, title, {_LABEL} as severity, chain, seq_from, seq_to, summary from incident")
def log_incidents(spark, sf_dir):
    """The whole batch plan from raw lines."""
    return analyze_lines(log_lines(spark, sf_dir)).incidents.select("root", "title", severity_label(F.col("severity")).alias("severity"), "chain", "seq_from", "seq_to", "summary")


# --- output ---------------------------------------------------------------------------------

_TABLE = """
select pos, rpad(cast(seq as varchar), 6, ' ') || ' | ' || case when length(kind) > 10 then substr(kind, 1, 9) || '…' else rpad(kind, 10, ' ') end || ' | ' || strftime(make_timestamp(cast(epoch as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') || ' | '
  || rpad(exe, 26, ' ') || ' | ' || case when length(cmdline) > 44 then substr(cmdline, 1, 43) || '…' else rpad(cmdline, 44, ' ') end || ' | ' || rpad('', 16, ' ') || ' | ' || case when auth = 'failed' then 'auth fail…' when success then 'success   ' else 'failed    ' end
  || ' | ' || rpad(cast(uid as varchar), 16, ' ') || ' | ' || rpad(cast(pid as varchar), 8, ' ') || ' | ' || rpad(cast(ppid as varchar), 8, ' ') as line from audit"""


@query(_TABLE)
def out_plain_table(spark, sf_dir):
    return R.event_lines(audit_events(spark, sf_dir).withColumn("ts", T.show_epoch(F.col("epoch"))))


@query(_INCIDENTS + f"""select n as incident_no, '{R.PREFIX}-INC-' || lpad(cast(n as varchar), 3, '0') as rule_id, case when rank >= 3 then 'error' when rank >= 1 then 'warning' else 'note' end as level, title, summary || ' [' || chain || ']' as message, {_LABEL} as severity
from (select *, cast(row_number() over (order by rank desc, root) as integer) as n from incident) i""")
def out_sarif(spark, sf_dir):
    """out_sarif and out_sarif_level."""
    return R.sarif_results(_analysis(spark, sf_dir).incidents).select("incident_no", "rule_id", "level", "title", "message", "severity")


@query(_INCIDENTS + f"""select i.root as root, cast(to_json({{'title': title, 'severity': {_LABEL}, 'actors': actors, 'chain': chain, 'findings': findings, 'taints': taints, 'carriers': carriers, 'seq_from': seq_from, 'seq_to': seq_to, 'summary': summary, 'edges': coalesce(e.edges, [])}}) as varchar) as value
from incident i left join (select root, list({{'from_pid': from_pid, 'to_pid': to_pid, 'label': label, 'edge_kind': edge_kind}} order by from_pid, to_pid, label, edge_kind desc) as edges from edges group by 1) e on i.root = e.root""")
def out_jsonl(spark, sf_dir):
    """out_json and out_jsonl_stream, a line per incident."""
    return R.json_lines(_analysis(spark, sf_dir).incidents)


@query("select event_id, case event_id % 5 when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end as label, cast(event_id % 5 as integer) as rank from audit")
def fn_severity_label(spark, sf_dir):
    from tidemark.schemas import severity_rank

    labelled = audit_events(spark, sf_dir).select("event_id", severity_label((F.col("event_id") % len(SEVERITIES)).cast("int")).alias("label"))
    return labelled.withColumn("rank", severity_rank(F.col("label")))
