"""Several hosts, records joined inside blocks, and the stream that holds records until their id is idle."""

import random

import pytest
from pyspark.sql import functions as F

from test_stream import LOG
from tidemark.functions import text as T
from tidemark.functions import tokens
from tidemark.operators import events as E
from tidemark.operators import staple as B
from tidemark.operators import syscalls as S
from tidemark.plans.analysis import analyze_lines
from tidemark.sources.logs import as_lines
from tidemark.streaming.session import StreamSession

LINE = "file string, line_no long, value string"


def on(host, lines):
    return [f"node={host} {x}" for x in lines]


def reader(t, i, pid, path, ppid=1):
    return [f'type=SYSCALL msg=audit({t}.0:{i}): arch=c000003e syscall=257 success=yes exit=3 ppid={ppid} pid={pid} uid=0 exe="/bin/cat"', f'type=PATH msg=audit({t}.0:{i}): item=0 name="{path}"']


def sender(t, i, pid, ppid=1):
    return [f'type=SYSCALL msg=audit({t}.0:{i}): arch=c000003e syscall=42 success=yes exit=0 ppid={ppid} pid={pid} uid=0 exe="/bin/curl"', f"type=SOCKADDR msg=audit({t}.0:{i}): saddr=02000050C0A80001"]


# host a steals; on host b a process of the same number sends, and one opens a file of the name that a staged
A = reader(10, 1, 100, "/home/u/.aws/credentials") + reader(11, 2, 100, "/tmp/x.dat") + sender(13, 3, 100)
B_LINES = sender(12, 1, 100) + reader(14, 2, 200, "/tmp/x.dat") + sender(15, 3, 200)


def facts(incidents):
    return sorted((r["title"], r["severity"], tuple(r["actors"]), r["chain"], tuple(r["findings"]), tuple(r["taints"]), tuple(r["carriers"]), r["seq_from"], r["seq_to"], r["summary"]) for r in incidents)


def test_processes_and_files_of_hosts_do_not_meet(spark):
    both = analyze_lines(as_lines(spark, "\n".join([x for pair in zip(on("a", A), on("b", B_LINES), strict=True) for x in pair])))
    alone = analyze_lines(as_lines(spark, "\n".join(A)))
    assert {r["sink_pid"] for r in alone.flows.collect()} == {100} and "host" in both.incidents.columns
    flows = both.flows.collect()
    assert [(r["sink_pid"], r["carrier"], r["taint"]["carrier"]) for r in flows] == [(r["sink_pid"], r["carrier"], r["taint"]["carrier"]) for r in alone.flows.collect()] and flows
    stolen = both.incidents.where("title like 'Data theft%'").collect()
    assert [(r["host"], r["actors"], r["taints"]) for r in stolen] == [("a", [100], ["cloud-credentials"])]
    # what the second host alone gives, too
    own = {r["title"] for r in analyze_lines(as_lines(spark, "\n".join(on("b", B_LINES)))).incidents.collect()}
    assert {r["title"] for r in both.incidents.where("host = 'b'").collect()} == own


def test_without_names_of_hosts_pids_are_as_they_are(spark):
    found = analyze_lines(as_lines(spark, "\n".join(LOG)))
    assert {r["host"] for r in found.incidents.collect()} == {""} and found.chains.agg(F.max("pid")).first()[0] == 1100


# --- records in blocks ------------------------------------------------------------------------


def scrambled(rng, n):
    """Records of n ids, mostly together, some apart or many times over, with odd and missing fields."""
    lines = []
    for i in range(n):
        head = f"msg=audit({1000 + i // 3}.{rng.randint(0, 9)}:{i}): "
        host = rng.choice(["", "", "node=h1 "])
        own = [f'type=SYSCALL {head}arch=c000003e syscall={rng.choice([59, 257, 42, 1])} success=yes exit=0 ppid=1 pid={rng.randint(1, 9)} uid=0 comm="c" exe="/bin/x{i}" key={rng.choice(["(null)", chr(34) + "k" + chr(34)])}\x1dUID="root" SYSCALL=open']
        own += [f'type=EXECVE {head}argc=2 a0="run" a1="--n={i}"', f'type=PATH {head}item=0 name="/srv/a{i}"', f"type=PATH {head}item=1 name=2F746D702F6{i % 10}", f"type=CWD {head}cwd=\"/\"", f"type=PROCTITLE {head}proctitle=72756E"][: rng.randint(0, 6)]
        if rng.random() < 0.2:
            own.append(own[0].replace("pid=", "ppid=7 pid=4").replace(" comm", "　comm"))
        rng.shuffle(own)
        lines += [(rng.random() * 200 + i if rng.random() < 0.1 else i, host + x) for x in own]
    return [x for _, x in sorted(lines, key=lambda p: p[0])]


@pytest.mark.parametrize(("most_open", "files"), [(B.MOST_OPEN, 1), (3, 4), (1, 2)])
def test_records_joined_in_blocks(spark, tmp_path, most_open, files):
    """The same rows as from a shuffle of all records, wherever the records of an id stand."""
    lines = scrambled(random.Random(most_open + files), 300)
    cut = len(lines) // files
    rows = [(f"f{min(i // cut, files - 1)}", i + 1, x) for i, x in enumerate(lines)]
    spark.createDataFrame(rows, LINE).repartitionByRange(3, "line_no").sortWithinPartitions("line_no").write.parquet(f"{tmp_path}/lines")
    df = spark.read.parquet(f"{tmp_path}/lines")
    show = lambda d: sorted(map(str, d.select("host", "audit_id", "epoch", "first_at", "has_execve", "argv_line", "raw", "path_name", "proctitle", "saddr", *[f"s_{n}" for n in E.PICKED]).collect()))
    want = show(E.staple(E.parse_records(df)))
    assert show(B.staple_lines(E.headed_records(df).where("class = 'exec'"), most_open)) == want and len(want) > 200
    built, other = E.events_of_lines(df, S.syscall_dimension(spark))
    whole = E.build_events(E.parse_records(df), S.syscall_dimension(spark))
    assert sorted(map(str, built.collect())) == sorted(map(str, whole.collect())) and other.where("class = 'exec'").isEmpty()


def test_few_ids_are_exchanged_on_an_ordered_log(spark, tmp_path):
    lines = [x for i in range(4000) for x in reader(1000 + i, i, i % 50, f"/srv/f{i}")]
    spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], LINE).repartitionByRange(8, "line_no").sortWithinPartitions("line_no").write.parquet(f"{tmp_path}/lines")
    saved = []
    old, B.save = B.save, lambda df: saved.append(old(df)) or saved[-1]
    try:
        rows = B.staple_lines(E.headed_records(spark.read.parquet(f"{tmp_path}/lines")).where("class = 'exec'"))
    finally:
        B.save = old
    assert rows.count() == 4000 and saved[1].count() <= 16  # the ids that several blocks have


def test_tokens_are_those_of_the_column_functions(spark):
    rng = random.Random(5)
    pieces = ["a=1", 'b="x y"', 'c="q\\"q"', "d=(e f)", "msg='op=x res=failed k=\"v w\"'", "\x1d", "\x1e", " ", " ", "　", "=", "==x", 'e="open', "f=(open", "): ", ") ", "type=X", "g='h", "é=ß", "a=2", 'h=""', "i=\\", "\x85", "j=\x1ck"]
    lines = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["x" * 200_000 + '="' + "y" * 100_000 + '" z=1']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, value string")
    want = {r["i"]: ([tuple(p) for p in r["p"]], r["f"]) for r in df.select("i", T.record_entries(F.col("value")).alias("p"), T.record_fields(F.col("value")).alias("f")).collect()}
    got = {r["i"]: ([tuple(p) for p in r["pairs"]], r["fields"]) for r in tokens.with_fields(df).collect()}
    assert got == want


# --- the stream -------------------------------------------------------------------------------


def stream_of(spark, folder, batches):
    """A stream whose batches are the given lines, a file each."""
    for n, lines in enumerate(batches):
        rows = [(f"f{n}", i + 1, x) for i, x in enumerate(lines)]
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, session, folder, tmp_path, batches):
    query = session.run(stream_of(spark, folder, batches), f"file://{tmp_path}/checkpoint", availableNow=True)
    query.awaitTermination()
    return query


def test_hosts_in_one_query_over_restarts(spark, tmp_path):
    """Two hosts in one query: an id parted over three batches stays whole, a restart goes on, late lines are counted, and each
    host's events, flows and incidents are those of a batch over its lines."""
    a, b = on("a", A), on("b", B_LINES)
    later = on("a", reader(60, 9, 300, "/srv/later")) + on("b", reader(61, 9, 301, "/srv/later"))
    found = []
    make = lambda: StreamSession(spark, f"file://{tmp_path}/state", emit=lambda df, n: found.extend(df.collect()), idle=2, lateness=5)
    folder = tmp_path / "in"
    run(spark, make(), folder, tmp_path, [[a[0], b[0]], ["", "noise"], [a[1], b[1], *a[2:4]]])
    session = make()  # another run
    query = run(spark, session, folder, tmp_path, [[*a[4:], *b[2:]], later])
    query = run(spark, session, folder, tmp_path, [on("a", reader(70, 10, 300, "/srv/last")), on("a", reader(12, 77, 300, "/srv/late"))])
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 2
    found.extend(session.flush().collect())
    for host, lines in (("a", a + later[:2] + on("a", reader(70, 10, 300, "/srv/last"))), ("b", b + later[2:])):
        batch = analyze_lines(as_lines(spark, "\n".join(lines)))
        events = lambda df: sorted((r["audit_id"], r["seq"], r["pos"], r["pid"], r["kind"], r["target"], len(r["raw"])) for r in df.collect())
        assert events(session.table("window").where(F.col("host") == host)) == events(batch.events)
        flows = {(r["pos"], r["kind"], r["sink_pid"], r["origin_pid"], r["carrier"]) for r in session.table("flows").where(F.col("host") == host).collect()}
        assert flows == {(r["ord"]["pos"], r["taint"]["kind"], r["sink_pid"], r["origin_pid"], r["carrier"]) for r in batch.flows.collect()}
        last = {r["title"]: r for r in found if r["host"] == host}
        assert facts(last.values()) == facts(batch.incidents.collect())
    assert {r["host"]: r["last_pos"] for r in session.table("counters").collect()} == {"a": 5, "b": 4}
    assert {r["host"] for r in found if r["title"].startswith("Data theft")} == {"a"}
