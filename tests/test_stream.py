import random

from tidemark.plans.analysis import analyze_lines
from tidemark.sources.logs import as_lines
from tidemark.streaming.session import StreamSession, follow

LOG = [
    'type=SYSCALL msg=audit(10.0:1): arch=c000003e syscall=257 success=yes exit=3 ppid=1 pid=100 uid=0 exe="/bin/cat"', 'type=PATH msg=audit(10.0:1): item=0 name="/home/u/.aws/credentials"',
    'type=SYSCALL msg=audit(11.0:2): arch=c000003e syscall=257 success=yes exit=3 ppid=1 pid=100 uid=0 exe="/bin/cat"', 'type=PATH msg=audit(11.0:2): item=0 name="/tmp/.sysupdate.tar.gz"',
    "type=USER_AUTH msg=audit(12.0:3): pid=7 msg='op=PAM:x res=failed'",
    'type=SYSCALL msg=audit(13.0:4): arch=c000003e syscall=257 success=yes exit=3 ppid=2 pid=1100 uid=0 exe="/bin/mv"', 'type=PATH msg=audit(13.0:4): item=0 name="/tmp/.sysupdate.tar.gz"',
    'type=SYSCALL msg=audit(14.0:5): arch=c000003e syscall=42 success=yes exit=0 ppid=2 pid=1100 uid=0 exe="/bin/curl"', "type=SOCKADDR msg=audit(14.0:5): saddr=02000050C0A80001",
]


def test_stream_equals_batch(spark, tmp_path):
    batch = analyze_lines(as_lines(spark, "\n".join(LOG)))
    session = StreamSession(spark, f"file://{tmp_path}/state")
    rng, at, n = random.Random(1), 0, 0
    while at < len(LOG):
        size = rng.randint(2, 4)
        rows = [("text", at + i + 1, v) for i, v in enumerate(LOG[at : at + size])]
        session.process(spark.createDataFrame(rows, "file string, line_no long, value string"), n)
        at, n = at + size, n + 1
    again = session.process(spark.createDataFrame(rows, "file string, line_no long, value string"), n - 1)  # a batch that is run again
    assert again.columns and session.table("counters").first()["last_pos"] >= 1
    session.flush()
    key = lambda rows: sorted((r["audit_id"], r["seq"], r["kind"], r["target"]) for r in rows)
    assert key(session.table("window").collect()) == key(batch.events.collect())
    flows = {(r["sink_seq"], r["kind"], r["sink_pid"], r["origin_pid"], r["carrier"]) for r in session.table("flows").collect()}
    assert flows == {(r["sink_seq"], r["taint"]["kind"], r["sink_pid"], r["origin_pid"], r["carrier"]) for r in batch.flows.collect()}
    assert session.table("reported").where("key like 'Data theft%'").count() >= 1


def test_follow(spark, tmp_path):
    path = tmp_path / "b.log"
    path.write_text("\n".join(LOG) + "\n")
    found = []
    session = StreamSession(spark, f"file://{tmp_path}/state", emit=lambda df, n: found.extend(df.collect()))
    query = follow(spark, str(path), session, f"file://{tmp_path}/checkpoint", start="begin", processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    found.extend(session.flush().collect())
    assert any("exfiltration" in r["title"] for r in found)


def test_state_survives_as_text():
    from tidemark.operators.taint_fold import TaintState, fold

    event = lambda pos, pid, kind, target, ppid=1, cmdline="": {"pos": pos, "seq": pos, "pid": pid, "ppid": ppid, "kind": kind, "target": target, "cmdline": cmdline, "success": True}
    events = [event(1, 5, "file", "/home/u/.ssh/id_rsa"), event(2, 5, "file", "/tmp/a"), event(3, 6, "exec", "", 5), event(4, 7, "file", "/tmp/a"), event(5, 7, "net-send", "h:1"), event(6, 6, "net-send", "h:2")]
    whole, parted, state = fold(events), [], TaintState()
    for e in events:
        parted += fold([e], state)
        state = TaintState.from_json(state.to_json())
    assert parted == whole and whole


def lines_of(reader, start, end):
    return [x for p in reader.partitions(start, end) for x in reader.read(p)]


def test_tails_of_many_files(tmp_path):
    """A hundred growing files, long lines over many ranges, parts of lines, rotation, truncation, files that come and go."""
    from tidemark.sources.tails import TailsReader

    names = [tmp_path / f"{i:03}.log" for i in range(100)]
    for n in names:
        n.write_bytes(b"old\n")
    reader = TailsReader({"path": f"{tmp_path}/*.log", "start": "end", "rangebytes": "64"})
    start = reader.initialOffset()
    wanted = []
    for i, n in enumerate(names):
        with n.open("ab") as f:
            own = [b"x" * (i * 7 % 300) + b"\xff" * (i % 2), b"", b"line %d" % i]
            f.write(b"\n".join(own) + b"\npart")
        wanted += [(str(n), x.decode("utf-8", "replace")) for x in own]
    end = reader.latestOffset()
    got = lines_of(reader, start, end)
    assert sorted((f, v) for f, _, v in got) == sorted(wanted) and len({(f, n) for f, n, _ in got}) == len(got)
    assert lines_of(reader, end, reader.latestOffset()) == []
    names[0].rename(str(names[0]) + ".1")  # renamed with a part of a line, which is ended there
    with open(str(names[0]) + ".1", "ab") as f:
        f.write(b"ial\n")
    names[0].write_bytes(b"new\n")
    names[1].write_bytes(b"cut\n")  # shrank
    names[2].unlink()
    (tmp_path / "later.log").write_bytes(b"first\n")
    with names[3].open("ab") as f:
        f.write(b"y" * 300_000 + b"\nz")
    after = TailsReader({"path": f"{tmp_path}/*.log", "rangebytes": "1000"}).latestOffset()  # as after a restart
    got = sorted((f, v) for f, _, v in lines_of(reader, end, after))
    assert got == sorted([(str(names[0]), "partial"), (str(names[0]), "new"), (str(names[1]), "cut"), (str(tmp_path / "later.log"), "first"), (str(names[3]), "part" + "y" * 300_000)])
    assert lines_of(reader, after, reader.latestOffset()) == []


def test_follow_of_files_with_metrics_and_a_sink(spark, tmp_path):
    """Two growing files in one session; the numbers that Spark tells; incidents in files, each batch once although it is run again or killed."""
    from tidemark.streaming.sinks import IncidentFiles

    for name, lines in (("a.log", [LOG[0], "what is this", LOG[1], "# comment", ""]), ("b.log", LOG[2:])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    sink = IncidentFiles(f"file://{tmp_path}/out")
    assert sink.read(spark).isEmpty()
    session = StreamSession(spark, f"file://{tmp_path}/state", emit=sink)
    query = follow(spark, f"{tmp_path}/?.log", session, f"file://{tmp_path}/checkpoint", start="begin", processingTime="0 seconds")
    query.processAllAvailable()
    last = query.lastProgress["batchId"]
    query.stop()
    m = session.metrics
    assert m.wait_for(last)
    assert (m.lines, m.records, m.errors, m.late, m.held) == (12, 9, 1, 0, 5) and "12 lines" in m.summary()
    news = session.flush()
    values = [r["value"] for r in sink.read(spark).collect()]
    assert len(values) == news.count() > 0 and any("exfiltration" in v for v in values) and m.records == 9
    assert session.evicted() == 0 and session.table("counters").first()["last_pos"] == 4
    sink(news, "7")
    (tmp_path / "out" / "batch=7" / "_SUCCESS").unlink()  # a batch that was killed
    assert len(sink.batches(spark)) == 1 and sink.read(spark).count() == len(values)
    sink(news, "7")
    sink(news, "7")
    assert sink.batches(spark)[-1] == "7" and sink.read(spark).count() == 2 * len(values)
