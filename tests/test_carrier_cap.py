"""The capped taint against a fold in plain Python, event by event."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import process_tree as tree_ops
from tidemark.operators import taint_capped
from tidemark.operators.storage import save
from tidemark.operators.taint import taint_flows
from tidemark.operators.taint_fold import TaintState, fold
from tidemark.plans.analysis import analyze
from tidemark.plans.bindings import audit_events
from tidemark.plans.queries import QUERIES

SCHEMA = "pos long, seq long, pid long, ppid long, kind string, exe string, target string, cmdline string, uid long, success boolean, auth string, host string"


def random_logs(seed, hosts=("a",), logs=40):
    """Random logs of a few processes and paths each, mixed on their hosts."""
    rng, rows = random.Random(seed), []
    for log in range(logs):
        pids, host = [log * 10 + p for p in range(1, 7)], rng.choice(hosts)
        targets = [f"/h{log}/.aws/credentials", f"/d{log}/k.p12", f"/s{log}.zip", f"/t{log}", f"/w{log}", f"/n{log}:1"]
        for _ in range(rng.randint(2, 30)):
            kind = rng.choice(["exec", "file", "file", "file", "net-connect", "net-accept", "watch"])
            cmd = " ".join(rng.sample(targets, 3)) if kind == "exec" and rng.random() < 0.5 else "x"
            rows.append((log + rng.random() * 12, rng.choice(pids), rng.choice(pids), kind, f"h{log}:1" if kind.startswith("net") else rng.choice(targets), cmd, host))
    return [Row(pos=n + 1, seq=n + 1, pid=r[1], ppid=r[2], kind=r[3], exe="e", target=r[4], cmdline=r[5], uid=0, success=rng.random() < 0.9, auth=None, host=r[6]) for n, r in enumerate(sorted(rows))]


def shown(flows):
    return [(r["ord"]["pos"], r["taint"]["kind"], r["sink_pid"], r["origin_pid"], r["sink_kind"], r["sink_target"], r["carrier"]) for r in flows.orderBy("ord").collect()]


def folded(events, cap):
    return [(f["pos"], f["kind"], f["sink_pid"], f["origin_pid"], f["sink_kind"], f["sink_target"], f["carrier"]) for f in fold([e.asDict() for e in events], TaintState(cap))]


def lines_of(df):
    tree = save(tree_ops.build_tree(df))
    return save(tree_ops.chains(tree, tree_ops.ancestor_paths(tree, save)))


@pytest.mark.parametrize(("seed", "cap"), [(1, 1), (2, 7), (3, 25), (8, 10)])
def test_equals_fold(spark, seed, cap):
    events = random_logs(seed)
    df = save(spark.createDataFrame(events, SCHEMA).drop("host"))
    want = folded(events, cap)
    assert shown(taint_flows(df, lines_of(df), carrier_cap=cap)) == want and want != folded(events, 10**6)


def test_part_of_a_log_only(spark, monkeypatch):
    """What no eviction changes isn't folded: of many logs one after another, only those whose paths are touched late."""
    quiet = [(pid, pid, "file", f"/q{pid}/.aws/credentials") for pid in range(100, 160) for _ in range(2)] + [(pid, pid, "net-connect", "h:1") for pid in range(100, 160)]
    late = [(5, 5, "file", "/late/.aws/credentials"), (5, 5, "file", "/staged"), *quiet, (6, 6, "file", "/staged"), (6, 6, "net-connect", "h:2"), (5, 5, "file", "/staged"), (7, 7, "file", "/staged"), (7, 7, "net-connect", "h:3")]
    events = [Row(pos=n + 1, seq=n + 1, pid=r[0], ppid=r[1], kind=r[2], exe="e", target=r[3], cmdline="", uid=0, success=True, auth=None, host="a") for n, r in enumerate(late)]
    df = save(spark.createDataFrame(events, SCHEMA).drop("host"))
    seen = []
    connected = taint_capped._connected
    monkeypatch.setattr(taint_capped, "_connected", lambda *a: seen.append(connected(*a)) or seen[-1])
    got = shown(taint_flows(df, lines_of(df), carrier_cap=10))
    assert got == folded(events, 10) and not any(f[2] == 6 for f in got) and any(f[2] == 7 for f in got)
    assert {r["pid"] for r in seen[-1][0].collect()} == {5, 6, 7}


def test_none_above_the_cap(spark, monkeypatch):
    monkeypatch.setattr(taint_capped, "_connected", None)
    events = random_logs(5, logs=8)
    df = save(spark.createDataFrame(events, SCHEMA).drop("host"))
    assert shown(taint_flows(df, lines_of(df), carrier_cap=1000)) == folded(events, 1000) != []
    with pytest.raises(ValueError):
        taint_flows(df, lines_of(df), carrier_cap=0)


def test_cap_per_host(spark):
    events = random_logs(6, hosts=("a", "b", "c"))
    got = analyze(save(spark.createDataFrame(events, SCHEMA)), carrier_cap=6).flows
    want = [f for host in "abc" for f in folded([e for e in events if e["host"] == host], 6)]
    bare = [(f[0], f[1], f[2] % 2**32, f[3] % 2**32, *f[4:]) for f in shown(got)]
    assert sorted(bare) == sorted(want) and want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA).drop("host")
    assert taint_flows(df, lines_of(df), carrier_cap=3).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    events = [r for r in audit_events(spark, sf_dir).where(F.col("success")).orderBy("pos").collect()]
    got = QUERIES["tnt_carrier_cap"](spark, sf_dir).collect()
    want = folded(events, 64)
    assert want != folded(events, 10**6)
    assert sorted((r["pos"], r["kind"], r["sink_pid"], r["origin_pid"], r["sink_kind"], r["sink_target"], r["carrier"]) for r in got) == sorted(want)
