"""The streaming session: micro-batches of lines of any number of hosts in, new incidents out.

`run` lets records through once their audit id is idle (streaming/holding.py, in Spark's state store). A batch then runs the plans of
the batch engine on what is new. What has to outlive a batch is kept as tables in a state folder, a version per batch, so
that a batch that is run again after a failure starts from the same state and writes the same result. A flush makes
a version behind its batch's, so that the next batch, in this run or a later one, goes on from it:

* pending: only where `process` is called with lines directly: records whose audit id may get more; an id closes once a
  batch brings nothing for it, or at a flush
* hosts: a number for each host; a process is one of its host (operators/hosts.py)
* verdicts: the last authentication outcome of each process
* window: the newest events of each host; older ones go, and processes that are gone from it lose their taint
* taint: the fold's state per host, so that a file staged long ago still taints who picks it up; a host's events are folded in order
  by one task, hosts in parallel
* flows: all flows so far, so an incident keeps them when it is seen again
* reported: keys of incidents that were emitted
* counters: per host the last position, and the numbers of evicted events and of carriers
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import NoiseConfig
from tidemark.operators import events as E
from tidemark.operators.hosts import PIDS, keyed, number_hosts, with_host
from tidemark.operators.incidents import correlate
from tidemark.operators.ordering import number_in_order
from tidemark.operators.process_tree import ancestor_paths, build_tree, chains
from tidemark.operators.rules import confirm_taints, findings
from tidemark.operators.storage import save
from tidemark.operators.syscalls import syscall_dimension
from tidemark.operators.taint_fold import CARRIER_CAP, TaintState, fold
from tidemark.schemas import EVENT, INCIDENT
from tidemark.sources.logs import split_lines
from tidemark.streaming.metrics import SessionMetrics, observe_lines
from tidemark.streaming.holding import IDLE, LATENESS, LINE, held, hold, use_state_store

DEFAULT_WINDOW, LEAST_WINDOW = 200_000, 1_000

_RECORD = "file string, line_no long, value string, record_type string, class string, audit_id string, epoch double, host string, pairs array<struct<k:string,v:string>>, fields map<string,string>"
_TABLES = {
    "pending": _RECORD,
    "hosts": "host string, host_no long",
    "verdicts": "auth_host string, auth_pid long, auth_epoch double, auth_ok boolean, at struct<file:string,line_no:bigint>",
    "window": f"pos long, {EVENT}, host string",
    "taint": "host string, state string",
    "flows": "host string, pos long, kind string, kind_rank int, sink_pid long, origin_pid long, sink_seq long, sink_kind string, sink_target string, carrier string",
    "reported": "key string",
    "counters": "host string, last_pos long, evicted long, carriers long",
}
_FOLDED = _TABLES["flows"] + ", state string, carriers long"
_HEAD = [c.strip().split(" ")[0] for c in _RECORD.split(", ")]

#: The batch, and the flushes since.
Version = tuple[int, int]
_VERSION = re.compile(r"(-?[0-9]+)-([0-9]+)")


def _step(cap: int):
    """New events of one host, in order, and its state so far -> flows, and one row with the state after."""

    def run(own: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        state = TaintState.from_json(states["state"].iloc[0], cap) if len(states) else TaintState(cap)
        host = (own if len(own) else states)["host"].iloc[0]
        rows = own[own["fresh"]].sort_values("pos")
        flows = fold(rows.to_dict("records"), state)
        if len(own) and own["evicting"].iloc[0]:
            state.keep_pids({int(p) for p in own["pid"]})
        last = {"state": state.to_json(), "carriers": len(state.carriers)}
        out = pd.DataFrame([*flows, last], columns=[c.strip().split(" ")[0] for c in _FOLDED.split(", ")]).astype(object)
        return out.assign(host=host)

    return run


class StreamSession:
    """A session of all hosts whose lines it gets. `folder` holds the state; `emit` gets a DataFrame of new incidents
    per batch, with its number (N-F for the Fth flush behind batch N), `emit_events` one of new events. The window is that of each host. idle and lateness, in seconds, are those of `hold`."""

    def __init__(self, spark: SparkSession, folder: str, emit: Callable[[DataFrame, int | str], None] | None = None, window: int = DEFAULT_WINDOW, noise: NoiseConfig | None = None, carrier_cap: int = CARRIER_CAP, calls: dict[str, str] | None = None, emit_events: Callable[[DataFrame, int | str], None] | None = None, idle: float = IDLE, lateness: float = LATENESS):
        self.emit_events, self.idle, self.lateness, self.checkpoint = emit_events, idle, lateness, None
        self.metrics = SessionMetrics()
        self.spark, self.folder, self.emit = spark, folder.rstrip("/"), emit
        self.window, self.noise, self.cap = max(window, LEAST_WINDOW), noise or NoiseConfig(), carrier_cap
        self.dimension = syscall_dimension(spark, calls)

    def _place(self, version: Version, name: str) -> str:
        return f"{self.folder}/{version[0]}-{version[1]}/{name}"

    def _load(self, version: Version | None, name: str) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(self._place(version, name))

    def _store(self, version: Version, name: str, df: DataFrame) -> DataFrame:
        path = self._place(version, name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _versions(self) -> list[Version]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        named = [(s.getPath(), _VERSION.fullmatch(s.getPath().getName())) for s in fs.listStatus(path)]
        return sorted((int(m[1]), int(m[2])) for p, m in named if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "done")))

    def process(self, lines: DataFrame, batch_id: int, flushes: int = 0) -> DataFrame:
        """Run one batch (file, line_no, value), or a flush behind it, which closes every pending id; returns the new incidents."""
        version, flush = (batch_id, flushes), flushes > 0
        before, state = self._before(version)
        fresh = save(E.parse_records(split_lines(lines)[0]).select(_HEAD))
        exec_records = state["pending"].unionByName(fresh.where("class = 'exec'"))
        touched = fresh.where("class = 'exec'").select("host", "audit_id").distinct()
        closed = exec_records if flush else exec_records.join(touched, ["host", "audit_id"], "left_anti").select(_HEAD)
        open_ = exec_records.join(touched, ["host", "audit_id"], "left_semi").select(_HEAD) if not flush else exec_records.limit(0)
        self._store(version, "pending", open_)
        return self._advance(version, state, closed, fresh.where("class <> 'exec'"))

    def process_closed(self, lines: DataFrame, batch_id: int, flushes: int = 0) -> DataFrame:
        """As process, for lines whose ids are complete. Without any, nothing changes and no version is written."""
        version = (batch_id, flushes)
        fresh = save(E.parse_records(lines).select(_HEAD))
        if fresh.isEmpty():
            return self.spark.createDataFrame([], INCIDENT)
        _, state = self._before(version)
        self._store(version, "pending", state["pending"])
        return self._advance(version, state, fresh.where("class = 'exec'"), fresh.where("class <> 'exec'"))

    def _before(self, version: Version) -> tuple[Version | None, dict[str, DataFrame]]:
        before = max((v for v in self._versions() if v < version), default=None)
        return before, {name: self._load(before, name) for name in _TABLES}

    def _advance(self, version: Version, state: dict[str, DataFrame], closed: DataFrame, other: DataFrame) -> DataFrame:
        """closed: exec records of complete ids; other: all other records."""
        own = E.last_verdicts(other).withColumn("at", F.lit(None).cast("struct<file:string,line_no:bigint>"))
        verdicts = self._store(version, "verdicts", own.unionByName(state["verdicts"].join(own.select("auth_host", "auth_pid"), ["auth_host", "auth_pid"], "left_anti").select(own.columns)))

        both = E.with_danger(E.syscall_events(E.staple(closed), self.dimension, verdicts.drop("at"), self.noise).unionByName(E.system_events(other)))
        both = save(both.join(state["window"].select("host", "audit_id").distinct(), ["host", "audit_id"], "left_anti"))
        hosts = self._store(version, "hosts", number_hosts(both, state["hosts"]))
        # numbers over all hosts, less those of the hosts before, behind the last position of the host
        ordered = number_in_order(both, ["host", F.coalesce(F.col("epoch"), F.lit(0.0)), "pid", "is_syscall", "first_at"], "number")
        begins = ordered.groupBy("host").agg(F.min("number").alias("begin"), F.count(F.lit(1)).alias("rows"))
        counters = save(state["counters"].join(begins, "host", "full").select("host", F.coalesce("last_pos", F.lit(0)).alias("last_pos"), F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("rows", F.lit(0)).alias("rows"), "carriers"))
        placed = ordered.join(counters.select("host", "begin", "last_pos"), "host").withColumn("pos", F.col("number") - F.col("begin") + 1 + F.col("last_pos"))
        events = save(placed.withColumn("seq", F.col("pos")).select("pos", *E.EVENT_COLUMNS, "host"))

        # positions of a host are dense, so its newest N are above a bound
        upto = counters.select("host", F.col("last_pos").alias("old_pos"), (F.col("last_pos") + F.col("rows")).alias("new_pos"))
        window = state["window"].unionByName(events).join(upto, "host").where(F.col("pos") > F.col("new_pos") - self.window)
        window = self._store(version, "window", window.select("pos", *E.EVENT_COLUMNS, "host"))
        evicting = (F.col("new_pos") > self.window).alias("evicting")
        used = window.join(upto, "host").select("host", "pos", "seq", "pid", "ppid", "kind", "target", "cmdline", "success", (F.col("pos") > F.col("old_pos")).alias("fresh"), evicting)
        folded = save(used.groupBy("host").cogroup(state["taint"].groupBy("host")).applyInPandas(_step(self.cap), _FOLDED))
        self._store(version, "taint", folded.where("state is not null").select("host", "state"))
        flows = self._store(version, "flows", state["flows"].unionByName(folded.where("state is null").drop("state", "carriers")))
        held = folded.where("state is not null").select("host", F.col("carriers").alias("held"))
        evicted = F.greatest(F.col("new_pos") - self.window, F.lit(0)).alias("evicted")
        self._store(version, "counters", upto.join(held, "host", "left").select("host", F.col("new_pos").alias("last_pos"), evicted, F.coalesce("held", F.lit(0)).cast("long").alias("carriers")))

        seen = save(keyed(window, hosts))
        tree = save(build_tree(seen))
        lines_of = save(chains(tree, ancestor_paths(tree, save)))
        over = flows.join(hosts, "host").withColumns({c: F.col("host_no") * PIDS + F.col(c) for c in ("sink_pid", "origin_pid")})
        shown = over.join(lines_of.select(F.col("pid").alias("sink_pid"), "chain"), "sink_pid", "left").select(
            F.struct("pos", "kind_rank").alias("ord"), F.struct("kind", "origin_pid", "carrier").alias("taint"), "sink_pid", "origin_pid", "sink_seq", "sink_kind", "sink_target", "chain", "carrier"
        )
        found = confirm_taints(findings(seen), shown)
        key = F.concat_ws("|", "title", F.col("seq_to").cast("string"), F.size("actors").cast("string"), "host").alias("key")
        current = save(with_host(correlate(found, shown, lines_of), "root", hosts).select("*", key))
        news = current.join(state["reported"], "key", "left_anti")
        self._store(version, "reported", state["reported"].unionByName(news.select("key")).distinct())
        news = save(news.drop("key"))
        self.spark.range(1).write.mode("overwrite").parquet(self._place(version, "done"))
        named = f"{version[0]}-{version[1]}" if version[1] else version[0]
        if self.emit_events is not None:
            self.emit_events(events, named)
        if self.emit is not None:
            self.emit(news, named)
        return news

    def flush(self) -> DataFrame:
        """Close what is pending, at the end of a stream: what `run` still holds, or what `process` does. A query that goes on from
        the same checkpoint later lets held records through again, as events that are known."""
        batch_id, flushes = (self._versions() or [(-1, 0)])[-1]
        if self.checkpoint is not None:
            return self.process_closed(held(self.spark, self.checkpoint), batch_id, flushes + 1)
        return self.process(self.spark.createDataFrame([], LINE), batch_id, flushes + 1)

    def table(self, name: str) -> DataFrame:
        """A state table after the last batch."""
        versions = self._versions()
        return self._load(versions[-1] if versions else None, name)

    def evicted(self) -> int:
        """Events that left the windows."""
        return self.table("counters").agg(F.sum("evicted")).first()[0] or 0

    def run(self, lines: DataFrame, checkpoint: str, **trigger):
        """Start a query over a stream of lines; trigger as in writeStream.trigger. stop() ends it, flush() then closes the rest;
        `metrics` tells what passed."""
        use_state_store(self.spark)
        self.checkpoint, self.metrics = checkpoint, SessionMetrics()
        self.spark.streams.addListener(self.metrics)
        closed = hold(observe_lines(lines), self.idle, self.lateness)
        query = closed.writeStream.foreachBatch(lambda df, batch_id: self.process_closed(df, batch_id)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
        self.metrics.query_id = str(query.id)
        return query


def follow(spark: SparkSession, path: str, session: StreamSession, checkpoint: str, start: str = "end", **trigger):
    """Tail a file, or all files of a glob pattern, into a session."""
    from tidemark.sources.tails import TailsSource

    spark.dataSource.register(TailsSource)
    return session.run(spark.readStream.format("audit_tails").option("path", path).option("start", start).load(), checkpoint, **trigger)
