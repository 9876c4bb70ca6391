"""Taint: how sensitive data moves between processes and files, as a time-respecting reachability.

Without eviction the kinds that a process holds never shrink, a source path's stain only grows, and
any other path's kinds are fixed when it is first stained. So who holds what, from which position
on, is a smallest fixpoint: first when each process and path is tainted at all (which tells who
stained a path), then per kind. Each round joins what is new with the events and keeps the earliest
position; the number of rounds is the number of hops, not of events. Flows follow relationally.
With a carrier cap, the parts that an eviction changes are taken from operators/taint_capped.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import carrier_tokens, is_archive, is_network_sink, source_kinds
from tidemark.operators.fixpoint import fixpoint
from tidemark.operators.hosts import own_pid
from tidemark.operators.storage import save
from tidemark.operators.taint_capped import capped
from tidemark.schemas import taint_label

_NUMBER = "host_no"
KINDS_USED = ["exec", "file", "net-connect", "net-send", "net-accept"]


def _relevant(events: DataFrame) -> DataFrame:
    used = events.where(F.col("success") & F.col("kind").isin(*KINDS_USED)).select("pos", "seq", "pid", "ppid", "kind", "target", "cmdline", *([_NUMBER] if _NUMBER in events.columns else []))
    if _NUMBER in events.columns:
        used = used.withColumn("target", F.when(F.col("kind") == "file", _of_host(F.col("target"))).otherwise(F.col("target")))
    return used.withColumn("own_kinds", F.when(F.col("kind") == "file", source_kinds(F.col("target"))))


def _of_host(path: Column) -> Column:
    """A path with its host's number in front."""
    return F.concat(F.col(_NUMBER).cast("string"), F.lit("\0"), path)


def _tokens(events: DataFrame) -> Column:
    """Words of a command line that are paths of sources, as paths of the host."""
    words = carrier_tokens(F.col("cmdline"))
    return F.transform(words, _of_host) if _NUMBER in events.columns else words


def named_sources(events: DataFrame) -> DataFrame:
    """(pid, pos, path): the sources that command lines name, written: to cut command lines into words costs more than a round of a fixpoint."""
    return save(events.where("kind = 'exec'").select("pid", "pos", F.explode(_tokens(events)).alias("path")))


def first_taint(events: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, pos) from which a process is tainted, and (path, pos, stainer) from which a path that is no source is."""
    staged = events.where("kind = 'file' and size(own_kinds) = 0").select(F.col("pid").alias("toucher"), F.col("target").alias("file"), F.col("pos").alias("at"))
    execs = events.where("kind = 'exec'").select(F.col("pid").alias("child"), F.col("ppid").alias("parent"), F.col("pos").alias("at"))
    read = events.where("kind = 'file' and size(own_kinds) > 0").select("pid", "pos")
    argued = tokens.select("pid", "pos")
    no_path, no_pid = F.lit(None).cast("string").alias("path"), F.lit(None).cast("long")

    def grow(fresh: DataFrame) -> DataFrame:
        pids, paths = fresh.where("path is null").select("pid", "pos"), fresh.where("path is not null").select("path", "pos")
        born = execs.join(pids, F.col("parent") == F.col("pid")).where("pos < at").select(F.col("child").alias("pid"), no_path, F.col("at").alias("pos"), no_pid.alias("stainer"))
        adopted = staged.join(paths, F.col("file") == F.col("path")).where("pos < at").select(F.col("toucher").alias("pid"), no_path, F.col("at").alias("pos"), no_pid.alias("stainer"))
        stained = staged.join(pids, F.col("toucher") == F.col("pid")).where("pos < at").select(no_pid.alias("pid"), F.col("file").alias("path"), F.col("at").alias("pos"), F.col("toucher").alias("stainer"))
        return born.unionByName(adopted).unionByName(stained)

    reached = fixpoint(read.unionByName(argued).select("pid", no_path, "pos", no_pid.alias("stainer")), grow, ["pid", "path"])
    return reached.where("path is null").select("pid", "pos"), reached.where("path is not null").select("path", "pos", "stainer")


def taint_by_kind(events: DataFrame, paths: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pid, kind_rank, pos): from which position a process holds each kind."""
    files = events.where("kind = 'file'")
    sources = files.where("size(own_kinds) > 0").select("pid", F.col("target").alias("path"), F.col("pos").alias("at"))
    staged = files.where("size(own_kinds) = 0").select(F.col("pid").alias("toucher"), F.col("target").alias("path"), F.col("pos").alias("at"))
    execs = events.where("kind = 'exec'").select(F.col("pid").alias("child"), "ppid", F.col("pos").alias("at"))
    tokens = tokens.select(F.col("pid").alias("namer"), "path", F.col("pos").alias("at"))
    read = files.select("pid", F.explode("own_kinds").alias("kind_rank"), "pos")
    named = tokens.select(F.col("namer").alias("pid"), F.explode(source_kinds(F.col("path"))).alias("kind_rank"), F.col("at").alias("pos"))
    stainers = paths.select(F.col("stainer").alias("pid"), "path", F.col("pos").alias("stained"))

    def grow(fresh: DataFrame) -> DataFrame:
        born = execs.join(fresh, F.col("ppid") == F.col("pid")).where("pos < at").select(F.col("child").alias("pid"), "kind_rank", F.col("at").alias("pos"))
        frozen = stainers.join(fresh, "pid").where("pos < stained").select("path", "kind_rank", "stained")
        adopted = staged.join(frozen, "path").where("stained < at").select(F.col("toucher").alias("pid"), "kind_rank", F.col("at").alias("pos"))
        grown = sources.join(fresh, "pid").where("pos <= at").groupBy("path", "kind_rank").agg(F.min("at").alias("grown"))
        argued = tokens.join(grown, "path").where("grown < at").select(F.col("namer").alias("pid"), "kind_rank", F.col("at").alias("pos"))
        return born.unionByName(adopted).unionByName(argued)

    return fixpoint(read.unionByName(named), grow, ["pid", "kind_rank"])


def taint_flows(events: DataFrame, chains: DataFrame, exec_clears_taint: bool = False, carrier_cap: int | None = None) -> DataFrame:
    """Flows of events (pos, seq, pid, ppid, kind, target, cmdline, success): one per sink and kind, with
    `ord` (pos, kind_rank). With exec_clears_taint, a process that execs anew keeps only what it
    inherits or names: each span between execs is a process of its own. With carrier_cap, a host (all events, if
    they have no host) remembers so many tainted paths, and the one that came first goes when there is one more."""
    used = save(_relevant(events), "kind")  # by kind, as each round of a fixpoint reads one
    if exec_clears_taint:
        used, real = _by_exec(used)
    tokens = named_sources(used)
    pids, paths = first_taint(used, tokens)
    held = taint_by_kind(used, paths, tokens)

    # the path that last gave a process its label: its last file since it was tainted and since its last exec
    epoch = Window.partitionBy("pid").orderBy("pos")
    labelled = used.withColumn("execs", F.sum(F.when(F.col("kind") == "exec", 1).otherwise(0)).over(epoch)).join(pids.select(F.col("pid").alias("t_pid"), F.col("pos").alias("t_pos")), F.col("pid") == F.col("t_pid"), "left")
    since = Window.partitionBy("pid", "execs").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    touched = F.when((F.col("kind") == "file") & (F.col("pos") >= F.col("t_pos")), F.col("target"))
    labelled = labelled.withColumn("carrier", F.coalesce(F.last(touched, ignorenulls=True).over(since), F.lit("")))

    stage = used.where("kind = 'file' and size(own_kinds) = 0").where(is_archive(F.col("target")))
    wrote = stage.join(held.select("pid", "kind_rank", F.col("pos").alias("from")), "pid").where("from <= pos").withColumn("carrier", F.col("target")).withColumn("sink_kind", F.lit("archive-write"))

    sinks = labelled.where(F.col("kind").startswith("net-")).where(is_network_sink(F.col("target"))).select("pos", "seq", "pid", "ppid", "kind", "target", "carrier")
    own = sinks.join(held.select("pid", "kind_rank", F.col("pos").alias("from")), "pid").where("from < pos").drop("from")
    others = sinks.join(own.select("pos").distinct(), "pos", "left_anti")
    parent = others.join(held.select(F.col("pid").alias("parent"), "kind_rank", F.col("pos").alias("from")), F.col("ppid") == F.col("parent")).where("from < pos").drop("from", "parent")
    sent = own.select("pos", "seq", "pid", "kind", "target", "carrier", "kind_rank").unionByName(parent.select("pos", "seq", "pid", "kind", "target", "carrier", "kind_rank"))
    sent = sent.withColumn("sink_kind", F.when(F.col("kind") == "net-accept", "net-accept").otherwise("net-exfil"))

    # who first tainted a path: the first to touch or name a source, or who staged it
    first = used.where("kind = 'file' and size(own_kinds) > 0").select("pid", "pos", F.col("target").alias("path")).unionByName(tokens.select("pid", "pos", "path"))
    origins = first.groupBy("path").agg(F.min_by("pid", "pos").alias("origin")).unionByName(paths.select("path", F.col("stainer").alias("origin")))
    both = wrote.select("pos", "seq", "pid", "target", "carrier", "kind_rank", "sink_kind").unionByName(sent.select("pos", "seq", "pid", "target", "carrier", "kind_rank", "sink_kind"))
    both = both.join(origins, F.col("carrier") == F.col("path"), "left").withColumn("origin", F.coalesce("origin", "pid")).drop("path")
    if carrier_cap is not None:
        host = F.col(_NUMBER) if _NUMBER in events.columns else F.lit(0).cast("long")
        both = capped(used.withColumn("host", host), _tokens(used), both, pids, paths, carrier_cap)
    if exec_clears_taint:
        for c in ("pid", "origin"):
            both = both.join(real.select(F.col("node").alias(c), F.col("real_pid").alias(f"real_{c}")), c, "left").withColumn(c, F.col(f"real_{c}")).drop(f"real_{c}")
    shown = chains.select(F.col("pid").alias("chain_pid"), "chain")
    both = both.join(shown, F.col("pid") == F.col("chain_pid"), "left")
    bare = lambda path: F.substring_index(path, "\0", -1) if _NUMBER in events.columns else path
    return both.select(
        F.struct("pos", "kind_rank").alias("ord"),
        F.struct(taint_label(F.col("kind_rank")).alias("kind"), F.col("origin").alias("origin_pid"), bare(F.col("carrier")).alias("carrier")).alias("taint"),
        F.col("pid").alias("sink_pid"),
        F.col("origin").alias("origin_pid"),
        F.col("seq").alias("sink_seq"),
        "sink_kind",
        bare(F.col("target")).alias("sink_target"),
        F.coalesce("chain", F.concat(F.lit("?("), own_pid(F.col("pid")).cast("string"), F.lit(")"))).alias("chain"),
        bare(F.col("carrier")).alias("carrier"),
    )


def _by_exec(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a node per process and exec in place of pid, and of the parent's node at the time in place of ppid."""
    epoch = Window.partitionBy("pid").orderBy("pos")
    numbered = events.withColumn("execs", F.sum(F.when(F.col("kind") == "exec", 1).otherwise(0)).over(epoch))
    node = lambda pid, execs: F.xxhash64(pid, execs)
    # the parent's last exec before each event: both in one order, per process
    marks = numbered.where("kind = 'exec'").select(F.col("pid").alias("who"), "pos", F.col("execs").cast("long").alias("parent_execs"), F.lit(None).cast("long").alias("child_pos"))
    asks = numbered.select(F.col("ppid").alias("who"), "pos", F.lit(None).cast("long").alias("parent_execs"), F.col("pos").alias("child_pos"))
    upto = Window.partitionBy("who").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = marks.unionByName(asks).withColumn("parent_execs", F.coalesce(F.last("parent_execs", ignorenulls=True).over(upto), F.lit(0))).where("child_pos is not null").select(F.col("child_pos").alias("pos"), "parent_execs")
    joined = save(numbered.join(answered, "pos").withColumn("node", node("pid", F.col("execs").cast("long"))).withColumn("parent", node("ppid", "parent_execs")))
    return joined.drop("pid", "ppid", "execs", "parent_execs").withColumnsRenamed({"node": "pid", "parent": "ppid"}), joined.select("node", F.col("pid").alias("real_pid")).distinct()
