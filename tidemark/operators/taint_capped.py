"""Taint with a cap on carriers, exactly, for what the cap changes; all else stays relational.

Carriers are evicted in order of arrival: the n-th arrival of a host goes with arrival n + cap. Without any eviction each
path arrives once, when it is first stained, so its rank and its eviction follow from counting, and a host with no more
paths than the cap needs nothing else. An eviction changes something only where its path is touched later. All that
hangs together with such a path through tainted processes and files is folded anew, in order, with the arrivals of all
other paths between its events, as these move the queue. The fold's arrivals move other evictions; if one of these is
now followed by a touch too, its part joins in and the fold is done again, until there is none. What is then left out of
the fold has no touch behind an eviction, so that the relational result holds for it, and the fold has seen every arrival.

The fold runs in one task per host, over rows that Spark sorts and streams to it: the task holds no more than the cap's paths and
the processes of the changed parts. Whether a process or path is tainted at all is bounded by the uncapped fixpoint,
so only events that touch taint there are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fixpoint import fixpoint
from tidemark.operators.ordering import number_in_order
from tidemark.operators.storage import save
from tidemark.operators.taint_fold import TaintState

_FOLDED = "host long, pos long, sub int, seq long, pid long, target string, carrier string, kind_rank int, sink_kind string, origin long"


@dataclass
class _Watched(TaintState):
    """Tells which paths have arrived."""

    arrived: list[str] = field(default_factory=list)

    def stain(self, path: str, kinds: set[int], pid: int) -> None:
        if path not in self.carriers:
            self.arrived.append(path)
        super().stain(path, kinds, pid)


def _fold(cap: int):
    """Events and arrivals of other paths ('tick'), sorted by host and place -> flows, and arrivals as rows without a sink."""

    def run(batches):
        host, state = None, _Watched(cap)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.host != host:
                    host, state = r.host, _Watched(cap)
                target = r.target.rpartition("\0")[2] if r.kind in ("file", "tick") else r.target
                if r.kind == "tick":
                    state.stain(target, set(), 0)
                    state.arrived.clear()
                    continue
                flows = state.step(r.pid, r.ppid, r.kind, target, r.cmdline)
                out += [(host, r.pos, i, r.seq, r.pid, None, None, None, None, None) for i in range(len(state.arrived))]
                state.arrived.clear()
                out += [(host, r.pos, None, r.seq, r.pid, target, carrier, rank, sink, origin) for rank, sink, carrier, origin in flows]
            frame = pd.DataFrame(out, columns=["host", "pos", "sub", "seq", "pid", "target", "carrier", "kind_rank", "sink_kind", "origin"])
            yield frame.astype({"host": "int64", "pos": "int64", "sub": "Int32", "seq": "int64", "pid": "int64", "kind_rank": "Int32", "origin": "Int64"})

    return run


def _touching(used: DataFrame, pids: DataFrame, paths: DataFrame) -> DataFrame:
    """Events that can touch taint, with `inherits`: whether the parent is tainted by then."""
    own = pids.select(F.col("pid").alias("own_pid"), F.col("pos").alias("own_pos"))
    above = pids.select(F.col("pid").alias("above_pid"), F.col("pos").alias("above_pos"))
    stained = paths.select(F.col("path").alias("of_path"), F.col("pos").alias("path_pos"))
    joined = used.join(own, F.col("pid") == F.col("own_pid"), "left").join(above, F.col("ppid") == F.col("above_pid"), "left")
    joined = joined.join(stained, (F.col("kind") == "file") & (F.col("target") == F.col("of_path")), "left")
    by = lambda c: F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
    joined = joined.withColumn("inherits", (F.col("kind") != "file") & by("above_pos"))
    names = (F.col("kind") == "exec") & (F.size("tokens") > 0)
    source = (F.col("kind") == "file") & (F.size("own_kinds") > 0)
    return joined.where(by("own_pos") | by("path_pos") | F.col("inherits") | names | source).select("host", "pos", "seq", "pid", "ppid", "kind", "target", "cmdline", "own_kinds", "tokens", "inherits")


def _connected(start: DataFrame, by_path: DataFrame, by_parent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pids, paths) that hang together with the paths of start."""
    none_pid, none_path, at = F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("pos")

    def grow(fresh: DataFrame) -> DataFrame:
        new_pids, new_paths = fresh.where("path is null").select("pid"), fresh.where("path is not null").select("path")
        users = by_path.join(new_paths, "path", "left_semi").select("pid", none_path, at)
        used = by_path.join(new_pids, "pid", "left_semi").select(none_pid, "path", at)
        kin = by_parent.join(new_pids, "pid", "left_semi").select("other", none_path, at).withColumnRenamed("other", "pid")
        return users.unionByName(used).unionByName(kin)

    reached = fixpoint(start.select(none_pid, "path", at), grow, ["pid", "path"])
    return reached.where("path is null").select("pid"), reached.where("path is not null").select("path")


def capped(used: DataFrame, tokens: Column, flows: DataFrame, pids: DataFrame, paths: DataFrame, cap: int) -> DataFrame:
    """flows (pos, seq, pid, target, carrier, kind_rank, sink_kind, origin) of used events (with host) as they are when a host
    keeps `cap` carriers; pids and paths say since when what is tainted without a cap. cap is 1 at least."""
    if cap < 1:
        raise ValueError("a carrier cap is 1 at least")
    numbered = used.withColumn("tokens", F.when(F.col("kind") == "exec", tokens))
    live = save(_touching(numbered, pids, paths))
    place = lambda sub: F.struct("pos", F.lit(sub).cast("int").alias("sub") if isinstance(sub, int) else sub).alias("place")
    named = live.where("kind = 'exec'").select("host", "pid", "pos", F.posexplode("tokens").alias("sub", "path")).select("host", "pid", "path", place(F.col("sub")))
    touches = save(live.where("kind = 'file'").select("host", "pid", F.col("target").alias("path"), place(0)).unionByName(named))
    # a path that is no source arrives when a tainted process stains it, a source path with its first touch
    stained = touches.join(paths.select("path", F.col("pos").alias("stained")), "path", "left")
    first = save(stained.where("stained is null or place.pos = stained").groupBy("host", "path").agg(F.min("place").alias("place")))
    if first.groupBy("host").count().where(F.col("count") > cap).isEmpty():
        return flows

    by_path = save(touches.select("pid", "path").distinct())
    kin = live.where("inherits").select("pid", F.col("ppid").alias("other"))
    by_parent = save(kin.unionByName(kin.select(F.col("other").alias("pid"), F.col("pid").alias("other"))).distinct())
    folded = changed_pids = changed_paths = None
    arrivals = first.select("host", "place", "path")
    while True:
        order = save(number_in_order(save(arrivals), ["host", "place"], "n"))
        later = order.select(F.col("host").alias("of_host"), (F.col("n") - cap).alias("of_n"), F.col("place").alias("gone"))
        # only paths outside the fold: those inside have no path here
        gone = save(order.where("path is not null").join(later, (F.col("n") == F.col("of_n")) & (F.col("host") == F.col("of_host"))).select("path", "gone"))
        again = save(touches.join(gone, "path").where("place > gone").select("path").distinct())
        if again.isEmpty():
            break
        start = again if changed_paths is None else again.unionByName(changed_paths)
        changed_pids, changed_paths = _connected(start, by_path, by_parent)
        inside = live.join(changed_pids, "pid", "left_semi").select("host", "pos", F.lit(0).alias("sub"), "seq", "pid", *[F.coalesce(c, F.lit(other)).alias(c) for c, other in (("ppid", -1), ("kind", ""), ("target", ""), ("cmdline", ""))])
        others = first.join(changed_paths, "path", "left_anti")
        no = F.lit(0).cast("long")
        ticks = others.join(inside.select("host").distinct(), "host", "left_semi").select("host", "place.pos", "place.sub", no.alias("seq"), no.alias("pid"), no.alias("ppid"), F.lit("tick").alias("kind"), F.col("path").alias("target"), F.lit("").alias("cmdline"))
        rows = inside.unionByName(ticks).repartition("host").sortWithinPartitions("host", "pos", "sub")
        folded = save(rows.mapInPandas(_fold(cap), _FOLDED))
        arrivals = others.select("host", "place", "path").unionByName(folded.where("sink_kind is null").select("host", F.struct("pos", "sub").alias("place"), F.lit(None).cast("string").alias("path")))

    kept = flows if folded is None else flows.join(changed_pids, "pid", "left_anti")
    # who first tainted a path is forgotten with it
    left = kept.join(gone.select(F.col("path").alias("gone_path"), F.col("gone.pos").alias("gone_pos")), F.col("carrier") == F.col("gone_path"), "left")
    left = left.withColumn("origin", F.when(F.col("gone_pos") < F.col("pos"), F.col("pid")).otherwise(F.col("origin"))).select(flows.columns)
    return left if folded is None else left.unionByName(folded.where("sink_kind is not null").select(flows.columns))
