"""Correlation: findings and flows of one process tree become an incident with its graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.hosts import own_pid, own_pids
from tidemark.operators.process_tree import with_root
from tidemark.schemas import CRITICAL, HIGH, INFO, LOW

_EDGE = "array<struct<from_pid:bigint,to_pid:bigint,label:string,rank:int>>"


def finding_buckets(found: DataFrame, chains: DataFrame) -> DataFrame:
    """Findings by root: counts, the first title, the primary process (most severe, last on ties)."""
    return with_root(found, chains, "pid").groupBy("root").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.max("severity").alias("top"),
        F.min_by("title", "ord").alias("first_title"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule_id"))), lambda x: x["rule_id"]).alias("findings"),
        F.max_by("pid", F.struct("severity", "ord")).alias("primary_finding"),
        F.min("seq").alias("f_from"),
        F.max("seq").alias("f_to"),
        F.collect_set("pid").alias("f_pids"),
    )


def flow_buckets(flows: DataFrame, chains: DataFrame) -> DataFrame:
    """Flows by the root of their sink."""
    edge = F.struct(F.when(own_pid(F.col("origin_pid")) == 0, F.col("sink_pid")).otherwise(F.col("origin_pid")).alias("from_pid"), F.col("sink_pid").alias("to_pid"), F.col("sink_target").alias("label"), F.lit(1).alias("rank"))
    return with_root(flows, chains, "sink_pid").groupBy("root").agg(
        F.min_by("sink_pid", "ord").alias("primary_sink"),
        F.min("sink_seq").alias("t_from"),
        F.max("sink_seq").alias("t_to"),
        F.array_union(F.collect_set("sink_pid"), F.collect_set("origin_pid")).alias("t_pids"),
        F.array_sort(F.collect_set("taint.kind")).alias("taints"),
        F.array_sort(F.collect_set(F.when(F.col("carrier") != "", F.col("carrier")))).alias("carriers"),
        F.collect_set(edge).alias("flow_edges"),
    )


def fork_edges(actors: DataFrame, chains: DataFrame) -> DataFrame:
    """actors (root, actor) -> per root, an edge from each actor's nearest ancestor that is an actor too."""
    up = actors.join(chains.select("pid", "chain_pids"), F.col("actor") == F.col("pid")).select("root", "actor", F.posexplode(F.slice(F.reverse("chain_pids"), 2, 66)).alias("hop", "above"))
    meet = up.join(actors.withColumnRenamed("actor", "above"), ["root", "above"])
    nearest = meet.groupBy("root", "actor").agg(F.min_by("above", "hop").alias("above"))
    edge = F.struct(F.col("above").alias("from_pid"), F.col("actor").alias("to_pid"), F.lit("").alias("label"), F.lit(0).alias("rank"))
    return nearest.groupBy("root").agg(F.collect_set(edge).alias("fork_edges"))


def correlate(found: DataFrame, flows: DataFrame, chains: DataFrame) -> DataFrame:
    """Incidents with their root (a number over all hosts; other pids are a host's own), most severe first: severity is a rank, edges are sorted and distinct."""
    both = finding_buckets(found, chains).join(flow_buckets(flows, chains), "root", "full")
    n, top, tainted = F.coalesce("n_findings", F.lit(0)), F.coalesce("top", F.lit(INFO)), F.col("primary_sink").isNotNull()
    both = both.where(~((n == 1) & ~tainted & (top <= LOW)))
    severity = F.when(tainted, F.least(F.greatest(top, F.lit(HIGH)) + 1, F.lit(CRITICAL))).when(n > 1, F.least(top + 1, F.lit(CRITICAL))).otherwise(top)
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    both = both.withColumn("severity", severity.cast("int")).withColumn("actors", F.array_sort(F.array_union(empty("f_pids", "array<bigint>"), empty("t_pids", "array<bigint>"))))
    both = both.withColumn("taints", empty("taints", "array<string>")).withColumn("carriers", empty("carriers", "array<string>")).withColumn("findings", empty("findings", "array<string>"))
    both = both.withColumn("seq_from", F.least("f_from", "t_from")).withColumn("seq_to", F.greatest("f_to", "t_to")).withColumn("primary", F.coalesce("primary_finding", "primary_sink"))
    title = (
        F.when(tainted, F.concat(F.lit("Data theft chain: "), F.coalesce("first_title", F.lit("Sensitive data")), F.lit(" → exfiltration of "), F.array_join("taints", " + ")))
        .when(n > 1, F.concat(F.lit("Suspicious activity chain: "), F.col("first_title"), F.lit(" + "), (n - 1).cast("string"), F.lit(" more signal(s)"))).otherwise(F.coalesce("first_title", F.lit("Finding")))
    )
    via = F.when(F.size("carriers") > 0, F.concat(F.lit(" via "), F.array_join("carriers", ", "))).otherwise("")
    confirmed = F.when(tainted, F.concat(F.lit("taint flows confirmed: "), F.array_join("taints", ", "), via)).otherwise("no taint confirmation")
    signals = F.when(n == 0, "none (taint-only)").otherwise(F.array_join("findings", ", "))
    summary = F.concat(
        F.lit("actor(s) ["), F.array_join(own_pids(F.col("actors")).cast("array<string>"), ", "), F.lit("]; evidence seq "), F.col("seq_from").cast("string"), F.lit("–"), F.col("seq_to").cast("string"),
        F.lit("; signals: "), signals, F.lit("; "), confirmed,
    )
    both = both.withColumn("title", title).withColumn("summary", summary)
    forks = fork_edges(both.select("root", F.explode("actors").alias("actor")), chains)
    both = both.join(forks, "root", "left").join(chains.select(F.col("pid").alias("primary"), "chain"), "primary", "left")
    edges = F.array_sort(F.array_union(empty("fork_edges", _EDGE), empty("flow_edges", _EDGE)))
    named = F.transform(edges, lambda e: F.struct(own_pid(e["from_pid"]).alias("from_pid"), own_pid(e["to_pid"]).alias("to_pid"), e["label"].alias("label"), F.when(e["rank"] == 0, "fork").otherwise("flow").alias("edge_kind")))
    unknown = F.concat(F.lit("?("), own_pid(F.col("primary")).cast("string"), F.lit(")"))
    return both.select("root", "title", "severity", own_pids(F.col("actors")).alias("actors"), F.coalesce("chain", unknown).alias("chain"), "findings", "taints", "carriers", "seq_from", "seq_to", "summary", named.alias("edges")).orderBy(F.desc("severity"), "root")


def at_least(incidents: DataFrame, severity: int) -> DataFrame:
    return incidents.where(F.col("severity") >= severity)


def graph_layers(incidents: DataFrame) -> DataFrame:
    """(root, depth, pids): actors by their number of fork edges from the top, 65 at most."""
    forks = incidents.select("root", F.explode("edges").alias("e")).where("e.edge_kind = 'fork'").groupBy("root", F.col("e.to_pid").alias("child")).agg(F.max("e.from_pid").alias("parent"))
    # an incident's forks are few: its own list of parents is walked inside the row
    maps = forks.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("child", "parent"))).alias("up"))
    rows = incidents.join(maps, "root", "left").select("root", F.explode("actors").alias("actor"), F.coalesce("up", F.create_map().cast("map<bigint,bigint>")).alias("up"))
    start = F.struct(F.col("actor").alias("node"), F.lit(0).alias("depth"))
    step = lambda acc, _: F.when(F.map_contains_key("up", acc["node"]), F.struct(F.try_element_at(F.col("up"), acc["node"]).alias("node"), (acc["depth"] + 1).alias("depth"))).otherwise(acc)
    walked = rows.withColumn("depth", F.aggregate(F.sequence(F.lit(1), F.lit(65)), start, step)["depth"])
    return walked.groupBy("root", "depth").agg(F.array_sort(F.collect_list("actor")).alias("pids"))


def cross_hops(incidents: DataFrame, tree: DataFrame, paths: DataFrame, strict: bool = False, chains: DataFrame | None = None) -> DataFrame:
    """Flow edges whose source is no ancestor of the sink; with strict, only those between different roots."""
    flows = incidents.select("root", F.explode("edges").alias("e")).where("e.edge_kind = 'flow'").select("root", "e.from_pid", "e.to_pid", "e.label")
    on_host = lambda pid: F.col("root") - own_pid(F.col("root")) + pid
    if strict:
        both = flows.withColumns({"source": on_host(F.col("from_pid")), "sink": on_host(F.col("to_pid"))})
        far = with_root(with_root(both, chains, "source", "from_root"), chains, "sink", "to_root")
        return far.where("from_root <> to_root").select("root", "from_pid", "to_pid", "label")
    # the ancestors of a sink are a list of bounded length beside it: no pair of processes is written anywhere
    above = paths.join(tree.select("pid", "ppid"), "pid").select(F.col("pid").alias("of_pid"), "ancestors", (F.col("pid") == F.col("ppid")).alias("own_parent"))
    asked = flows.withColumn("sink", on_host(F.col("to_pid"))).join(above, F.col("sink") == F.col("of_pid"), "left")
    source = on_host(F.col("from_pid"))
    related = F.array_contains("ancestors", source) | (F.col("own_parent") & (source == F.col("sink")))
    return asked.where(~F.coalesce(related, F.lit(False))).select("root", "from_pid", "to_pid", "label")


def numbered(incidents: DataFrame) -> DataFrame:
    """Adds incident_no, 1 for the most severe. Incidents are few: one per process tree that has one."""
    return incidents.withColumn("incident_no", F.row_number().over(Window.orderBy(F.desc("severity"), "root")))
