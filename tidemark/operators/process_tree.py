"""Process ancestry: parents by the last event of a process, and each process's path to its root.

A path follows at most 65 parents and stops at a process that is its own parent or whose parent is
not known. Paths grow by doubling: seven self-joins, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import basename
from tidemark.operators.hosts import own_pid

MOST_PARENTS = 65
_DOUBLINGS = 7


def build_tree(events: DataFrame) -> DataFrame:
    """(pid, ppid, exe, cmdline): the last parent, and the last program and command line that aren't empty."""
    last = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("pos"))).alias(c)
    return events.where(own_pid(F.col("pid")) != 0).groupBy("pid").agg(F.max_by("ppid", "pos").alias("ppid"), last("exe"), last("cmdline"))


def ancestor_paths(tree: DataFrame, save=None) -> DataFrame:
    """(pid, ancestors): parents from the nearest on, for every process of the tree. A process that is its own parent has none.
    With save, which writes a table and reads it back, each doubling is computed once and the last needed one ends the loop."""
    keep = save or (lambda df: df)
    paths = keep(tree.select("pid", F.when(F.col("ppid") == F.col("pid"), F.array().cast("array<bigint>")).otherwise(F.array("ppid")).alias("ancestors")))
    for step in range(_DOUBLINGS):
        if save and paths.where(F.size("ancestors") == 1 << step).isEmpty():
            break
        # only a path that is as long as it could be by now can go on
        further = paths.select(F.col("pid").alias("top"), F.col("ancestors").alias("more"))
        full = F.when(F.size("ancestors") == 1 << step, F.element_at("ancestors", -1))
        paths = paths.withColumn("end", F.when(F.size("ancestors") > 0, full)).join(further, F.col("end") == F.col("top"), "left")
        paths = keep(paths.select("pid", F.when(F.col("more").isNull(), F.col("ancestors")).otherwise(F.concat("ancestors", "more")).alias("ancestors")))
    return paths.withColumn("ancestors", F.slice("ancestors", 1, MOST_PARENTS))


def label(pid: Column, exe: Column) -> Column:
    return F.concat(F.coalesce(basename(exe), F.lit("?")), F.lit("("), own_pid(pid).cast("string"), F.lit(")"))


def chains(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(pid, root, chain_pids, chain): from the root down to the process, as pids and as one line."""
    nodes = paths.select("pid", F.posexplode(F.concat(F.array("pid"), "ancestors")).alias("hop", "node"))
    programs = tree.select(F.col("pid").alias("node_pid"), "exe")
    named = nodes.join(programs, F.col("node") == F.col("node_pid"), "left").select("pid", "hop", "node", label(F.col("node"), F.col("exe")).alias("shown"))
    down = F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("depth"), "node", "shown")))
    grouped = named.groupBy("pid").agg(down.alias("down"))
    return grouped.select("pid", F.col("down")[0]["node"].alias("root"), F.transform("down", lambda n: n["node"]).alias("chain_pids"), F.array_join(F.transform("down", lambda n: n["shown"]), " → ").alias("chain"))


def with_root(df: DataFrame, tree_chains: DataFrame, pid: str, name: str = "root") -> DataFrame:
    """Adds the root of a process; one that the tree doesn't know is its own."""
    roots = tree_chains.select(F.col("pid").alias("of_pid"), F.col("root").alias("of_root"))
    return df.join(roots, F.col(pid) == F.col("of_pid"), "left").withColumn(name, F.coalesce("of_root", F.col(pid))).drop("of_pid", "of_root")


def ancestry(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(ancestor, pid) pairs. Unlike in a path, a process that is its own parent is its own ancestor."""
    own = tree.where("pid = ppid").select(F.col("pid").alias("ancestor"), "pid")
    up = paths.select(F.explode("ancestors").alias("ancestor"), "pid")
    return up.unionByName(own).distinct()
