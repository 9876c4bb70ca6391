"""Smallest fixpoints over tables, with semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.storage import save


def fixpoint(start: DataFrame, grow, keys: list[str]) -> DataFrame:
    """The smallest fixpoint over rows (keys, pos, and what else is in start): the earliest row of each key that
    start or grow gives. grow(fresh) derives rows from those that were new in the last round; a round
    writes one table, and every eighth joins what is known into one."""
    earliest = lambda df: df.groupBy(*keys).agg(F.min(F.struct("pos", *[c for c in df.columns if c not in (*keys, "pos")])).alias("row")).select(*keys, "row.*")
    fresh = known = save(earliest(start))
    rounds = 0
    while True:
        old = known.groupBy(*[F.col(k).alias(f"old_{k}") for k in keys]).agg(F.min("pos").alias("old_pos"))
        match = [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys]
        found = earliest(grow(fresh).select(start.columns))
        fresh = save(found.join(old, match, "left").where("old_pos is null or pos < old_pos").select(start.columns))
        if fresh.isEmpty():
            return save(earliest(known))
        known, rounds = known.unionByName(fresh), rounds + 1
        if rounds % 8 == 0:
            known = save(earliest(known))
