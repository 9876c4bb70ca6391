"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its share by weight of all words, but at most `most`
times its own; what is above is shared again by weight. A source at ratio r of target to size takes
floor(r) whole copies of every document, and the words that are missing then as a sample of fixed
size with unequal probabilities: a document's inclusion probability p is proportional to its size,
p = c * size, where c is such that the expected words are the missing ones; documents for which that
is above 1 are certain. With u uniform for each document, documents are ranked by the random odds
u / (1 - u) divided by the inclusion odds p / (1 - p), and the first ones are taken up to the missing
words. u is a hash of the row and a seed, so reruns agree.

c comes from sums by size class, some 16 an octave. The prefix in Pareto order is found without
sorting a source: words are summed by bucket of the logarithm of the rank, a running sum over a bounded
number of buckets finds the one where the sample ends, and only that bucket's documents are ordered.
Sources' tables stay tables, however many there are; they are broadcast where they are few.

A null text has no words. A null source is a source, the last one. Repeated rows are documents of
their own; rows that are equal are told apart by nothing, so they are taken or left by position in
the ordered bucket. Extra columns stay as they are in the stage and are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Buckets of the logarithm of the Pareto rank, over -REACH to REACH; the densest has some 0.04 % of a source.
BUCKETS, REACH = 1 << 16, 48
#: Size classes an octave.
CLASSES = 16
#: Certain documents have odds of this probability.
CERTAIN = 1 - 1e-6
#: Sources of which a table of a row each is broadcast; with more it is joined.
FEW_SOURCES = 10_000


def n_words(column: str):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _by_source(rows: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has one row per source (named of_source)."""
    return rows.join(F.broadcast(table) if few else table, rows["source"].eqNullSafe(table["of_source"]), how).drop("of_source")


def source_targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size), one row per source -> the same, target. Sources are numbered in order by range
    partition, and the level to which weights are filled is found by a few sums; a row per partition and a row per sum reach the driver."""
    dealt = materialize(totals.repartitionByRange(32, F.asc_nulls_last("source")).select("source", "source_size", F.spark_partition_id().alias("part")))
    before, n = {}, 0
    for r in sorted(dealt.groupBy("part").count().collect()):
        before[r["part"]], n = n, n + r["count"]
    start = F.coalesce(*[F.when(F.col("part") == p, k) for p, k in before.items()], F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + start
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    weighed = materialize(dealt.select("source", "source_size", weight.alias("weight")))
    level, full = 0.0, -1
    while True:
        # sources that the level fills beyond `most` times their size take that much
        over = F.col("weight") * level > most * F.col("source_size")
        sums = weighed.agg(F.sum("source_size"), F.sum(F.when(over, most * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
        if sums[0] is None or sums[3] == full:
            break
        full, level = sums[3], (sums[0] - sums[1]) / sums[2]
    target = F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def _size_class(size: str):
    return F.floor(F.log2(F.greatest(F.col(size), F.lit(1))) * CLASSES).cast("int")


def inclusion(sized: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """goal with top_class and scale: p is 1 above top_class and scale * size up to it."""
    classes = sized.where("size > 0").groupBy("source", _size_class("size").alias("class")).agg(F.sum("size").alias("s1"), F.sum(F.pow("size", F.lit(2))).alias("s2"), F.max("size").alias("hi"))
    upto = Window.partitionBy("source").orderBy("class")
    classes = classes.withColumn("words", F.sum("s1").over(upto)).withColumn("squares", F.sum("s2").over(upto))
    classes = _by_source(classes, goal.withColumnRenamed("source", "of_source"), few)
    scale = F.greatest(F.col("missing") - (F.col("source_size") - F.col("words")), F.lit(0.0)) / F.col("squares")
    best = F.max(F.when(F.col("scale") * F.col("hi") <= 1, F.struct("class", "scale")))
    found = classes.withColumn("scale", scale).groupBy("source").agg(best.alias("best")).select(F.col("source").alias("of_source"), F.col("best.class").alias("top_class"), F.col("best.scale").alias("scale"))
    return _by_source(goal, found, few, "left")


def _ranked(sized: DataFrame, goal: DataFrame, few: bool, seed: int) -> DataFrame:
    """Each document with its goal, inclusion probability p, Pareto rank (as a logarithm) and bucket."""
    rows = _by_source(sized, goal.withColumnRenamed("source", "of_source"), few)
    u = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.when(_size_class("size") > F.coalesce("top_class", F.lit(-1)), CERTAIN).otherwise(F.col("scale") * F.col("size"))
    rows = rows.withColumn("u", u).withColumn("p", F.greatest(F.least(p, F.lit(CERTAIN)), F.lit(1 - CERTAIN)))
    rows = rows.withColumn("pareto", F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p"))))
    place = F.floor((F.col("pareto") + REACH) * (BUCKETS / (2 * REACH)))
    return rows.withColumn("bucket", F.greatest(F.least(place, F.lit(BUCKETS - 1)), F.lit(0)).cast("int"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken, copies, p; with carry also mix_row: the row as it is."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64("text").alias("text_hash")]
    sized = materialize(docs.select(keys))
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = totals.count() <= FEW_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = source_targets(totals, weights, most).withColumn("whole", F.floor(ratio + 1e-12))
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    goal = materialize(goal.withColumn("missing", F.when(missing > 1e-9 * F.col("source_size"), missing).otherwise(0.0)))
    goal = materialize(inclusion(sized, goal, few))

    ranked = _ranked(sized, goal, few, seed)
    ends = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    ends = ends.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    # the first bucket whose end passes the missing words; all before are taken, none after
    cut = ends.where("missing > 0 and upto >= missing").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cut = cut.select(F.col("source").alias("of_source"), F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before"))
    goal = materialize(_by_source(goal, cut, few, "left"))

    def final(rows: DataFrame, *more: str) -> DataFrame:
        copies = F.col("whole") + F.col("extra")
        return rows.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "p", *more)

    inside = F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False))
    whole_bucket = F.when(F.col("missing") > 0, F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(True)).cast("long")).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy("source", "bucket").orderBy("pareto", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = _ranked(sized, goal, few, seed).where(inside).withColumn("upto", F.col("before") + F.sum("size").over(order))
    part = part.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("missing")).cast("long"))
    if not carry:
        return final(_ranked(sized, goal, few, seed).where(~inside).withColumn("extra", whole_bucket)).unionByName(final(part))
    # with whole rows, only those of the cut buckets meet their decision in a shuffle
    rows = _ranked(docs.select(*keys, F.struct("*").alias("mix_row")), goal, few, seed)
    part = materialize(part.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("source").alias("of_source")).agg(F.sum("extra").alias("given"), F.count(F.lit(1)).alias("equal")))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")) & F.col("source").eqNullSafe(F.col("of_source"))
    alike, parted = (part.where(test) for test in ("given = 0 or given = equal", "given > 0 and given < equal"))
    out = final(rows.where(~inside).withColumn("extra", whole_bucket), "mix_row")
    out = out.unionByName(final(rows.where(inside).join(alike, same).withColumn("extra", F.least("given", F.lit(1))), "mix_row"))
    if parted.isEmpty():
        return out
    return out.unionByName(final(_first_of_equal(rows.where(inside).join(parted, same)), "mix_row"))


def _first_of_equal(rows: DataFrame) -> DataFrame:
    """Rows of which `given` among `equal` ones get an extra copy: equal rows stand together in the order, so each source has one such
    group at most, however large. Its rows are numbered by their place in a written table's parts, and those of the parts before."""
    rows = materialize(rows.withColumn("row_at", F.monotonically_increasing_id()).withColumn("row_part", F.shiftright("row_at", 33)))
    counts = rows.groupBy("source", "row_part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("source").orderBy("row_part")) - F.col("rows")
    counts = counts.select(F.col("source").alias("in_source"), F.col("row_part").alias("in_part"), before.alias("rows_before"))
    nth = F.row_number().over(Window.partitionBy("source", "row_part").orderBy("row_at")) + F.col("rows_before")
    joined = rows.join(counts, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("row_part") == F.col("in_part")))
    return joined.withColumn("extra", (nth <= F.col("given")).cast("long"))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those of no words, which a mix by words cannot weigh, stay once."""
    mixed = mix_sources(docs, carry=True)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    out = mixed.select("mix_row", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return out.select("mix_row.*")
