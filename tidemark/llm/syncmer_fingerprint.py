"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's symbols are cut at content-defined places: between white space, behind each character of
`CUT`, and around each character of scripts that write without spaces (from U+0900 on). A k-mer of
symbols is an anchor if the smallest hash of its inner s-mers is that of its first or its last one.
That depends on the k-mer alone, so a passage keeps its anchors wherever it stands, in texts with
and without spaces. Marks before the first and behind the last symbol belong to the k-mers there, and
the first k-mer, with the marks, is always an anchor: so every text that is not empty has one, and short texts are
treated as long ones are. A fingerprint is the `SIZE` anchors of the smallest hashes, with their places, as
"hash:place" words.

The likeness of two fingerprints is the Dice coefficient estimated from the smallest hashes of
both, where an anchor counts as shared if its places differ by what the median of all shared
anchors does, give or take `SLACK`. Two empty texts are alike (1); an empty one is like no other (0).
A text of white space alone is one symbol. In other scripts a long run without spaces and without a
character of `CUT` is one symbol, too.

The next document in descending doc_id order is found without a global sort: documents are dealt
into buckets of neighbouring ids between quantiles, a window orders each, and every bucket gets one
extra row, the first of the next bucket that has rows; these are found among `WIDE` buckets at a time. A null
text is empty. Null doc_ids come last; rows of one doc_id follow each other by text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize

#: Symbols of a k-mer and of its inner s-mers.
K, S = 6, 2
#: Characters that end a symbol: some one in ten of letters, of base 64 and of digits.
CUT = "oOkKvV5/=\u043e\u041e\u043a\u041a\u0432\u0412\u03bf\u039f\u03ba\u039a\u03bd\u039d\u05d5\u05e7\u0627\u0643\u0648"
_ALONE = r"\u0900-\x{10FFFF}"
SYMBOL = rf"[^\x20\x09-\x0D{CUT}{_ALONE}]++[{CUT}]?|[{CUT}]|[{_ALONE}]"
SIZE = 48
SLACK = 32
#: Rows of a bucket, about, and quantiles that bound the buckets; within a pair of quantiles they are of equal width.
BUCKET_ROWS, QUANTILES = 64, 64
#: Buckets whose tops are ordered together.
WIDE = 4096
_MASK = (1 << 40) - 1
_ANCHORS = "array<struct<h:bigint,place:int>>"


def let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def anchors_sql(text: str) -> str:
    """The closed syncmers of a text, as structs of hash and place (symbols from 0). The s-mers of a
    k-mer at i are those at i to i + K - S; an anchor's hash covers its symbols once each."""
    last = K - S
    found = f"regexp_extract_all({text}, r'{SYMBOL}', 0)"
    marked = let("v", found, f"if(size(v) = 0 and {text} = '', v, concat(array('\x02', '\x02', '\x02'), if(size(v) = 0, array({text}), v), array('\x03', '\x03')))")
    inner = f"if(size(w) >= {S}, transform(sequence(0, size(w) - {S}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(S))})), cast(array() as array<bigint>))"
    edge = f"i = 0 or least(m[i], m[i + {last}]) <= least({', '.join(f'm[i + {j}]' for j in range(1, last))})"
    whole = ", ".join(f"m[i + {j}]" for j in range(0, K, S))
    chosen = f"transform(filter(sequence(0, size(m) - {last + 1}), i -> {edge}), i -> named_struct('h', xxhash64({whole}) & {_MASK}L, 'place', i))"
    return let("w", marked, let("m", inner, f"if(size(m) > {last}, {chosen}, cast(array() as {_ANCHORS}))"))


def smallest_sql(anchors: str, size: int = SIZE) -> str:
    """The anchors of the smallest distinct hashes."""
    return let("a", f"array_sort({anchors})", f"slice(filter(a, (x, i) -> i = 0 or a[i - 1].h <> x.h), 1, {size})")


def sketch_sql(text: str, size: int = SIZE) -> str:
    return smallest_sql(anchors_sql(text), size)


def spelled_sql(sketch: str) -> str:
    return f"array_join(transform({sketch}, x -> concat(lower(hex(x.h)), ':', x.place)), ' ')"


def likeness_sql(a: str, b: str, size: int = SIZE) -> str:
    """0 to 1, from two sketches."""
    union = f"slice(array_sort(array_union({a}.h, {b}.h)), 1, {size})"
    common = f"array_intersect(u, array_intersect({a}.h, {b}.h))"
    shifts = f"zip_with(filter({a}, x -> array_contains(c, x.h)).place, filter({b}, x -> array_contains(c, x.h)).place, (x, y) -> y - x)"
    steady = let("d", f"array_sort({shifts})", f"size(filter(d, x -> abs(x - d[cast(size(d) div 2 as int)]) <= {SLACK}))")
    share = let("u", union, let("j", f"{let('c', common, f'if(size(c) = 0, 0, {steady})')} / size(u)", "2 * j / (1 + j)"))
    return f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D else cast({share} as double) end"


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = rows.withColumn("sketch", F.expr(sketch_sql("text", size)))
    return sketched.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.expr(spelled_sql("sketch")).alias("fingerprint"))


def with_bucket(docs: DataFrame) -> DataFrame:
    """Adds bucket: whole runs of neighbouring ids, in order. Null ids are in the lowest."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first()
    bounds = sorted(set(ids["q"] or [0]))
    parts = max(1, -(-ids["n"] // (BUCKET_ROWS * max(1, len(bounds) - 1))))
    literal = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    at = f"greatest(size(filter({literal}, x -> x <= doc_id)), 1)"
    low, high = f"element_at({literal}, q)", f"element_at({literal}, least(q + 1, {len(bounds)}))"
    place = f"cast(least(floor((doc_id - {low}) / greatest({high} - {low}, 1) * {parts}), {parts - 1}) as bigint)"
    return docs.withColumn("bucket", F.coalesce(F.expr(let("q", at, f"q * {parts}L + greatest({place}, 0L)")), F.lit(0).cast("long")))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the same rows and one extra per bucket (extra is true), ready for windows in bucket
    order: the row that follows the bucket's last one in descending doc_id order, or the first of all."""
    dealt = with_bucket(docs)
    tops = materialize(dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).withColumn("wide", F.floor(F.col("bucket") / WIDE)))
    # of each run of WIDE buckets the highest one's top; a row per run meets in one window
    runs = tops.groupBy("wide").agg(F.max_by("top", "bucket").alias("run_top"))
    after = Window.orderBy(F.desc("wide"))
    first = F.first("run_top").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.select("wide", F.lead("run_top").over(after).alias("below"), F.lead(F.lit(True)).over(after).alias("has_below"), first.alias("first"))
    within = Window.partitionBy("wide").orderBy(F.desc("bucket"))
    heads = tops.withColumn("lead_top", F.lead("top").over(within)).withColumn("has_lead", F.lead(F.lit(True)).over(within)).join(runs, "wide")
    next_top = F.when(F.col("has_lead"), F.col("lead_top")).when(F.col("has_below"), F.col("below")).otherwise(F.col("first"))
    heads = materialize(heads.select(F.col("bucket").alias("for_bucket"), next_top.alias("next_top")))
    extra = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("next_top"))).select("doc_id", "text", F.col("for_bucket").alias("bucket"), F.lit(True).alias("extra"))
    return dealt.select("doc_id", "text", "bucket", F.lit(False).alias("extra")).unionByName(extra)


def op2_syncmer_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    rows = with_next(docs).withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("sketch", F.expr(sketch_sql("text")))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where("not extra")
    rows = rows.withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 3), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    rows = rows.withColumn("edited_sketch", F.expr(sketch_sql("edited")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(spelled_sql("sketch")).alias("fingerprint"),
        F.expr(spelled_sql("edited_sketch")).alias("edited_fingerprint"),
        F.expr(likeness_sql("sketch", "edited_sketch")).alias("near_edited"),
        F.expr(likeness_sql("sketch", "next_sketch")).alias("near_next"),
    )
