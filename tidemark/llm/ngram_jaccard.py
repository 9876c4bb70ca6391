"""N-gram Jaccard join by a token-group matrix.

Every distinct shingle set joins one small group of similar sets. The matrix stores, per shingle,
the groups whose token union holds it. A set can only reach the threshold with a member of a group
if it shares enough shingles with the group's union, so a group is opened for a query set only
where that bound allows it; inside, intersections are counted exactly.

* Sets that are equal collapse to one class first, so copies cost nothing further.
* Groups come from min-hash keys and are cut to a bounded number of shingles, so no family of near
  copies, however large, meets in one task; a large family becomes many groups, compared two at a
  time.
* The matrix holds a set's *prefix* only: its n - ceil(t n) + m rarest shingles. Two sets over the
  threshold share m of those (the smaller m of both), so that many a group must share with a set to
  be opened for it. Rarity comes from a merged count sketch over all documents, whose
  fixed size bounds what is broadcast; any order gives the same links, a good one keeps lines that
  a third of the documents share out of the prefixes.
* A pair of groups yields a spanning forest of its links and the number of links of each set; the
  components follow from the forests, the numbers add up.

Nulls and empty texts have an empty set and no link; null doc_ids are left out of the grouping and
get no component. Rows may repeat. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_rows, connected_components, documents, materialize, maybe_in, members, mix, ngrams, packed_blocks, signed, text_slices, unpack_gaps, words_of

#: log2 of the sketch's counters, at most: 16 MiB of bytes when broadcast.
SKETCH_BITS = 24
BLOCK_BITS = 16
#: Shingles and sets that a group holds at most, on average.
GROUP_SHINGLES, GROUP_SETS = 1 << 18, 512
KEYS = 4


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) of each slice; texts of under k words are one shingle."""
    for low, _, buf, offsets in text_slices(column):
        words, firsts = words_of(buf, offsets, lower=True)
        grams, starts = ngrams(words, firsts, k)
        counts, sets = np.diff(firsts), []
        for i in range(len(counts)):
            if counts[i] >= k:
                sets.append(np.unique(grams[starts[i] : starts[i + 1]]))
            elif counts[i]:
                whole = np.uint64(counts[i])
                for w in words[firsts[i] : firsts[i + 1]]:
                    whole = mix(np.array([whole], np.uint64) * np.uint64(31) + w)[0]
                sets.append(np.array([whole], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield low, sets


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5BF0_3635)) >> np.uint64(64 - bits)).astype(np.int64)


def _profile(k: int, bits: int):
    """One row per document (kind 0) and the task's sketch in blocks of counters (kind 1)."""
    seeds = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)][:KEYS]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64())] + [(f"key{i}", pa.int64()) for i in range(KEYS)] + [("block", pa.int32()), ("data", pa.binary())])

    def run(batches):
        waiting, held = [], 0

        def sketched():
            numbers, parts = packed_blocks(_cells(np.concatenate(waiting), bits), min(BLOCK_BITS, bits))
            none = [pa.nulls(len(numbers), pa.int64()) for _ in range(4 + KEYS)]
            return pa.RecordBatch.from_arrays([*none, pa.array(numbers, pa.int32()), binary_rows(parts)], schema=schema)

        for batch in batches:
            n, a, b, keys = [], [], [], [[] for _ in range(KEYS)]
            for _, sets in shingle_sets(batch.column("text"), k):
                n += [len(s) for s in sets]
                with np.errstate(over="ignore"):
                    a += [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    b += [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                for i in range(KEYS):
                    keys[i] += [int(mix(s ^ seeds[i]).min().view(np.int64)) if len(s) else 0 for s in sets]
                waiting.append(np.concatenate(sets))
                held += len(waiting[-1])
                if held > 1 << 20:
                    yield sketched()
                    waiting, held = [], 0
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())] + [pa.array(x, pa.int64()) for x in keys]
            columns += [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if held:
            yield sketched()

    return run, "doc_id long, n long, sig_a long, sig_b long, " + ", ".join(f"key{i} long" for i in range(KEYS)) + ", block int, data binary"


def _merge_blocks(bits: int):
    """log2 of the count in each cell of a block; a task holds the blocks dealt to it, 256 KiB each."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        size = 1 << min(BLOCK_BITS, bits)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                counts = total.setdefault(block, np.zeros(size, np.int32))
                counts += np.bincount(unpack_gaps(np.frombuffer(data.as_buffer(), np.uint8)), minlength=size).astype(np.int32)
        if total:
            levels = [np.floor(np.log2(np.maximum(x, 1))).astype(np.uint8) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), binary_rows(levels)], names=["block", "data"])

    return run


def rarity_levels(blocks: DataFrame, bits: int) -> np.ndarray:
    """log2 of the estimated number of documents with a shingle, by its cell: 2**bits bytes on the driver."""
    size = 1 << min(BLOCK_BITS, bits)
    levels = np.zeros(1 << bits, np.uint8)
    merged = blocks.select("block", "data").repartition("block").mapInArrow(_merge_blocks(bits), "block int, data binary")
    for block, data in merged.toLocalIterator():
        levels[block * size : (block + 1) * size] = np.frombuffer(data, np.uint8)
    return levels


def least_shared(n):
    """Shingles that the prefixes of two linked sets share at least, for the smaller size n: prefixes are as much longer."""
    return 1 + n * 4 // 100


def _prefixes(k: int, percent: int, bits: int, levels):
    def run(batches):
        table = levels.value
        for batch in batches:
            out = []
            for _, sets in shingle_sets(batch.column("text"), k):
                for s in sets:
                    n = len(s)
                    keep = n - (percent * n + 99) // 100 + least_shared(n) if n else 0
                    if keep < n:
                        level = table[_cells(s, bits)]
                        s = s[np.lexsort((s, level))[:keep]]
                    out.append(signed(s))
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), values)], names=["doc_id", "prefix"])

    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, part in shingle_sets(batch.column("text"), k) for s in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), binary_rows(sets)], names=["doc_id", "tokens"])

    return run


def _links_between(ids: list[int], sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links from the sets at `left` to those at `right`, and the number of
    documents that each set is linked with, for sets that so many documents have."""
    n_links = np.zeros(len(ids), np.int64)
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    count = np.bincount(code)
    # the group's token union, and the bound of each query set against it
    union = np.zeros(len(count), bool)
    union[np.concatenate([code[at[i] : at[i + 1]] for i in right])] = True
    shared = np.array([int(union[code[at[i] : at[i + 1]]].sum()) for i in left])
    open_for = left[100 * shared >= percent * sizes[left]]
    if not len(open_for):
        return [], n_links
    # only shingles that two sets hold can meet
    useful = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[useful] = np.arange(len(useful))

    def matrix(rows):
        m = np.zeros((len(rows), len(useful)), np.float32)
        for r, i in enumerate(rows):
            p = place[code[at[i] : at[i + 1]]]
            m[r, p[p >= 0]] = 1
        return m

    parent = {int(i): int(i) for i in np.concatenate([open_for, right])}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = max(1, (1 << 24) // max(len(useful), 1) // 4)
    found = []
    for a in range(0, len(open_for), step):
        rows = open_for[a : a + step]
        m = matrix(rows)
        for b in range(0, len(right), step):
            cols = right[b : b + step]
            inter = (m @ matrix(cols).T).astype(np.int64)
            hit = (100 + percent) * inter >= percent * (sizes[rows][:, None] + sizes[cols][None, :])
            if left is right:
                hit &= rows[:, None] != cols[None, :]
            else:
                n_links[cols] += copies[rows] @ hit
            n_links[rows] += hit @ copies[cols]
            for r, c in zip(*np.nonzero(hit), strict=True):
                x, y = root(int(rows[r])), root(int(cols[c]))
                if x != y:
                    parent[x] = y
                    found.append((ids[int(rows[r])], ids[int(cols[c])]))
    return found, n_links


def _open_pair(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens").combine_chunks()]
        side = np.array(table.column("side").to_pylist())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):  # a group with itself
            left = right = np.arange(len(ids))
        links, n_links = _links_between(ids, sets, table.column("copies").to_numpy(), left, right, percent)
        linked = np.flatnonzero(n_links)
        a, b = [x for x, _ in links] + [ids[i] for i in linked], [y for _, y in links] + [None] * len(linked)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array([0] * len(links) + n_links[linked].tolist(), pa.int64())})

    return run


def _grouped(reps: DataFrame) -> DataFrame:
    """Each set's group: by the first min-hash key that it shares with another set that is still alone."""
    alone, done = reps, None
    for i in range(KEYS - 1):
        size = alone.groupBy(f"key{i}").agg(F.count(F.lit(1)).alias("family_sets"), F.sum("n").alias("family_n")).where("family_sets > 1")
        # written, so that a join with a large family can be split
        joined = materialize(alone.join(materialize(size).hint("merge"), f"key{i}", "left"))
        parts = F.greatest(F.ceil(F.col("family_n") / GROUP_SHINGLES), F.ceil(F.col("family_sets") / GROUP_SETS))
        part = F.pmod(F.xxhash64("doc_id", F.lit("part")), parts)
        met = joined.where("family_sets is not null").select("doc_id", "n", "copies", F.xxhash64(F.lit(i), f"key{i}", part).alias("group"))
        done = met if done is None else done.unionByName(met)
        alone = joined.where("family_sets is null").drop("family_sets", "family_n")
    return done.unionByName(alone.select("doc_id", "n", "copies", F.xxhash64(F.lit(-1), "doc_id").alias("group")))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, n_links), one row per row of docs.
    n_links is the number of other documents (rows) that this one is linked with, copies among them.

    words: words a shingle has; percent: least Jaccard similarity of a link, in hundredths."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch_bits = min(sketch_bits, max(12, (size // 12).bit_length()))
    run, schema = _profile(words, sketch_bits)
    both = materialize(docs.mapInArrow(run, schema))
    profile = both.where("block is null")
    levels = spark.sparkContext.broadcast(rarity_levels(both.where("block is not null"), sketch_bits))

    sets = profile.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", *[f"key{i}" for i in range(KEYS)])).alias("first")
    classes = materialize(sets.groupBy("sig_a", "sig_b", "n").agg(first, F.count(F.lit(1)).alias("copies")))
    reps = classes.select("first.*", "n", "copies")
    groups = materialize(_grouped(reps))

    text_of = maybe_in(docs, "doc_id", members(reps, "doc_id"))
    prefixes = text_of.mapInArrow(_prefixes(words, percent, sketch_bits, levels), "doc_id long, prefix array<long>")
    prefixes = materialize(prefixes.join(groups.hint("merge"), "doc_id"))
    entries = prefixes.select(F.explode("prefix").alias("token"), "group", F.struct("n", "doc_id", "copies").alias("doc"))
    shared = materialize(entries.groupBy("token").agg(F.min("doc.doc_id").alias("a"), F.max("doc.doc_id").alias("b")).where("a < b").select("token"))
    # the matrix, where it can matter: tokens of two sets or more, with the sets of each group that they bound
    matrix = maybe_in(entries, "token", members(shared, "token")).join(shared, "token")
    matrix = materialize(matrix.groupBy("token", "group").agg(F.collect_list("doc").alias("docs")))
    pairs = matrix.select("token", F.col("group").alias("g"), F.col("docs").alias("left")).join(matrix.select("token", F.col("group").alias("h"), F.col("docs").alias("right")), "token").where("g < h or g = h and size(left) > 1")
    pairs = pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("overlap"), F.array_distinct(F.flatten(F.collect_list("left"))).alias("left"), F.array_distinct(F.flatten(F.collect_list("right"))).alias("right"))
    fewest = F.expr("array_min(transform(concat(left, right), x -> x.n))")
    pairs = pairs.where(F.col("overlap") >= 1 + F.floor(fewest * 4 / 100))
    near = f"exists({{other}}, y -> y.doc_id <> x.doc_id and 100 * y.n >= {percent} * x.n and 100 * x.n >= {percent} * y.n)"
    pairs = materialize(pairs.select("g", "h", F.expr(f"filter(left, x -> {near.format(other='right')})").alias("left"), F.expr(f"filter(right, x -> {near.format(other='left')})").alias("right")).where("size(left) > 0"))
    sides = [pairs.where("g < h" if i else "true").select("g", "h", F.lit(i).alias("side"), F.explode(x).alias("doc")).select("g", "h", "side", "doc.doc_id", "doc.copies") for i, x in enumerate(("left", "right"))]
    opened = materialize(sides[0].unionByName(sides[1]))

    tokens = maybe_in(docs, "doc_id", members(opened, "doc_id")).mapInArrow(_whole_sets(words), "doc_id long, tokens binary")
    met = opened.hint("merge").join(tokens, "doc_id").select("g", "h", "side", "doc_id", "copies", "tokens")
    links = materialize(met.groupBy("g", "h").applyInArrow(_open_pair(percent), "a long, b long, n_links long"))
    components = connected_components(links.where("b is not null").select("a", "b"))
    n_links = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))

    of_class = classes.select("sig_a", "sig_b", "n", "copies", F.col("first.doc_id").alias("rep"))
    of_class = of_class.join(components.withColumnRenamed("node", "rep"), "rep", "left").join(n_links, "rep", "left")
    of_class = of_class.select("sig_a", "sig_b", "n", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = profile.join(materialize(of_class), ["sig_a", "sig_b", "n"], "left")
    named = F.col("doc_id").isNotNull()
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Documents linked where 100 * |intersection| >= 85 * |union| of their 4-word shingle sets."""
    return jaccard_components(documents(spark, sf_dir), words=4, percent=85)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest id. Rows without doc_id
    stay, and so do all rows of an id that stays, once for each text."""
    kept = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("near_kept")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("near_id"), F.struct("*").alias("near_row"))
    named = rows.where("near_id is not null").join(kept, F.col("near_id") == F.col("near_kept"), "left_semi")
    # rows of one id and text are one document; the order of their other columns decides which stays
    digest = F.xxhash64(F.to_json("near_row", {"ignoreNullFields": "false"}))
    same = named.groupBy("near_id", F.xxhash64("near_row.text")).agg(F.min_by("near_row", digest).alias("near_row"))
    return same.select("near_row.*").unionByName(rows.where("near_id is null").select("near_row.*"))
