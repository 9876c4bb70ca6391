"""Merkle manifest of a dataset, with a node store that never has to fit in memory.

Every row is a leaf: the digest of its fields, each with its length. The leaves of a tree (one for each
value of `lang`) are ranked by doc_id, and eight consecutive nodes become their parent until one is left;
the trees' roots, ordered by lang, make a last tree of the same kind.

Building goes bottom up in passes of SPAN levels. A pass deals its nodes into runs of FANOUT**SPAN
consecutive positions, sorts each run by position and streams it once: each level reads the one below in
order and holds FANOUT digests. The parents go to Parquet, partitioned by level, each with its children's
digests; the nodes of the highest level are the leaves of the next pass. Sizes fall by FANOUT a level, so
passes are few, and the last ones tiny.

Proofs go top down over the same runs. A run's nodes, sorted by the first position they cover, are a walk
through its trees before their leaves; merged with the leaves, one scan holds just the current node of each level
and so has every leaf's siblings at hand. Above the run its path is the same for all its leaves: one row. No proof is
shuffled, and none is held beyond the row that it is for.

Null fields have a mark of their own, so a null text differs from an empty one. Null langs make a tree of their
own, before the others; rows without doc_id come first in theirs. Rows that repeat a doc_id are ordered by their digests; equal
rows are leaves each. A missing column counts as null, extra columns are ignored. An empty table gives no
rows. doc_ids and n_chars are written in decimal, so their types don't matter.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize, scratch_dir

FANOUT = 8
#: Levels of a pass: runs hold 512 nodes.
SPAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a partition when leaves are ranked.
RANKED = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node_digest(children: list[bytes]) -> bytes:
    """Of a parent: of its children's digests, as hex text one behind the other."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of all fields: `-` for null, else the number of bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def tree_key(lang: Column) -> Column:
    """Trees in order: null is least, and no string's key."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


# --- positions ------------------------------------------------------------------------------


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (key, ...), best a written table, with pos (from 0) and n (rows of the key): places by `by` within key. Range
    partitions are sorted and counted; a place is one's own in its partition, and the rows of its key before that one.
    A written table."""
    parts = max(1, -(-rows.count() // RANKED))
    dealt = rows.repartitionByRange(parts, "key", *by).sortWithinPartitions("key", *by)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = F.expr("sum(c) over (partition by key order by part) - c")
    counts = counts.select("key", "part", (before - F.col("first")).alias("shift"), F.expr("sum(c) over (partition by key)").alias("n"))
    return materialize(dealt.join(counts, ["key", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n"))


# --- bottom up ------------------------------------------------------------------------------

_NODE = "key string, n long, pos long, level int, digest binary, children binary, first long"


def _height(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def _parents(span: int):
    """Nodes of whole runs, sorted by (key, pos) -> all their ancestors, up to span levels or the root."""

    def run(batches):
        open_run, levels, out = None, [], []

        def close(level):
            """The pending nodes of a level become one of the level above."""
            key, n, number = open_run
            children, levels[level] = levels[level], []
            pos = number * FANOUT ** (span - level - 1) + made[level]
            made[level] += 1
            digest = node_digest(children)
            out.append((key, n, pos, level + 1, digest, b"".join(children), pos * FANOUT ** (level + 1)))
            if level + 1 < len(levels):
                push(level + 1, digest)

        def push(level, digest):
            levels[level].append(digest)
            if len(levels[level]) == FANOUT:
                close(level)

        def finish():
            for level in range(len(levels)):
                if levels[level]:
                    close(level)

        def rows():
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["key", "n", "pos", "level", "digest", "children", "first"])

        for batch in batches:
            for key, n, pos, digest in zip(*[batch.column(c).to_pylist() for c in ("key", "n", "pos", "digest")], strict=True):
                if open_run is None or open_run[0] != key or open_run[2] != pos // FANOUT**span:
                    finish()
                    open_run, levels = (key, n, pos // FANOUT**span), [[] for _ in range(min(span, _height(n)))]
                    made = [0] * len(levels)
                if levels:
                    push(0, digest)
            yield rows()
        finish()
        yield rows()

    return run


class NodeStore:
    """The passes of a forest: for each, its base nodes (key, n, pos, digest) and the folder of their ancestors."""

    def __init__(self, base: DataFrame):
        self.spark = base.sparkSession
        self.passes: list[tuple[DataFrame, DataFrame]] = []
        self.roots: DataFrame | None = None
        size = FANOUT**SPAN
        while True:
            run = F.floor(F.col("pos") / size)
            dealt = base.select("key", "n", "pos", "digest").repartition("key", run).sortWithinPartitions("key", "pos")
            path = f"{scratch_dir(self.spark)}/nodes-{uuid.uuid4().hex}"
            dealt.mapInArrow(_parents(SPAN), _NODE).write.partitionBy("level").parquet(path)
            nodes = self.spark.read.schema(_NODE).parquet(path)
            self.passes.append((base, nodes))
            lone = base.where("n = 1").select("key", "digest")
            done = nodes.where((F.col("n") <= size) & (F.col("pos") == 0)).where(_is_root()).select("key", "digest")
            self.roots = done.unionByName(lone) if self.roots is None else self.roots.unionByName(done)
            more = nodes.where((F.col("n") > size) & (F.col("level") == SPAN))
            if more.isEmpty():
                break
            base = materialize(more.select("key", F.ceil(F.col("n") / size).cast("long").alias("n"), "pos", "digest"))


def _is_root() -> Column:
    """The node's level is the height of its tree, which this pass ends: FANOUT**level >= n > FANOUT**(level - 1)."""
    return F.expr(f"n <= power({FANOUT}, level) and n > power({FANOUT}, level - 1)")


# --- top down -------------------------------------------------------------------------------

_PATH = "array<struct<at: int, nodes: binary>>"
_ITEM = pa.list_(pa.struct([("at", pa.int32()), ("nodes", pa.binary())]))


def _group(at: int, nodes: bytes) -> tuple[int, bytes, str, str]:
    """A node's place among its siblings and itself, their digests, and the siblings' hex text left and right of it."""
    text = nodes.hex()
    return at, nodes, text[: 64 * at], text[64 * at + 64 :]


def _walk(span: int, leaf):
    """Rows of whole runs, sorted as a walk: the run's path upwards, then each node before what it covers.
    leaf(batch, row, groups, head) takes each base row with the groups from its own up to the root, and the run's
    own row; it returns an output row of `leaf.schema`."""

    def run(batches):
        head, stack, height, suffix = None, [], 0, None
        for batch in batches:
            out = []
            levels, positions, n = (batch.column(c).to_pylist() for c in ("level", "pos", "n"))
            children = batch.column("children").to_pylist()
            for i, level in enumerate(levels):
                if level > span:
                    head = {c: batch.column(c)[i].as_py() for c in ("path", "root", "subroot")}
                    upper = [_group(g["at"], g["nodes"]) for g in head["path"]]
                    stack, height = [None] * span, min(span, _height(n[i]))
                elif level:
                    stack[level - 1] = children[i]
                else:
                    if suffix is None:  # all above one's own group is the same for the whole group
                        suffix = [_group(positions[i] // FANOUT**k % FANOUT, stack[k]) for k in range(1, height)] + upper
                    out.append(leaf(batch, i, ([_group(positions[i] % FANOUT, stack[0])] if height else []) + suffix, head))
                    continue
                suffix = None
            columns = list(zip(*out, strict=True)) if out else [()] * len(leaf.schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, leaf.schema, strict=True)], names=[name for name, _ in leaf.schema])

    return run


class _Paths:
    """Base nodes with their groups, for the pass below."""

    schema = (("key", pa.string()), ("pos", pa.int64()), ("path", _ITEM), ("root", pa.binary()), ("subroot", pa.binary()), ("digest", pa.binary()))
    ddl = f"key string, pos long, path {_PATH}, root binary, subroot binary, digest binary"

    def __call__(self, batch, i, groups, head):
        path = [{"at": at, "nodes": nodes} for at, nodes, _, _ in groups]
        return batch.column("key")[i].as_py(), batch.column("pos")[i].as_py(), path, head["root"], head["subroot"], batch.column("digest")[i].as_py()


def fold(leaf: bytes, groups: list[tuple]) -> bytes:
    """The root that a leaf has with these siblings."""
    for _, _, left, right in groups:
        leaf = hashlib.sha256(f"{left}{leaf.hex()}{right}".encode()).digest()
    return leaf


class _Proofs:
    """Leaves with the digest of their proof and the root that their tampered form gives."""

    schema = (("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()))
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def __call__(self, batch, i, groups, head):
        leaf, tampered = batch.column("digest")[i].as_py(), batch.column("tampered")[i].as_py()
        folded = fold(leaf if tampered is None else tampered, groups)
        proof = hashlib.sha256("".join([left + right for _, _, left, right in groups]).encode()).hexdigest()
        return batch.column("doc_id")[i].as_py(), leaf.hex(), head["subroot"].hex(), head["root"].hex(), proof, folded.hex(), folded == head["root"]


def _extract(base: DataFrame, nodes: DataFrame, heads: DataFrame, leaf) -> DataFrame:
    """base (key, n, pos, digest, ...) and its ancestors, with heads (key, run, path, root, subroot), the way from
    each run's last nodes up -> the rows of `leaf`."""
    size = FANOUT**SPAN
    empty = {"n": "long", "pos": "long", "level": "int", "digest": "binary", "children": "binary", "first": "long", "path": _PATH, "root": "binary", "subroot": "binary", "doc_id": "long", "tampered": "binary"}
    counts = base.where(F.col("pos") % size == 0).select("key", F.floor(F.col("pos") / size).alias("run"), "n")
    parts = [
        heads.join(counts, ["key", "run"]).withColumns({"level": F.lit(SPAN + 1), "first": F.col("run") * size}),
        nodes.withColumn("run", F.floor(F.col("first") / size)),
        base.withColumns({"run": F.floor(F.col("pos") / size), "level": F.lit(0), "first": F.col("pos")}),
    ]
    wide = [p.select("key", "run", *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in empty.items()]) for p in parts]
    rows = wide[0].unionByName(wide[1]).unionByName(wide[2]).repartition("key", "run").sortWithinPartitions("key", "run", "first", F.desc("level"))
    return rows.mapInArrow(_walk(SPAN, leaf), leaf.ddl)


def _paths_down(store: NodeStore, ends: DataFrame, last) -> DataFrame:
    """ends (key, path, root, subroot): the way up from each tree's root. From the last pass to the first, the ways of the base
    nodes; `last` gives the rows of the first pass."""
    size, paths = FANOUT**SPAN, None
    for k, (base, nodes) in reversed(list(enumerate(store.passes))):
        ended = base.where(f"n <= {size} and pos = 0").select("key").join(ends, "key").select("key", F.lit(0).cast("long").alias("run"), "path", "root", "subroot")
        heads = ended if paths is None else ended.unionByName(paths.select("key", F.col("pos").alias("run"), "path", "root", "subroot"))
        out = _extract(base, nodes, heads, _Paths() if k else last)
        paths = materialize(out) if k else out
    return paths


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `tampered` holds, folded_root and verified are those of the row with tampered_text for its text."""
    docs = docs.select([(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    text = F.lit(None).cast("binary")
    if tampered is not None:
        text = F.when(tampered, leaf_digest([F.col(c) for c in FIELDS[:-1]] + [tampered_text]))
    leaves = docs.select(tree_key(F.col("lang")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), text.alias("tampered"))
    leaves = ranked(materialize(leaves), ["doc_id", "digest"])
    store = NodeStore(leaves)

    roots = materialize(store.roots)
    top = NodeStore(ranked(roots.select(F.lit("").alias("key"), F.col("key").alias("tree"), "digest"), ["tree"]))
    named = top.passes[0][0].select("pos", "tree")
    ends = top.roots.select("key", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"), F.lit(None).cast("binary").alias("subroot"))
    ways = _paths_down(top, ends, _Paths()).join(named, "pos")
    ways = materialize(ways.select(F.col("tree").alias("key"), "path", "root", F.col("digest").alias("subroot")))
    return _paths_down(store, ways, _Proofs())


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """A third of the documents, by the checksum of their ids, are tampered with: their text in lower case."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(documents(spark, sf_dir), F.coalesce(chosen, F.lit(False)), F.translate("text", UPPER, LOWER))
