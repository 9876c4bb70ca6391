"""Shared pieces of the training-data operators.

Three things live here: vectorised word and n-gram hashing over Arrow string columns, tables
written to the cluster's shared folder (so that a lost executor loses nothing), and membership
filters that let a scan drop most rows before a shuffle. A filter only ever lets too much through,
so an exact join always follows it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is hashed in pieces of about this many bytes, so that a task's arrays stay small.
SLICE_BYTES = 1 << 19
#: log2 of the bits of a membership bitmap, at most: 32 MiB when broadcast. Larger sets of ids are joined instead.
MOST_ID_BITS = 28

_LOCAL_SCRATCH: list[str] = []


# --- tables in the shared folder ------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local
    mode, in which all tasks see it; on a cluster they would not, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_LOCAL_SCRATCH[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and later readers don't recompute it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- membership filters ---------------------------------------------------------------------

#: Longs in a row of a membership bitmap.
_WIDE = 16


@dataclass(frozen=True)
class Members:
    """Ids that a scan is thinned by: a bitmap of 2**bits bits, or the ids themselves (bits is None)."""

    table: DataFrame
    column: str
    bits: int | None


def _bit(column: str, bits: int):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits))


def members(ids: DataFrame, column: str, most_bits: int = MOST_ID_BITS) -> Members:
    """ids is best a written table, as it is counted first. A bitmap of some eight bits an id is made if it
    is no larger than 2**most_bits bits, and so may be broadcast; else the ids stay a table to be joined."""
    bits = max(10, (8 * ids.count()).bit_length())
    if bits > most_bits:
        return Members(ids.select(F.col(column).alias("member_id")).distinct(), column, None)
    at = _bit(column, bits)
    one, word = F.expr("shiftleft(1L, cast(bitmap_at & 63 as int))"), F.expr("shiftright(bitmap_at, 6) & 15")
    rows = ids.select(at.alias("bitmap_at")).groupBy(F.shiftright("bitmap_at", 10).alias("bitmap_row"))
    return Members(materialize(rows.agg(*[F.bit_or(F.when(word == j, one).otherwise(0)).alias(f"bitmap_{j}") for j in range(_WIDE)])), column, bits)


def maybe_in(df: DataFrame, column: str, ids: Members, keep: bool = True) -> DataFrame:
    """Rows whose id may be among the ids (keep), or surely isn't (not keep). A bitmap also lets some
    others pass, so an exact join follows; ids beyond the bitmap's bound are joined right here."""
    if ids.bits is None:
        return df.join(ids.table, df[column] == ids.table["member_id"], "left_semi" if keep else "left_anti")
    marked = df.withColumn("bitmap_at", _bit(column, ids.bits)).withColumn("bitmap_row", F.shiftright("bitmap_at", 10))
    marked = marked.join(F.broadcast(ids.table), "bitmap_row", "left")
    word = f"array({', '.join(f'bitmap_{j}' for j in range(_WIDE))})[cast(shiftright(bitmap_at, 6) & 15 as int)]"
    hit = F.coalesce(F.expr(f"(shiftrightunsigned({word}, cast(bitmap_at & 63 as int)) & 1) = 1"), F.lit(False))
    return marked.where(hit if keep else ~hit).drop("bitmap_at", "bitmap_row", *[f"bitmap_{j}" for j in range(_WIDE)])


# --- hashing --------------------------------------------------------------------------------

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.randint(0, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.empty(size, np.uint64)
            table[0] = 1
            table[1:] = base
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them), about SLICE_BYTES at a time; null is empty."""
    for first in range(0, len(column), 1024):
        part = pc.fill_null(column.slice(first, 1024).cast(pa.large_binary()), b"")
        _, offset_buffer, data = part.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[part.offset : part.offset + len(part) + 1]
        everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at, n = 0, len(part)
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            end = min(n, max(end, at + 1))
            yield first + at, first + end, everything[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def segment(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators, and each row's first run."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = word[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever the span stands."""
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GRAM[63])


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first word."""
    if lower:
        buf = _LOWER[buf]
    starts, ends, firsts = segment(buf, offsets)
    return span_hashes(buf, starts, ends), firsts


def ngrams(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a row, in order, and each row's first one."""
    counts = np.maximum(np.diff(firsts) - (k - 1), 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    if total == 0:
        return np.zeros(0, np.uint64), starts
    whole = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * _GRAM[j]
    at = np.arange(total) + np.repeat(firsts[:-1] - starts[:-1], counts)
    return mix(whole[at]), starts


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def pack_gaps(sorted_cells: np.ndarray) -> np.ndarray:
    """Sorted cells as gaps of one byte, 255 standing for 255 and more to come."""
    gaps = np.diff(sorted_cells, prepend=0)
    many, rest = gaps // 255, gaps % 255
    ends = np.cumsum(many + 1)
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[ends - 1] = rest
    return out


def unpack_gaps(packed: np.ndarray) -> np.ndarray:
    return np.cumsum(packed, dtype=np.int64)[packed != 255]


def packed_blocks(cells: np.ndarray, block_bits: int) -> tuple[list[int], list[np.ndarray]]:
    """Numbers of the blocks that the cells fall in, and the packed cells of each."""
    cells = np.sort(cells)
    parts = np.split(cells, np.flatnonzero(np.diff(cells >> block_bits)) + 1)
    return [int(p[0] >> block_bits) for p in parts], [pack_gaps(p & ((1 << block_bits) - 1)) for p in parts]


def pack_varints(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 2**35 - 1 as bytes of seven bits, the lowest first; the top bit says that more follow."""
    values = values.astype(np.uint64)
    more = [values >> np.uint64(7 * k) for k in range(1, 5)]
    width = 1 + sum((m > 0).astype(np.int64) for m in more)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - width
    out[starts] = (values & np.uint64(127)).astype(np.uint8) | ((width > 1) << 7).astype(np.uint8)
    for k, m in enumerate(more, 1):
        has = np.flatnonzero(width > k)
        out[starts[has] + k] = (m[has] & np.uint64(127)).astype(np.uint8) | ((width[has] > k + 1) << 7).astype(np.uint8)
    return out


def unpack_varints(packed: np.ndarray) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, np.int64)
    last = packed < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    number = np.cumsum(last) - last
    shift = np.arange(len(packed)) - starts[number]
    return np.add.reduceat((packed & 127).astype(np.int64) << (7 * shift), starts)


def binary_rows(parts: list[np.ndarray]) -> pa.Array:
    """Each array's bytes as one binary value."""
    return pa.array([x.tobytes() for x in parts], pa.binary())


# --- connected components -------------------------------------------------------------------


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) between ids -> (node, component): each node that has a link, with the smallest
    id it can reach. Alternates large-star and small-star rounds until nothing changes; every round
    is a few aggregates and joins, so no component is ever gathered in one place."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = materialize(small)
