"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a hash rolls over every two neighbouring ones. A boundary stands where the
rolled hash is no larger than one of its two neighbours, so it depends on four lines alone and moves with
the content; of any three lines in a row, two at least stand at a boundary. The chunk of a boundary is its
two lines. Where it occurs again, in another document or further down, it is compared with its first
occurrence by (doc_id, line), and grows by the line before and the line behind if these are alike too. Where one of
them isn't, it grows by it if the chunk has occurred with that line before: the first occurrence of the chunk may stand
in other surroundings. Of any two neighbouring chunks of two lines one is at a boundary, the same one wherever the three lines stand, so
that every line of a repeated run of three or more is reached. Last, the bytes of each line found are compared with those of the line it
repeats, and lines that are equal go. The first occurrence stays.

A run of two lines is found by chance only (a little over half of the time), or where it begins or ends a text. A chunk that
overlaps its own first occurrence stays. A null text stays null and has no lines; a single repeated
line stays. Documents without doc_id are left as they are. Rows of one doc_id are one document: they
lose nothing to each other. Extra columns stay as they are in the stage and are ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize, maybe_in, members, mix, signed, span_hashes, text_slices

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lines(column: pa.Array):
    """For each slice: (first row, end row, bytes, line starts, line ends, first line of each row and the end)."""
    for low, high, buf, offsets in text_slices(column):
        n = len(offsets) - 1
        newlines = np.flatnonzero(buf == 10)
        some = np.flatnonzero(offsets[:-1] < offsets[1:])
        begins = np.concatenate([offsets[:-1][some], newlines + 1])
        # a newline at a row's end begins an empty last line of that row, not of the next
        row = np.concatenate([some, np.searchsorted(offsets, newlines, "right") - 1])
        order = np.lexsort((begins, row))
        ends = np.sort(np.concatenate([newlines, offsets[1:][some]]))
        yield low, high, buf, begins[order], ends, np.searchsorted(row[order], np.arange(n + 1))


def boundaries(lines: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the lines whose rolled hash with the next line is a boundary, all rolled hashes), for the
    hashes of lines and the first line of each text."""
    rolled = np.full(len(lines) + 2, _TOP)  # [i + 1] is that of lines i and i + 1
    if len(lines) > 1:
        rolled[1:-2] = mix(mix(lines[:-1]) + lines[1:]) >> np.uint64(1)
    inner = firsts[1:][firsts[1:] > firsts[:-1]]
    rolled[inner] = _TOP  # a text's last line has no next one
    own = rolled[1:-1]
    return np.flatnonzero((own < _TOP) & ((own <= rolled[:-2]) | (own <= rolled[2:]))), own


def _chunks(batches):
    """Every chunk: its document, first line, hash, and the hashes of the lines around it (0: none)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for low, _, buf, starts, ends, firsts in _lines(batch.column("text")):
            lines = span_hashes(buf, starts, ends) | np.uint64(1)
            at, rolled = boundaries(lines, firsts)
            row = np.searchsorted(firsts, at, "right") - 1
            around = np.concatenate([[0], lines, [0, 0]]).astype(np.uint64)
            before = np.where(at > firsts[row], around[at], np.uint64(0))
            after = np.where(at + 2 < firsts[row + 1], around[at + 3], np.uint64(0))
            columns = [pa.array(ids[low + row]), pa.array((at - firsts[row]).astype(np.int32)), *[pa.array(signed(x)) for x in (rolled[at], before, after)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "hash", "before", "after"])


def _bodies(batches):
    """The bytes of the lines listed for each document."""
    for batch in batches:
        ids, wanted = batch.column("doc_id"), batch.column("lines").to_pylist()
        for low, high, buf, starts, ends, firsts in _lines(batch.column("text")):
            data, rows = buf.tobytes(), ([], [], [])
            for i in range(high - low):
                for line in wanted[low + i]:
                    at = firsts[i] + line
                    if at < firsts[i + 1]:
                        rows[0].append(ids[low + i].as_py())
                        rows[1].append(line)
                        rows[2].append(data[starts[at] : ends[at]])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["first_doc", "first_line", "body"])


def _keep(texts: bool):
    """Texts, with the lines that may go and the bytes these should have -> counts and, if wanted, the kept text."""

    def run(batches):
        for batch in batches:
            repeats = batch.column("repeats").to_pylist() if "repeats" in batch.schema.names else None
            null = batch.column("text").is_null().to_pylist()
            carried = [x for x in batch.schema.names if x == "row_columns"]
            for low, high, buf, starts, ends, firsts in _lines(batch.column("text")):
                data, n_removed, sha, text = buf.tobytes(), [], [], []
                for i in range(high - low):
                    a, b = int(firsts[i]), int(firsts[i + 1])
                    stay = np.ones(b - a, bool)
                    for r in (repeats and repeats[low + i]) or ():
                        j = r["line"]
                        if j < b - a and data[starts[a + j] : ends[a + j]] == r["body"]:
                            stay[j] = False
                    n_removed.append(int((~stay).sum()))
                    kept = b"\n".join([data[starts[j] : ends[j]] for j in np.flatnonzero(stay) + a])
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        text.append(None if null[low + i] else kept)
                columns = [batch.column("doc_id").cast(pa.int64()).slice(low, high - low), pa.array(np.diff(firsts).astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
                if texts:
                    columns, names = [*columns, pa.array(text, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(x).slice(low, high - low) for x in carried], names=names + carried)

    return run


def repeated_lines(named: DataFrame) -> DataFrame:
    """named (doc_id, text) -> doc_id, line, first_doc, first_line: lines of repeated chunks, by hash, each with one that it repeats."""
    chunks = materialize(named.mapInArrow(_chunks, "doc_id long, line int, hash long, before long, after long"))
    place = F.struct("doc_id", "line", "before", "after")
    twice = materialize(chunks.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("hash", "first"))
    met = materialize(maybe_in(chunks, "hash", members(twice, "hash")).join(twice, "hash"))
    # within one text, a chunk does not grow into its own first occurrence
    left = "before <> 0 and before = first.before and (doc_id <> first.doc_id or line >= first.line + 3)"
    steps = f"filter(array(-1, 0, 1, 2), s -> s in (0, 1) or s = -1 and {left} or s = 2 and after <> 0 and after = first.after)"
    again = met.where("doc_id <> first.doc_id or line >= first.line + 2").select("doc_id", "line", "first", F.explode(F.expr(steps)).alias("step"))
    lines = again.unionByName(_elsewhere(met, "before", -1)).unionByName(_elsewhere(met, "after", 2))
    lines = lines.select("doc_id", (F.col("line") + F.col("step")).alias("line"), F.struct(F.col("first.doc_id").alias("first_doc"), (F.col("first.line") + F.col("step")).alias("first_line")).alias("first"))
    return lines.groupBy("doc_id", "line").agg(F.min("first").alias("first")).select("doc_id", "line", "first.*")


def _elsewhere(met: DataFrame, side: str, step: int) -> DataFrame:
    """Repeated chunks whose line on one side is not that of the chunk's first occurrence, with the first one that has the same
    line there: the chunk grows by it."""
    place = F.struct("doc_id", "line", "before", "after")
    other = met.where(f"{side} <> 0 and {side} <> first.{side}").drop("first")
    firsts = other.groupBy("hash", side).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    apart = 3 if step < 0 else 2
    return other.join(firsts, ["hash", side]).where(f"doc_id <> first.doc_id or line >= first.line + {apart}").select("doc_id", "line", "first", F.lit(step).alias("step"))


def remove_repeated_lines(docs: DataFrame, carry: list[str] | None = None, texts: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_removed, kept_sha256, with texts kept_text, and the
    columns in carry as a struct row_columns."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row_columns")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    named = docs.where("doc_id is not null").select("doc_id", "text")
    found = materialize(repeated_lines(named))

    wanted = found.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_set("first_line").alias("lines"))
    firsts = maybe_in(named, "doc_id", members(found, "first_doc")).join(wanted.hint("merge"), "doc_id")
    bodies = materialize(firsts.mapInArrow(_bodies, "first_doc long, first_line int, body binary").distinct())
    repeats = found.join(bodies, ["first_doc", "first_line"]).groupBy("doc_id").agg(F.collect_list(F.struct("line", "body")).alias("repeats"))
    repeats = materialize(repeats)

    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "") + (f", row_columns {docs.schema['row_columns'].dataType.simpleString()}" if carry else "")
    losing = members(repeats, "doc_id")
    clear = maybe_in(docs, "doc_id", losing, keep=False).mapInArrow(_keep(texts), schema)
    joined = maybe_in(docs, "doc_id", losing).join(repeats.hint("merge"), "doc_id", "left")
    return clear.unionByName(joined.mapInArrow(_keep(texts), schema))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(documents(spark, sf_dir), texts=False)


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs of lines; a document that has lost all its lines goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeated_lines(docs, carry=others).where("not (n_removed > 0 and n_removed = n_lines)")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"row_columns.`{c}`") for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return out.select([columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
