"""Substring dedup with a count-min prefilter.

A window is a fixed number of consecutive words. Its hash falls into a key range, and the number of
ranges grows with the corpus, so that a range has about as many windows at every size. Every task
sketches its windows batch by batch: for each range, the cells that the batch hit, with the document
behind each. A range's partition sketches are merged in one task into `ROWS` rows of counters; the
smallest counter of a window overestimates how many documents' windows it stands for, so windows
below two are surely single. Windows that are shared within a batch are known to be repeated: they
are named once, without their documents, so a range holds at most one cell of a batch for each
window, however many documents share it.

A second pass over the documents that have windows estimated as repeated groups exactly these, by
96 bits of hash, which loses none and finds each window's smallest document. Words covered by a
window that starts in a smaller document go. Exact copies of a whole text need no grouping: all but
the smallest document lose every word that a window covers.

A null text has no words. A document without doc_id neither loses words nor takes any. Rows of one
doc_id are one document. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_rows, documents, materialize, maybe_in, members, mix, ngrams, pack_varints, segment, signed, span_hashes, text_slices, unpack_varints

WINDOW = 13
ROWS = 2
#: Windows of a key range, about, and log2 of the cells in each row of its sketch (a byte each).
RANGE_WINDOWS, CELL_BITS = 1 << 21, 24
#: Bits by which a sketch names a window in its range.
NAME_BITS = 30
#: Windows and documents that a partition sketch covers, about.
BATCH_WINDOWS, BATCH_DOCS = 1 << 19, 50_000
_ROW_SEED = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_CHECK_SEED = np.uint64(0x2545F4914F6CDD1D)
_SKETCH_COLUMNS = "range int, first_doc long, docs binary, doc_at binary, cells binary, repeated binary, doc_id long, names array<long>"


def range_bits(n_bytes: int, range_windows: int = RANGE_WINDOWS) -> int:
    """log2 of the number of key ranges for texts of so many bytes, some six a window."""
    return max(0, math.ceil(math.log2(max(n_bytes / 6 / range_windows, 1))))


def windows_of(column: pa.Array, window: int, check: bool = False):
    """(first row, window hashes, each row's first window, other hashes of the same windows) of each slice."""
    for low, _, buf, offsets in text_slices(column):
        starts, ends, firsts = segment(buf, offsets)
        words = span_hashes(buf, starts, ends)
        grams, at = ngrams(words, firsts, window)
        yield low, grams, at, ngrams(mix(words ^ _CHECK_SEED), firsts, window)[0] if check else None


def _lists(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys in order, and the values of each as a list."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cuts, len(keys)).astype(np.int32))
    return keys[cuts], pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64)))


def _gaps(sorted_numbers: np.ndarray) -> np.ndarray:
    return pack_varints(np.diff(sorted_numbers, prepend=0))


def _partition_sketches(window: int, bits: int):
    """For each batch: a sketch per range, and for each document the windows that another one of the batch has too."""
    drop = np.uint64(64 - bits - NAME_BITS)

    def run(batches):
        hashes, owners, n, n_docs = [], [], 0, 0

        def flush():
            name = (np.concatenate(hashes) >> drop).astype(np.int64)
            doc = np.concatenate(owners)
            order = np.argsort(name, kind="stable")
            name, doc = name[order], doc[order]
            same = name[1:] == name[:-1]
            fresh = np.ones(len(name), bool)
            fresh[1:] = ~(same & (doc[1:] == doc[:-1]))
            name, doc = name[fresh], doc[fresh]
            first = np.ones(len(name), bool)
            first[1:] = name[1:] != name[:-1]
            shared = ~first
            shared[:-1] |= ~first[1:]
            known, lists = _lists(name[shared], doc[shared])
            rows = [[], [], [], [], [], []]
            alone = first & ~shared
            cuts = np.flatnonzero(np.diff(name >> NAME_BITS)) + 1
            for part in np.split(np.arange(len(name)), cuts):
                own, many = part[alone[part]], part[(first & shared)[part]]
                docs, at = np.unique(doc[own], return_inverse=True)
                base = int(docs[0]) if len(docs) else 0
                number, low = int(name[part[0]] >> NAME_BITS), (1 << NAME_BITS) - 1
                for column, x in zip(rows, (number, base, _gaps(docs - base), at.astype(np.uint16), _gaps(name[own] & low), _gaps(name[many] & low)), strict=True):
                    column.append(x)
            k, m = len(cuts) + 1, len(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *[binary_rows(x) for x in rows[2:]], pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64()))],
                names=["range", "first_doc", "docs", "doc_at", "cells", "repeated", "doc_id", "names"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.binary()) for _ in range(4)], pa.array(known, pa.int64()), lists],
                names=["range", "first_doc", "docs", "doc_at", "cells", "repeated", "doc_id", "names"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for low, grams, at, _ in windows_of(batch.column("text"), window):
                rows = len(at) - 1
                # a slice of many short texts may have more documents than a sketch can number
                if n and (n + len(grams) > 3 * BATCH_WINDOWS or n_docs + rows > BATCH_DOCS):
                    yield from flush()
                    hashes, owners, n, n_docs = [], [], 0, 0
                if len(grams):
                    hashes.append(grams)
                    owners.append(np.repeat(ids[low : low + rows], np.diff(at)))
                    n, n_docs = n + len(grams), n_docs + rows
                if n > BATCH_WINDOWS:
                    yield from flush()
                    hashes, owners, n, n_docs = [], [], 0, 0
        if n:
            yield from flush()

    return run


def _sketch_cells(names: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return (((names + 1).astype(np.uint64) * _ROW_SEED[row]) >> np.uint64(64 - cell_bits)).astype(np.int32)


def _merge_range(cell_bits: int):
    """A range's partition sketches -> the windows of each document whose counters are all two or more."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        read = lambda x, t=np.uint8: np.frombuffer(x.as_buffer(), t)
        messages = []
        for row in range(table.num_rows):
            docs = np.cumsum(unpack_varints(read(table.column("docs")[row]))) + table.column("first_doc")[row].as_py()
            messages.append((np.cumsum(unpack_varints(read(table.column("cells")[row]))).astype(np.int32), docs, read(table.column("doc_at")[row], np.uint16)))
        single = np.concatenate([m[0] for m in messages])
        several = np.concatenate([np.cumsum(unpack_varints(read(x))) for x in table.column("repeated")])
        suspect = np.ones(len(single), bool)
        for row in range(ROWS):
            own = _sketch_cells(single, row, cell_bits)
            ordered = np.sort(own)
            counters = np.zeros(1 << cell_bits, np.uint8)  # one is as good as none: only two and more matters
            counters[ordered[1:][ordered[1:] == ordered[:-1]]] = 2
            counters[_sketch_cells(several, row, cell_bits)] = 2
            suspect &= counters[own] > 1
        owner = np.concatenate([d[at] for _, d, at in messages])
        return pa.table({"doc_id": pa.array(owner[suspect], pa.int64()), "name": pa.array(single[suspect].astype(np.int64) + (number << NAME_BITS), pa.int64())})

    return run


def suspect_names(texts: DataFrame, window: int, bits: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """texts (doc_id, text) -> doc_id, names: the windows of each document, by name, that are estimated as repeated."""
    sketches = materialize(texts.mapInArrow(_partition_sketches(window, bits), _SKETCH_COLUMNS))
    known = sketches.where("range is null").select("doc_id", "names")
    merged = sketches.where("range is not null").select("range", "first_doc", "docs", "doc_at", "cells", "repeated").groupBy("range").applyInArrow(_merge_range(cell_bits), "doc_id long, name long")
    return materialize(known.unionByName(merged.select("doc_id", F.array("name").alias("names"))).groupBy("doc_id").agg(F.flatten(F.collect_list("names")).alias("names")))


def _suspects(window: int, bits: int):
    """Rows with the names of the windows estimated as repeated -> these windows, once for each document."""
    drop = np.uint64(64 - bits - NAME_BITS)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            names = batch.column("names")
            for low, grams, at, checks in windows_of(batch.column("text"), window, check=True):
                out = ([], [], [])
                short = (grams >> drop).astype(np.int64)
                for i in range(len(at) - 1):
                    own = slice(at[i], at[i + 1])
                    hit = np.isin(short[own], names[low + i].values.to_numpy())
                    h, first = np.unique(grams[own][hit], return_index=True)
                    out[0].append(h)
                    out[1].append(checks[own][hit][first])
                    out[2].append(np.full(len(h), ids[low + i]))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out[0]))), pa.array((signed(np.concatenate(out[1])) >> 32).astype(np.int32)), pa.array(np.concatenate(out[2]))], names=["window", "check", "doc_id"])

    return run


def _remove(window: int, texts: bool):
    """Rows with the hashes of the windows to remove (all: every window) -> counts and, if wanted, the kept words."""

    def run(batches):
        for batch in batches:
            flagged = batch.column("windows") if "windows" in batch.schema.names else None
            every = batch.column("every").to_pylist() if flagged is not None else None
            for low, high, buf, offsets in text_slices(batch.column("text")):
                n_words, n_removed, sha, kept_text = [], [], [], []
                starts, ends, firsts = segment(buf, offsets)
                grams, at = ngrams(span_hashes(buf, starts, ends), firsts, window) if flagged is not None else (None, None)
                data = buf.tobytes()
                for i in range(len(offsets) - 1):
                    a, b = int(firsts[i]), int(firsts[i + 1])
                    own = None
                    if flagged is not None and b - a >= window:
                        if every[low + i]:
                            own = np.ones(b - a - window + 1, bool)
                        elif flagged[low + i].is_valid:
                            values = np.asarray(flagged[low + i].values.to_numpy()).view(np.uint64)
                            own = np.isin(grams[at[i] : at[i + 1]], values)
                    n_words.append(b - a)
                    if own is None or not own.any():
                        n_removed.append(0)
                        kept = b" ".join(data[offsets[i] : offsets[i + 1]].split())
                    else:
                        depth = np.zeros(b - a + 1, np.int64)
                        hit = np.flatnonzero(own)
                        np.add.at(depth, hit, 1)
                        np.add.at(depth, hit + window, -1)
                        stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0) + a
                        n_removed.append(b - a - len(stay))
                        kept = b" ".join([data[starts[w] : ends[w]] for w in stay])
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_text.append(kept)
                arrays = [batch.column("doc_id").cast(pa.int64()).slice(low, high - low), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    arrays, names = [*arrays, pa.array(kept_text, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, texts: bool = True, range_windows: int = RANGE_WINDOWS, cell_bits: int = CELL_BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, and with texts kept_text: the kept words, joined by a space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    light = materialize(docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.octet_length("text").alias("bytes")))
    firsts = materialize(light.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    copies = light.join(firsts, "digest").where("doc_id > first_id").select("doc_id").distinct()
    bits = range_bits(light.agg(F.sum("bytes")).first()[0] or 0, range_windows)

    originals = maybe_in(docs.where("doc_id is not null"), "doc_id", members(firsts, "first_id"))
    names = suspect_names(originals, window, bits, cell_bits)
    again = maybe_in(originals, "doc_id", members(names, "doc_id")).join(names.hint("merge"), "doc_id")
    suspects = materialize(again.mapInArrow(_suspects(window, bits), "window long, check int, doc_id long"))
    least = materialize(suspects.groupBy("window", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    flagged = suspects.join(least, ["window", "check"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    flagged = materialize(flagged.join(copies.withColumn("every", F.lit(True)), "doc_id", "full").select("doc_id", "windows", F.coalesce("every", F.lit(False)).alias("every")))

    touched = members(flagged, "doc_id")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    clear = maybe_in(docs, "doc_id", touched, keep=False).mapInArrow(_remove(window, texts), schema)
    joined = maybe_in(docs, "doc_id", touched).join(flagged, "doc_id", "left")
    return clear.unionByName(joined.mapInArrow(_remove(window, texts), schema))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir), texts=False)
