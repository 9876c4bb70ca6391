"""Language ID by hyperdimensional profiles.

A letter is a random +1/-1 vector drawn from its code point. A letter trigram binds its three
letters, permuted by place, by elementwise product; a text bundles the vectors of its trigrams by
adding them, and a language prototype bundles the texts of its labelled documents. Texts go to the
prototype of the largest cosine.

Bundling is linear, so a text's product with a prototype is the sum over its trigrams of the
trigram's product with it, which a worker computes once per trigram; and the squared length of a
bundle of nearly orthogonal vectors is the dimension times the sum of the squared counts.

A text that is null or has no letter is `und` with score 0; so is every text when nothing was
learned. Rows may repeat; extra columns are ignored. Each worker remembers a bounded number of
trigrams.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize, text_slices

DIMENSION = 2048
UNKNOWN = "und"
#: Trigrams whose products a worker remembers.
CACHE_TRIGRAMS = 300_000

_letters: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, np.int64)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _letters.append(table)
    return _letters[0]


def letter_vector(letter: int, dimension: int) -> np.ndarray:
    if letter not in _vectors:
        _vectors[letter] = np.where(np.random.RandomState(letter + 1).randint(0, 2, dimension), 1, -1).astype(np.int8)
    return _vectors[letter]


def trigram_vectors(keys: np.ndarray, dimension: int) -> np.ndarray:
    """One bound vector per trigram key, as rows."""
    out = np.ones((len(keys), dimension), np.int8)
    for place, shift in enumerate((42, 21, 0)):
        letters, code = np.unique((keys >> shift) & 0x1FFFFF, return_inverse=True)
        own = np.stack([np.roll(letter_vector(int(x), dimension), 2 - place) for x in letters])
        out *= own[code]
    return out


def trigram_counts(column: pa.Array):
    """(first row, rows, trigram keys, row of each count, key of each count, counts) of each slice."""
    table = letter_table()
    for low, high, buf, offsets in text_slices(column):
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        mid = table[points]
        before, after = np.zeros_like(mid), np.zeros_like(mid)
        before[1:], after[:-1] = mid[:-1], mid[1:]
        full = begins[:-1] < begins[1:]
        before[begins[:-1][full]] = 0
        after[begins[1:][full] - 1] = 0
        at = np.flatnonzero(mid)
        row = np.repeat(np.arange(high - low), np.diff(begins))[at]
        code, keys = pd.factorize((before[at] << 42) | (mid[at] << 21) | after[at])
        n, u = high - low, len(keys)
        if n * u <= 1 << 23:
            dense = np.bincount(row * u + code, minlength=n * u)
            cell = np.flatnonzero(dense)
            counts = dense[cell]
        else:
            cell, counts = np.unique(row * u + code, return_counts=True)
        yield low, n, keys, cell // max(u, 1), cell % max(u, 1), counts


def _bundle(dimension: int):
    """Rows (text, lang) -> one row per language of the task: the sum of its trigrams' vectors."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, code = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(code, weights=np.concatenate([c for _, c in parts]))

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for low, n, keys, row, key, counts in trigram_counts(batch.column("text")):
                own = langs[low : low + n][row]
                for lang in set(own):
                    mine = own == lang
                    total = np.bincount(key[mine], weights=counts[mine], minlength=len(keys))
                    parts = held.setdefault(lang, [])
                    parts.append((keys[total > 0], total[total > 0]))
                    if len(parts) > 32:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            total = np.zeros(dimension)
            for at in range(0, len(keys), 1024):
                total += counts[at : at + 1024] @ trigram_vectors(keys[at : at + 1024], dimension).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "bundle": [np.rint(total).astype(np.int64)]})

    return run


def learn_prototypes(labelled: DataFrame, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """labelled (text, lang) -> the languages and their prototypes, one row each: all that is
    brought to the driver is a vector per language."""
    parts = labelled.select("text", "lang").mapInArrow(_bundle(dimension), "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in sums})
    index = {x: i for i, x in enumerate(langs)}
    prototypes = np.zeros((len(langs), dimension))
    for lang, place, value in sums:
        prototypes[index[lang], place] = value
    return langs, prototypes


def _predict(langs: list[str], prototypes, dimension: int):
    def run(batches):
        unit = prototypes.value
        known = np.zeros(0, np.int64)
        products = np.zeros((0, len(langs)))
        for batch in batches:
            names, scores = [], []
            for _, n, keys, row, key, counts in trigram_counts(batch.column("text")):
                fresh = np.setdiff1d(keys, known)
                if len(fresh) and len(langs):
                    if len(known) > CACHE_TRIGRAMS:
                        fresh, known, products = np.unique(keys), known[:0], products[:0]
                    more = np.concatenate([trigram_vectors(fresh[a : a + 1024], dimension).astype(np.float32) @ unit.T for a in range(0, len(fresh), 1024)])
                    order = np.argsort(np.concatenate([known, fresh]))
                    known, products = np.concatenate([known, fresh])[order], np.concatenate([products, more])[order]
                length = np.sqrt(dimension * np.bincount(row, weights=counts.astype(float) ** 2, minlength=n))
                if len(langs) and len(keys):
                    own = products[np.searchsorted(known, keys)][key] * counts[:, None]
                    cosine = np.stack([np.bincount(row, weights=own[:, j], minlength=n) for j in range(len(langs))], 1) / np.maximum(length, 1)[:, None]
                    best = cosine.argmax(1)
                    score = np.clip(cosine[np.arange(n), best], 0, 1)
                else:
                    best, score = np.zeros(n, int), np.zeros(n)
                lettered = (length > 0) & (len(langs) > 0)
                names += [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, score, 0.0))
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[x for x in batch.schema.names if x != "text"] + ["lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score); labelled (text, lang) is what is learned from."""
    langs, prototypes = learn_prototypes(labelled, dimension)
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast(unit.astype(np.float32))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(langs, shared, dimension), "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, training_rows(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this cosine a text is like none of the languages: unrelated vectors have a standard deviation of
#: 1 / sqrt(dimension), and five of them leave the best of a few languages almost no chance.
REJECT_BELOW = 5 / DIMENSION**0.5


def language_stage(spark, docs: DataFrame, sf_dir: str, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Drops documents whose language cannot be told: those without letters, and those that are
    like no prototype. A text of a word or two, whose few trigrams are rare, may be among the latter."""
    rejected = materialize(identify(docs, training_rows(docs)).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < reject_below)).select(F.col("doc_id").alias("rejected_id")).distinct())
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["rejected_id"]), "left_anti")
