"""Quality rules: a decision list learned from labelled statistics.

Statistics of whole texts are counted in one vectorised pass. From a bounded sample of labelled
documents, sequential covering learns rules for bad documents one at a time: a conjunction of
threshold conditions is grown on two thirds of the rows by information gain, pruned from its end on
the others, and kept if it is precise enough there; what it covers is set aside. The list becomes
one ordered Spark conditional expression, the first rule that holds deciding.

A null text has no words. With no labels, or labels of one class, the list is empty and keeps what
the base rules keep. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize, ngrams, segment, span_hashes, text_slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct_words")
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?"))
_NEWLINE = np.arange(256) == 10
#: Labelled documents that the list is learned from, at most.
SAMPLE_ROWS = 20_000


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each value occurs again in its row, and whether an equal one came before it."""
    order = np.lexsort((np.arange(len(values)), values, row))
    v, r = values[order], row[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    twice, later = np.empty(len(v), bool), np.empty(len(v), bool)
    twice[order], later[order] = again, same
    return twice, later


def statistics_of(column: pa.Array) -> np.ndarray:
    """COUNTS of each row, as columns."""
    out = []
    for _, _, buf, offsets in text_slices(column):
        n = len(offsets) - 1
        starts, ends, firsts = segment(buf, offsets)
        hashes = span_hashes(buf, starts, ends)
        n_words = np.diff(firsts)
        row = np.repeat(np.arange(n), n_words)
        inside = np.zeros(len(buf) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside)[:-1] > 0
        word_chars = _per_row(inside & ((buf & 0xC0) != 0x80), offsets)

        grams, gram_firsts = ngrams(hashes, firsts, 3)
        gram_row = np.repeat(np.arange(n), np.diff(gram_firsts))
        twice, _ = _repeated(grams, gram_row)
        covered = np.zeros(len(hashes), bool)
        at = (np.arange(len(grams)) + np.repeat(firsts[:-1] - gram_firsts[:-1], np.diff(gram_firsts)))[twice]
        for j in range(3):
            covered[at + j] = True

        line_starts, line_ends, line_firsts = segment(buf, offsets, _NEWLINE)  # empty lines hold no word
        lines = span_hashes(buf, line_starts, line_ends)
        words_before = np.searchsorted(starts, np.stack([line_starts, line_ends]))
        worded = words_before[1] > words_before[0]
        line_row = np.repeat(np.arange(n), np.diff(line_firsts))
        _, later = _repeated(lines, line_row)
        _, seen = _repeated(hashes, row)
        per_row = lambda flags, rows: np.bincount(rows, weights=flags, minlength=n).astype(np.int64)
        out.append(np.stack([
            n_words, word_chars, _per_row(_SYMBOL[buf], offsets), per_row(later & worded, line_row), per_row(covered, row), _per_row(_UPPER[buf], offsets),
            _per_row(_DIGIT[buf], offsets), _per_row(_MARK[buf], offsets), per_row(worded, line_row), per_row(~seen, row),
        ]))
    return np.concatenate(out, 1) if out else np.zeros((len(COUNTS), 0), np.int64)


def _count(batches):
    for batch in batches:
        counted = statistics_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in counted]], names=["doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and COUNTS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What conditions are about: rates that don't depend on a text's length."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars"),
        "digit_rate": per("n_digits", "word_chars"), "mark_rate": per("n_marks", "n_words"), "distinct_rate": per("n_distinct_words", "n_words"), "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.threshold if self.above else data[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value <= self.threshold


def _covered(rule, data, n):
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(data)
    return hit


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best, best_gain = None, 1e-9
        for name, values in data.items():
            cuts = np.unique(np.quantile(values[live], np.linspace(0, 1, 41)))
            for cut in (cuts[1:] + cuts[:-1]) / 2:
                for above in (True, False):
                    hit = live & (values >= cut if above else values <= cut)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = Condition(name, above, float(cut)), gain
        if best is None:
            break
        rule.append(best)
        live &= best.holds(data)
    return rule


def learn_list(data: dict[str, np.ndarray], bad: np.ndarray, third: np.ndarray, precision: float = 0.9, most_rules: int = 16) -> list[tuple[Condition, ...]]:
    """Ordered rules for bad rows. third: the rows that rules are pruned and judged on."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & bad & ~third).sum() >= 3:
        own = {k: v[left & ~third] for k, v in data.items()}
        rule = _grow(own, bad[left & ~third])
        judged = left & third
        best, worth = None, -1.0
        for cut in range(len(rule), 0, -1):
            hit = _covered(rule[:cut], data, len(bad)) & judged
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            if p and p / (p + n) >= precision and (p - n) / (p + n) > worth:
                best, worth = rule[:cut], (p - n) / (p + n)
        if best is None:
            break
        rules.append(tuple(best))
        left &= ~_covered(best, data, len(bad))
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """True where no rule holds: one conditional expression, in the list's order."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column()
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Condition, ...]]:
    """labels (doc_id, quality): 0 is bad. The sample's rows are those of the smallest hashes of doc_id."""
    labelled = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = labelled.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample_rows)
    rows = statistics.join(sample, "doc_id").select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit("third")), F.lit(3)).alias("third"), *[v.cast("double").alias(k) for k, v in features().items()]).toPandas().sort_values("doc_id")
    data = {k: rows[k].to_numpy(float) for k in features()}
    return learn_list(data, (rows["quality"] == 0).to_numpy(), (rows["third"] == 0).to_numpy())


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    statistics = materialize(text_statistics(documents(spark, sf_dir)))
    rules = learn_rules(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
