"""Each stage of the pipeline against what it should do to its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def stages():
    return dict(corpus_pipeline.STAGES)


def test_stage_shapes(spark, any_dir, stages):
    docs = spark.read.parquet(f"{any_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, any_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.count()
    assert corpus_pipeline.run(spark, any_dir).columns[:2] == ["doc_id", "piece"]


def test_language_keeps_lettered_documents(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in stages["language ID"](spark, docs, sf_dir).collect()}
    gone = [r for r in docs.collect() if r["doc_id"] not in kept]
    assert len(gone) <= 0.01 * docs.count()
    odd = docs.limit(3).union(spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, "en", "s", 0)], docs.schema))
    assert not {10**6, 10**6 + 1} & {r["doc_id"] for r in stages["language ID"](spark, odd, sf_dir).collect()}


def test_line_dedup_removes_only_repeats(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = Counter(x for t in text.values() for x in set((t or "").split("\n")))
    out = stages["line dedup"](spark, docs, sf_dir).collect()
    for r in out:
        gone = Counter(text[r["doc_id"]].split("\n")) - Counter(r["text"].split("\n"))
        assert all(count[x] > 1 or text[r["doc_id"]].split("\n").count(x) > 1 for x in gone)
        assert r["n_chars"] == len(r["text"]) or r["text"] == text[r["doc_id"]]
    kept_lines = {x for r in out for x in r["text"].split("\n")}
    assert kept_lines >= {x for t in text.values() if t for x in t.split("\n")}


def test_near_duplicates_keep_one_of_each(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    kept = {r["doc_id"] for r in stages["n-gram Jaccard join"](spark, docs, sf_dir).collect()}
    alike = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    order = sorted(sets)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    assert all(any(alike(a, b) for b in order if b != a) for a in order if a not in kept)


def test_mix_repeats_whole_documents(spark, sf_dir, stages):
    from tidemark.llm.source_mix import mix_sources

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = Counter(r["doc_id"] for r in stages["source mix"](spark, docs, sf_dir).collect())
    want = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mix_sources(docs).collect()}
    assert out == Counter({k: v for k, v in want.items() if v})


def test_packing_covers_every_row(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    out = stages["best-fit packing"](spark, docs.union(docs.limit(5)), sf_dir).where("piece = 0")
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.union(docs.limit(5)).collect())


def test_stages_keep_clashing_columns(spark, sf_dir, stages):
    """Columns with the names of inner ones stay as they are, and different texts under one id are documents of their own."""
    names = ["copies", "mix_size", "kept_id", "extra", "size", "text_hash", "line", "repeats", "component_id", "n", "bucket", "p", "of_source", "mix_row", "kept_text"]
    rows = [(2, "alpha beta gamma delta epsilon zeta eta theta", "s", 1), (2, "one quite different text under the same id it is", "s", 2), (3, "alpha beta gamma delta epsilon zeta eta theta", "s", 3), (4, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["n_chars"] + i)
    for name in ("line dedup", "n-gram Jaccard join", "source mix"):
        out = stages[name](spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        for r in out.collect():
            assert name == "line dedup" or all(r[x] == r["n_chars"] + i for i, x in enumerate(names))
    kept = {r["text"] for r in stages["n-gram Jaccard join"](spark, docs, sf_dir).collect()}
    assert kept == {r[1] for r in rows}


def test_mix_of_equal_rows(spark):
    """Of equal rows as many get another copy as the target asks for, not all or none; the stage takes what the operator says."""
    from pyspark.sql import functions as F

    from tidemark.llm.source_mix import mix_sources, mixing_stage

    schema = "doc_id long, text string, lang string, source string, n_chars long, given long"
    for sources, copies in ((("a", "b"), 1000), ((None, "x"), 300)):
        rows = [(7, "one two three", "en", sources[0], 13, 5)] * copies + [(8, "four five six", "en", sources[0], 13, 5)] * 40 + [(100 + i, "a b c", "en", sources[1], 5, 5) for i in range(copies)]
        docs = spark.createDataFrame(rows, schema).repartition(5)
        said = {r["source"]: (r["t"], r["n"]) for r in mix_sources(docs).groupBy("source").agg(F.max("target").alias("t"), F.sum("copies").alias("n")).collect()}
        took = {r["source"]: r["count"] for r in mixing_stage(spark, docs, "").groupBy("source").count().collect()}
        for source, (target, n) in said.items():
            assert took[source] == n and abs(3 * n - target) <= 3
