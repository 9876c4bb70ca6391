"""What the pipeline's language stage rejects."""

import random

import corpus_pipeline


def test_foreign_scripts_go_and_short_clean_texts_stay(spark, sf_dir):
    stage, rng = dict(corpus_pipeline.STAGES)["language ID"], random.Random(2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = lambda low, n: [chr(c) for c in range(low, low + n)]
    text = lambda alphabet: " ".join("".join(rng.choices(alphabet, k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 150)))
    odd = [text(a) for a in (letters(0x430, 32), letters(0x4E00, 1024), letters(0x3B1, 25), letters(97, 26)) for _ in range(60)]
    short = [" ".join(r["text"].split()[4:16]) for r in docs.where("length(text) > 400 and doc_id % 3 = 0").orderBy("doc_id").limit(40).collect()]
    rows = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(odd)] + [(2 * 10**6 + i, t, None, "s", len(t)) for i, t in enumerate(short)]
    kept = {r["doc_id"] for r in stage(spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf_dir).where("doc_id >= 1000000").collect()}
    foreign = [i for i in range(180) if 10**6 + i in kept]
    assert not foreign and sum(10**6 + i in kept for i in range(180, 240)) <= 6
    assert sum(2 * 10**6 + i in kept for i in range(len(short))) >= 0.95 * len(short)
