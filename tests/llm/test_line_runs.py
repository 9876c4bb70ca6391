"""Recall of line dedup against a brute force that knows no chunks."""

import random

import pytest

import corpus_pipeline
from tidemark.llm.line_dedup import remove_repeated_lines


def repeated_lines(docs):
    """For each (doc_id, text), ids ascending: the numbers of the lines in a pair of neighbouring lines that stood before."""
    first, out = {}, {}
    for i, t in docs:
        lines, out[i] = t.split("\n"), set()
        for j, pair in enumerate(zip(lines, lines[1:], strict=False)):
            d, at = first.setdefault(pair, (i, j))
            if d != i or j >= at + 2:
                out[i] |= {j, j + 1}
    return out


@pytest.fixture
def passages():
    """Passages of 2 to 9 lines that stand twice, behind and before other lines."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    own = lambda: [word() for _ in range(rng.randrange(6))]
    runs = [[word() for _ in range(2 + n % 8)] for n in range(160)]
    return [(i, "\n".join(own() + runs[i % 160] + own())) for i in range(320)] + [(400, "a\n" * 9 + "a")]


@pytest.mark.parametrize("name", ["operator", "stage"])
def test_recall_by_length(spark, sf_dir, passages, name):
    """All lines of a passage of three lines or more go from its second place, and nothing else; of two lines, most."""
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    if name == "stage":
        left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, sf_dir).collect()}
    else:
        left = {r["doc_id"]: r["kept_text"] for r in remove_repeated_lines(docs).collect()}
    gone, pairs = repeated_lines(passages), [0, 0]
    for i, t in passages:
        lines = t.split("\n")
        rest = "\n".join(x for j, x in enumerate(lines) if j not in gone[i])
        if len(gone[i]) == 2:
            pairs[0] += 1
            pairs[1] += left.get(i, "") == rest
            assert left.get(i, "") in (rest, t)
        elif len(gone[i]) == len(lines) and name == "stage":
            assert i not in left
        else:
            assert left[i] == rest
    assert pairs[1] >= 0.5 * pairs[0]


def test_recall_on_the_test_table(spark, sf_dir):
    """Of the lines in repeated runs of three lines or more, nine in ten go at least."""
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text <> ''").collect()}
    gone = repeated_lines(sorted(text.items()))
    left = {r["doc_id"]: r["n_removed"] for r in remove_repeated_lines(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    wanted = reached = 0
    for i, lines in gone.items():
        if len(lines) > 2:
            wanted, reached = wanted + len(lines), reached + left[i]
    assert wanted > 20 and reached >= 0.9 * wanted


@pytest.mark.parametrize(("length", "part"), [(3, slice(0, 2)), (3, slice(1, 3)), (4, slice(1, 3)), (6, slice(2, 4))])
def test_runs_whose_parts_stood_before(spark, length, part):
    """All lines of a run go from its second place, though some of them stand in an earlier document between other lines."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    runs = [[word() for _ in range(length)] for _ in range(300)]
    around = lambda lines: "\n".join([word(), word(), *lines, word(), word()])
    docs = [(i, around(run[part])) for i, run in enumerate(runs)] + [(1000 + i, around(run)) for i, run in enumerate(runs)] + [(2000 + i, around(run)) for i, run in enumerate(runs)]
    removed = {r["doc_id"]: r["n_removed"] for r in remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(removed[i] == 0 and removed[1000 + i] in (0, 2, 3) and removed[2000 + i] == length for i in range(300))
