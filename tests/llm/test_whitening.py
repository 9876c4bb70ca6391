"""Whitening against numpy's eigenvectors of the whole covariance, and exact integers."""

import math

import numpy as np
import pytest

from tidemark.llm import embedding_whitening as W
from tidemark.llm.queries import QUERIES


def usable(rows):
    return [(i, [math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(got, rows, k=16, close=1e-7):
    """got: rows of the operator; rows: (vec_id, x)."""
    x = np.array([v for _, v in rows], dtype=object)
    fit = np.array(sorted({tuple(v) for _, v in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    count = int((values[:k] > 1e-12 * max(values[0], 1e-300)).sum()) if n > 1 else 0
    assert len(got) == len(rows) * count
    if not count:
        return
    want = ((x * n - sums).astype(float) / n) @ axes[:, :count] / np.sqrt(values[:count])
    deviation = [sum(int(c) ** 2 for c in v) for v in (x * n - sums)]
    by_key, ours = {}, {}
    for (i, _), w, d in zip(rows, want, deviation, strict=True):
        by_key.setdefault(i, []).append((d, w))
    for r in got:
        assert r["n"] == n and 0 <= r["identity_error"] <= 1e-4 and r["residual"] <= W.ROUNDING
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) <= 1e-6 * r["explained"]
        ours.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], r["whitened"]))
    for c in range(1, count + 1):
        a = np.array([v for i in by_key for v in sorted(d for d, _ in by_key[i])], dtype=object)
        b = np.array([v for i in by_key for v in sorted(d for d, _ in ours[i, c])], dtype=object)
        assert (a == b).all()
        a = np.array([v for i in by_key for v in sorted((w[c - 1] for _, w in by_key[i]))])
        b = np.array([v for i in by_key for v in sorted(v for _, v in ours[i, c])])
        flipped = np.array([v for i in by_key for v in sorted(-v for _, v in ours[i, c])])
        assert min(np.abs(a - b).max(), np.abs(a - flipped).max()) < close


def test_op13(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(), usable(rows))


SCHEMA = "vec_id long, embedding array<float>, n long, x string, place int"


def table(spark, at, rows):
    spark.createDataFrame([(i, v, 9, "w", 3) for i, v in rows], SCHEMA).write.parquet(f"{at}/embeddings.parquet")
    return QUERIES["op13_embedding_whitening"](spark, str(at)).collect()


def test_edge_rows(spark, tmp_path):
    """Null and empty vectors, null and infinite entries, repeated rows and ids, nulls for ids, another dimension, clashing columns."""
    rng = np.random.RandomState(3)
    good = [(i % 90, [float(np.float32(c)) for c in rng.standard_normal(20) * np.arange(1, 21)]) for i in range(120)]
    good += [(None, good[0][1]), good[5], good[5]]
    bad = [(200, None), (201, []), (202, [None] * 20), (203, [math.nan] * 20), (204, [1.0] * 19 + [math.inf]), (205, [1.0] * 3), (206, [3e38] * 20)]
    check(table(spark, tmp_path, good + bad), usable(good))


@pytest.mark.parametrize(("rows", "name"), [([], "none"), ([(1, [1.0, 2.0])], "one"), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "equal"), ([(1, []), (2, [])], "empty"), ([(1, None)], "null")])
def test_too_little_for_a_component(spark, tmp_path, rows, name):
    assert table(spark, tmp_path, rows) == []


def test_fewer_components_than_asked_for(spark, tmp_path):
    """Vectors in a plane of ten dimensions have two components."""
    rng = np.random.RandomState(4)
    plane = rng.randint(-3, 4, (2, 10))
    rows = [(i, [float(c) for c in rng.randint(-20, 20, 2) @ plane]) for i in range(60)]
    got = table(spark, tmp_path, rows)
    assert {r["component"] for r in got} == {1, 2}
    check(got, usable(rows))


def test_many_dimensions_and_small_gaps(spark):
    """Restarts are needed: 300 dimensions, a flat spectrum, two components."""
    rng = np.random.RandomState(5)
    x = rng.standard_normal((900, 300)) * np.linspace(1.3, 1.0, 300)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    check(W.whiten(docs, k=2).collect(), usable(rows), k=2, close=1e-6)


def test_large_sums_stay_exact(spark):
    """Entries near the largest that fit: deviations over a long are null, others exact."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([(3e7, 0), (-3e7, 1), (2.9e7, 5), (1, 1), (2, 2)])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [v for _, v in usable(rows)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((5 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in usable(rows)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in want.items()}
