"""The manifest against one in plain Python, which holds whole trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import merkle_manifest as M
from tidemark.llm.queries import QUERIES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def way(levels, at):
    """(siblings left, right) at each level."""
    out = []
    for nodes in levels[:-1]:
        low = at // 8 * 8
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 8])))
        at //= 8
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(((r[0] is not None, r[0] or 0, leaf_of(r)), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by_lang[x].sort(key=lambda e: e[0])
        trees[x] = tree([e[0][2] for e in by_lang[x]])
    top = tree([trees[x][-1][0] for x in langs])
    for place, x in enumerate(langs):
        for at, ((_, _, leaf), r) in enumerate(by_lang[x]):
            steps, folded = way(trees[x], at) + way(top, place), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf_of([*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])])
            for left, right in steps:
                folded = h(left + folded + right)
            yield (r[0], leaf, trees[x][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0])


def rows_of(spark, d):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def test_op11(spark, any_dir):
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, any_dir).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows_of(spark, any_dir)), key=repr)


@pytest.mark.parametrize("ranked", [700, M.RANKED])
def test_trees_of_many_heights(spark, tmp_path, monkeypatch, ranked):
    """Trees that end in the first, second and third pass, at whole and at broken runs, and more trees than a run holds."""
    monkeypatch.setattr(M, "RANKED", ranked)
    monkeypatch.setattr(M, "SPAN", 1 if ranked > 700 else 2)
    sizes = {None: 65, "": 1, "a": 4097, "b": 512, "c": 513, "é": 8, "z": 9} | {f"l{i}": i % 3 + 1 for i in range(70)}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 10007 if i % 50 else 5, ["s", None][i % 2], lang, i, f"Text {i}"))
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_changed_fields_are_found(spark):
    """A changed text, a null for an empty one, or a value moved to another field give another root."""
    roots = set()
    for row in [(1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abd"), (1, "a", "en", 3, ""), (1, "a", "en", 3, None), (1, "", "en", 3, "abc"), (1, None, "en", 3, "abc"), (1, "aen", "", 3, "abc"), (1, "a", None, 3, "abc")]:
        docs = spark.createDataFrame([row, (2, "x", "en", 1, "y")], "doc_id long, source string, lang string, n_chars long, text string")
        out = M.merkle_manifest(docs).collect()
        assert all(r["verified"] and r["folded_root"] == r["root"] for r in out)
        roots.add(out[0]["root"])
    assert len(roots) == 8


def test_a_missing_column_and_a_text_of_five_megabytes(spark):
    docs = spark.createDataFrame([(1, "w" * 5_000_000, 1, "p")], "doc_id long, text string, level int, key string")
    (row,) = M.merkle_manifest(docs).collect()
    assert row["leaf"] == leaf_of([1, None, None, None, "w" * 5_000_000]) == row["root"] and row["proof_sha256"] == h("")
