"""Each query against a brute-force version, over the test table, the edge rows and an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def run(spark, name, d):
    return [r.asDict() for r in QUERIES[name](spark, d).collect()]


def key(*names):
    return lambda r: tuple((r[n] is None, r[n] if r[n] is not None else 0) for n in names)


def same(got, want, *names):
    pick = lambda rows: sorted([tuple(r[n] for n in names) for r in rows], key=repr)
    assert pick(got) == pick(want)


def test_op1(spark, any_dir, docs_of):
    docs = docs_of(any_dir)
    sets = []
    for i, t, *_ in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                holders[g].append(n)
    seen, links = set(), Counter()
    for members in holders.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 85 * len(x | y):
                        links[a] += 1
                        links[b] += 1
                        p, q = root(sets[a][0]), root(sets[b][0])
                        parent[max(p, q)] = min(p, q)
    want = [{"doc_id": i, "n_shingles": len(s), "component_id": None if i is None else root(i), "n_links": links[n]} for n, (i, s) in enumerate(sets)]
    same(run(spark, "op1_ngram_jaccard", any_dir), want, "doc_id", "n_shingles", "component_id", "n_links")


def test_op2(spark, any_dir, docs_of):
    docs = sorted(((i, t or "") for i, t, *_ in docs_of(any_dir)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for n, (i, t) in enumerate(docs):
        given = docs[(n + 1) % len(docs)][1]
        m = len(t) // 3
        want.append({"doc_id": i, "n_chars": len(t), "edited_sha256": sha(t[: len(t) - m] + given[:m])})
    got = run(spark, "op2_syncmer_fingerprint", any_dir)
    same(got, want, "doc_id", "n_chars", "edited_sha256")
    by_text = defaultdict(set)
    text_of = dict(docs)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text_of[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(set().union(*by_text.values()) if by_text else set()) == len(by_text)


def test_op2_edited_equals_fingerprint_of_edited_text(spark, sf_dir, docs_of):
    from tidemark.llm.syncmer_fingerprint import fingerprints

    docs = sorted(((i, t or "") for i, t, *_ in docs_of(sf_dir)), key=lambda r: -r[0])
    edited = [(i, t[: len(t) - len(t) // 3] + docs[(n + 1) % len(docs)][1][: len(t) // 3]) for n, (i, t) in enumerate(docs)]
    want = {r["doc_id"]: r["fingerprint"] for r in fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    got = run(spark, "op2_syncmer_fingerprint", sf_dir)
    assert {r["doc_id"]: r["edited_fingerprint"] for r in got} == want
    assert sum(r["near_edited"] for r in got) / len(got) > 0.5 > 0.1 > sum(r["near_next"] for r in got) / len(got)


@pytest.mark.parametrize("kind", ["latin", "base64", "cjk", "thai", "words", "short"])
def test_op2_insertions_keep_likeness(spark, kind):
    """A character put in at the head of a text, with spaces or without any, leaves its fingerprint alike; other texts are not."""
    import random

    from pyspark.sql import functions as F

    from tidemark.llm.syncmer_fingerprint import likeness_sql, sketch_sql

    rng = random.Random(kind)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "cjk": [chr(x) for x in range(0x4E00, 0x5200)], "thai": [chr(x) for x in range(0xE01, 0xE2F)]}
    if kind in letters:
        texts = ["".join(rng.choice(letters[kind]) for _ in range(n)) for n in (900, 1200, 1500, 5000)]
    else:
        texts = [" ".join("".join(rng.choice(letters["latin"]) for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in ((20, 25, 30, 40) if kind == "short" else (80, 300, 1000, 3000))]
    rows = spark.createDataFrame([(t, "x" + t, texts[i - 1]) for i, t in enumerate(texts)], "own string, near string, far string")
    rows = rows.select(*[F.expr(sketch_sql(x)).alias(x) for x in rows.columns])
    for near, far in rows.select(F.expr(likeness_sql("own", "near")), F.expr(likeness_sql("own", "far"))).collect():
        assert near > (0.6 if kind == "short" else 0.9) and far < 0.1


def test_op2_fingerprint_by_brute_force(spark, edge_dir, docs_of):
    """Symbols, k-mers and their edges by plain Python, with the hash that Spark gives."""
    import re

    from pyspark.sql import functions as F

    from tidemark.llm import syncmer_fingerprint as op

    pattern = re.compile(op.SYMBOL.replace("\\x{10FFFF}", "\U0010ffff"))
    texts = sorted({t or "" for _, t, *_ in docs_of(edge_dir) if len(t or "") < 3000})
    marked = []
    for t in texts:
        symbols = [m[0] for m in pattern.finditer(t)] or ([t] if t else [])
        marked.append(["\x02"] * 3 + symbols + ["\x03"] * 2 if symbols else [])
    pairs = sorted({(a, b) for w in marked for a, b in zip(w, w[1:], strict=False)})
    mers = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    chosen = []
    for w in marked:
        m = [mers[p] for p in zip(w, w[1:], strict=False)]
        chosen.append([(i, m[i], m[i + 2], m[i + 4]) for i in range(len(m) - 4) if i == 0 or min(m[i], m[i + 4]) <= min(m[i + 1 : i + 4])])
    whole = sorted({c[1:] for own in chosen for c in own})
    hashes = {(r["x"], r["y"], r["z"]): r["h"] for r in spark.createDataFrame(whole, "x long, y long, z long").select("x", "y", "z", F.xxhash64("x", "y", "z").bitwiseAND((1 << 40) - 1).alias("h")).collect()}
    want = []
    for t, own in zip(texts, chosen, strict=True):
        first = {}
        for i, *mer in own:
            first.setdefault(hashes[tuple(mer)], i)
        want.append((t, " ".join(f"{h:x}:{i}" for h, i in sorted(first.items())[: op.SIZE])))
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(op.spelled_sql(op.sketch_sql("text")))).collect()
    assert sorted(tuple(r) for r in got) == want


def test_op3(spark, any_dir, docs_of):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want, total = [], 0
    for i, t, *_ in docs_of(any_dir):
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append({"doc_id": i, "piece": piece, "start": at, "length": len(part), "ids_crc32": zlib.crc32(np.array(part, "<u4").tobytes())})
    got = run(spark, "op3_best_fit_packing", any_dir)
    same(got, want, "doc_id", "piece", "start", "length", "ids_crc32")
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= max(1, 1.05 * total / 2048 + 2) or not got


def test_op4(spark, any_dir, docs_of):
    docs = docs_of(any_dir)
    got = run(spark, "op4_language_id", any_dir)
    lang = {i: x for i, _, x, _ in docs}
    learned = {x for i, t, x, _ in docs if x and zlib.crc32(str(i).encode()) % 3 != 1}
    want = [{"doc_id": i, "held_out": i is not None and zlib.crc32(str(i).encode()) % 3 == 1} for i, *_ in docs]
    same(got, want, "doc_id", "held_out")
    text = {i: t for i, t, *_ in docs}
    for r in got:
        lettered = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] in learned) if lettered else r["lang_pred"] == "und"
        assert 0 <= r["score"] <= 1
    if len(docs) > 100:
        judged = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in judged) >= 0.97 * len(judged)


def test_op5(spark, any_dir, docs_of):
    want = []
    for i, t, *_ in docs_of(any_dir):
        t = t or ""
        w = WORD.findall(t)
        places = defaultdict(list)
        for j in range(len(w) - 2):
            places[tuple(w[j : j + 3])].append(j)
        covered = {j + d for p in places.values() if len(p) > 1 for j in p for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append({
            "doc_id": i, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
        })
    got = run(spark, "op5_quality_rules", any_dir)
    same(got, want, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert not any(r["kept"] for r in got if r["base_failed"])


def brute_secrets(t):
    kinds = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))


def test_op6(spark, any_dir, docs_of):
    want = []
    for i, t, *_ in docs_of(any_dir):
        found = brute_secrets(t or "")
        kinds = Counter(n for _, n, _ in found)
        want.append({"doc_id": i, "n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2], "base_sha256": sha(",".join(x for *_, x in found))})
    got = run(spark, "op6_secret_scan", any_dir)
    same(got, want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    for r in got:
        base = [x for x in r["spans"].split(",") if x and not x.startswith("random")]
        assert sha(",".join(base)) == r["base_sha256"]


def test_op7(spark, any_dir, docs_of):
    docs = docs_of(any_dir)
    got = run(spark, "op7_source_mix", any_dir)
    size = lambda t: len(WORD.findall(t or ""))
    totals = defaultdict(int)
    for _, t, _, s in docs:
        totals[s] += size(t)
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][n % 3] for n, s in enumerate(sources)}
    target, left, free = {}, float(sum(totals.values())), list(sources)
    while free:
        by = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if by[s] > 3 * totals[s]]
        if not over:
            target |= by
            break
        target |= {s: 3.0 * totals[s] for s in over}
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    source = {i: s for i, _, _, s in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    same(got, [{"doc_id": i, "size": size(t)} for i, t, *_ in docs], "doc_id", "size")
    for s in totals:
        largest = max(size(t) for _, t, _, x in docs if x == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    same(got, run(spark, "op7_source_mix", any_dir), "doc_id", "taken")


def test_op7_inclusion_follows_the_probabilities(spark):
    """Within one source, documents are sampled in proportion to their size, large ones for certain."""
    from tidemark.llm.source_mix import mix_sources

    docs = spark.createDataFrame([(i, "w " * (10, 20, 40, 400)[min(i % 4, 3 if i < 40 else 2)], "b" if i % 5 else "a") for i in range(4000)], "doc_id long, text string, source string")
    share, expected = Counter(), {}
    for seed in (1, 2, 3):
        rows = mix_sources(docs, seed=seed).where("source = 'b'").collect()
        whole = min(r["copies"] for r in rows)
        assert {r["copies"] - whole for r in rows} == {0, 1}
        for size in (10, 20, 40, 400):
            own = [r for r in rows if r["size"] == size]
            expected[size] = sum(r["p"] for r in own) / len(own)
            assert max(r["p"] for r in own) - min(r["p"] for r in own) < 1e-9
            share[size] += sum(r["copies"] - whole for r in own) / len(own) / 3
    assert 0.05 < expected[10] and expected[20] == pytest.approx(2 * expected[10]) and expected[400] > 0.99
    assert all(abs(share[s] - expected[s]) < 0.05 for s in expected)


def test_op7_many_sources(spark, monkeypatch):
    """Beyond FEW_SOURCES the tables of sources are joined; nothing else changes."""
    from tidemark.llm import source_mix

    docs = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 300}" if i % 7 else None) for i in range(2000)], "doc_id long, text string, source string")
    few = sorted(tuple(r) for r in source_mix.mix_sources(docs).select("doc_id", "source_size", "target", "taken").collect())
    monkeypatch.setattr(source_mix, "FEW_SOURCES", 10)
    assert few == sorted(tuple(r) for r in source_mix.mix_sources(docs).select("doc_id", "source_size", "target", "taken").collect())


def test_op8(spark, any_dir, docs_of):
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in docs_of(any_dir)]
    first = {}
    for i, w in docs:
        if i is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, w in docs:
        gone = {j + d for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for d in range(13)}
        want.append({"doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(" ".join(x for j, x in enumerate(w) if j not in gone))})
    same(run(spark, "op8_substring_dedup", any_dir), want, "doc_id", "n_words", "n_removed", "kept_sha256")


def test_op8_small_sketches_lose_nothing(spark, sf_dir):
    from tidemark.llm.substring_dedup import remove_repeated_windows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    full = {tuple(r) for r in remove_repeated_windows(docs).collect()}
    assert {tuple(r) for r in remove_repeated_windows(docs, range_windows=4096, cell_bits=6).collect()} == full


@pytest.mark.parametrize(("n_docs", "ranges"), [(100, 4), (800, 32)])
def test_op8_sketch_passes_few_single_windows(spark, n_docs, ranges):
    """Texts without a repeated window: as the table grows, so do the ranges, and the share that passes stays small."""
    import random

    from tidemark.llm.substring_dedup import range_bits, suspect_names

    rng = random.Random(n_docs)
    texts = [(i, " ".join(f"{rng.randrange(10**8):08}" for _ in range(120))) for i in range(n_docs)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bits = range_bits(sum(len(t) for _, t in texts), 8192)
    assert 1 << bits == ranges
    passed = sum(len(r["names"]) for r in suspect_names(docs, 13, bits, cell_bits=15).collect())
    assert passed < 0.1 * 108 * n_docs


def test_op8_windows_of_very_many_documents(spark):
    """A passage that all documents share goes from all but the first, whatever the batches."""
    from tidemark.llm.substring_dedup import remove_repeated_windows

    shared = " ".join(f"s{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own{i} {shared} end{i}") for i in range(500)], "doc_id long, text string").repartition(7)
    assert {(r["doc_id"], r["n_removed"]) for r in remove_repeated_windows(docs, texts=False).collect()} == {(i, 20 if i else 0) for i in range(500)}


def test_op9(spark, any_dir, docs_of):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t, *_ in docs_of(any_dir):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        at = [j for j, _ in places]
        want.append({"doc_id": i, "n_words": len(w), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted({x for _, x in places}))})
    text_of = {i: t or "" for i, t, *_ in docs_of(any_dir)}
    got = run(spark, "op9_license_scan", any_dir)
    same(got, want, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    # labels and score of the notices, by a plain search; texts with a tag are tested in test_license_reach.py
    from tidemark.llm.license_scan import NOTICES, TAGS

    for r in got:
        texts = [t or "" for i, t, *_ in docs_of(any_dir) if i == r["doc_id"]] if len(got) < 50 else [text_of[r["doc_id"]]]
        spaced = [" " + " ".join(word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))) + " " for t in texts]
        held = [{(label, weight) for p, label, weight in NOTICES if f" {p} " in t} for t in spaced]
        expected = [(",".join(sorted({x for x, _ in h})), max([w for _, w in h], default=0.0)) for h in held]
        assert any(f" {p} " in t for p in TAGS for t in spaced) or (r["labels"], r["score"]) in expected


def test_op9_expressions():
    from tidemark.llm.license_scan import parse_expression

    e = parse_expression("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nnext words here")
    assert e.licences() == {"mit", "apache-2.0", "gpl-2.0-only"}
    assert e.required() == {"gpl-2.0-only"}
    assert e.allowed({"mit", "gpl-2.0-only"}.__contains__) and not e.allowed({"mit", "apache-2.0"}.__contains__)
    assert parse_expression("MIT OR ").licences() == {"mit"} and parse_expression("and or") is None
    assert parse_expression("mit or isc and zlib").postfix == ("mit", "isc", "zlib", "and", "or") and parse_expression("((mit)") is None


def repeated_pairs(docs):
    """For each row: numbers of the lines in a pair of neighbouring lines that stood before, in a smaller document or without overlap further up."""
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None and d[1]), key=lambda d: d[0]):
        lines = t.split("\n")
        for j, pair in enumerate(zip(lines, lines[1:], strict=False)):
            first[pair] = min(first.get(pair, (i, j)), (i, j))
    for i, t in docs:
        lines, gone = t.split("\n") if t else [], set()
        for j, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if i is not None and (first[pair][0] < i or first[pair][0] == i and j >= first[pair][1] + 2):
                gone |= {j, j + 1}
        yield lines, gone


def test_op10(spark, any_dir, docs_of):
    docs = [(i, t) for i, t, *_ in docs_of(any_dir)]
    got = {(r["doc_id"], r["n_lines"], r["kept_sha256"], r["n_removed"]) for r in QUERIES["op10_line_dedup"](spark, any_dir).collect()}
    from tidemark.llm.line_dedup import remove_repeated_lines

    kept = {(r["doc_id"], r["n_lines"], r["kept_sha256"], r["n_removed"]): r["kept_text"] for r in remove_repeated_lines(spark.read.parquet(f"{any_dir}/documents.parquet")).collect()}
    assert got == set(kept) and all(sha(t or "") == k[2] for k, t in kept.items())
    may_go = reached = 0
    for (i, t), (lines, gone) in zip(docs, repeated_pairs(docs), strict=True):
        # a subsequence of the lines, without none but repeated ones
        fits = [k for k, text in kept.items() if k[0] == i and k[1] == len(lines) and not Counter((text or "").split("\n") if k[3] < k[1] else []) - Counter(lines)]
        assert any(not Counter(lines) - Counter((kept[k] or "").split("\n") if k[3] < k[1] else []) - Counter(lines[j] for j in gone) for k in fits)
        may_go, reached = may_go + len(gone), reached + max(k[3] for k in fits)
    assert reached >= 0.8 * may_go
