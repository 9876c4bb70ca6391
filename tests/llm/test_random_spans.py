"""Random strings against strings written from words, planted in the test table."""

import random
import string

import pytest

from tidemark.llm.secret_scan import KINDS, scan_secrets

ALPHABETS = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567"]
WORDS = "account access bridge buffer cache client config cursor device driver engine event export filter format global handle import index invoice kernel legacy letter manager mirror network object packet parser payment policy query reader record report request response router schema server session signal socket source stream string system table target thread token update upload value vector version window worker".split()
PLAIN = ["usr/local/lib/python3/site-packages/extension", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "1234567890123456789012345678901234567890a", "antidisestablishmentarianism2antidisestablishment", "2024-01-01-2024-01-02-2024-01-03-backup", "====================1a======"]


def look_alike(rng):
    words = rng.choices(WORDS, k=rng.randrange(4, 9))
    number = str(rng.randrange(10 ** rng.randrange(1, 7)))
    return rng.choice([
        "".join(w.title() for w in words) + number, "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]) + number, "/".join(words), "-".join(words) + "-" + number, "_".join(words) + number, "_".join(words).upper() + "_" + number, "".join(words) + number,
    ])


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    rng = random.Random(3)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    secrets = [draw(ALPHABETS[i % 4], (24, 32, 40, 64)[i // 4 % 4]) for i in range(160)]
    plain = PLAIN + [x for x in (look_alike(rng) for _ in range(900)) if len(x) >= 20][:600]
    texts = [s for i, s in enumerate(secrets)] + plain
    rows = spark.createDataFrame([(10**6 + i, f"see {s} there") for i, s in enumerate(texts)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(rows)
    got = {r["doc_id"]: [s["body"] for s in r["spans"] if KINDS[s["kind"]] == "random"] for r in scan_secrets(docs, stride=8).collect()}
    return secrets, plain, {s: s in got[10**6 + i] for i, s in enumerate(texts)}


def test_random_strings_are_found(planted):
    secrets, _, reported = planted
    for length in (24, 32, 40, 64):
        own = [s for s in secrets if len(s) == length]
        assert sum(reported[s] for s in own) >= (0.7 if length == 24 else 0.9) * len(own), length


def test_false_discoveries_are_controlled(planted):
    secrets, plain, reported = planted
    wrong = [p for p in plain if reported[p]]
    assert len(wrong) <= 0.05 * len(plain), wrong
    assert len(wrong) <= 0.1 * sum(reported.values()), wrong
    assert not [p for p in PLAIN if reported[p]]


def test_rest_of_a_run_beside_a_base_span(spark, sf_dir):
    rng = random.Random(9)
    tail = "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz23456789") for _ in range(48))
    rows = [(10**6, "x " + "0123456789abcdef" * 2 + tail + " y")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = scan_secrets(docs, stride=8).where("doc_id = 1000000").first()["spans"]
    assert [(KINDS[s["kind"]], s["start"], s["stop"]) for s in spans] == [("hex", 2, 34), ("random", 34, 82)]


def test_places_of_very_many_matches(spark):
    texts = ["password=abcdef12 " * n for n in (1, 255, 256, 257, 1000)]
    for r in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert [(s["start"], s["stop"]) for s in r["base"]] == [(18 * i, 18 * i + 17) for i in range(len(texts[r["doc_id"]]) // 18)]
