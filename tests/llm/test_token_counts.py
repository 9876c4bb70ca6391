"""Token counts against the library, which tokenizes whole texts."""

import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts as C
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, doc_id, text):
    n = len(library.encode(text or "", add_special_tokens=False))
    return (doc_id, len((text or "").encode()), n, n > 1024)


def test_op12(spark, any_dir, docs_of, library):
    got = [tuple(r) for r in QUERIES["op12_token_counts"](spark, any_dir).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted([wanted(library, i, t) for i, t, *_ in docs_of(any_dir)], key=repr)


TEXTS = [
    None, "", " ", "\n\n", "  a", "a  ", "\t\ta b", "don't WE'LL it's 'tis '' 's", "x" * 3000 + " y", "=" * 700, "a<|endoftext|>b<|endoftext|><|endoftext|> c", " <|endoftext|> ", "<|endoftext", "12345 6 ½ Ⅷ ²", "漢字 仮名　と", "é ‍   x",
    "new letters ՘࢏ \U00010940\U000323b0 end", "\U0001f600\U0001f468‍\U0001f469", "a\r\n\r\n b", "﻿x\x00\x1c\x1f\x85y", "line next ᠎",
]


@pytest.mark.parametrize("head", [0, 7, C.HEAD])
def test_heads_of_every_size_give_the_same(spark, library, head):
    """Also with long pre-tokens, which are salted, with repeated rows and with columns whose names clash."""
    rows = [(i % 9, t, "x", 1, [1], 5) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pre_token string, row long, rest array<int>, n long").repartition(3)
    got = [tuple(r) for r in C.count_tokens(docs, PATH, head=head).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted([wanted(library, r[0], r[1]) for r in rows], key=repr)


def test_a_text_of_five_megabytes(spark, library):
    text = "".join(f"word{i} and {i * 7919 % 10007}, " for i in range(260_000))
    assert len(text) > 5_000_000
    began = time.time()
    got = [tuple(r) for r in C.count_tokens(spark.createDataFrame([(1, text), (2, "-" * 200_000)], "doc_id long, text string"), PATH, limit=10**6).select(COLUMNS).orderBy("doc_id").collect()]
    assert got[0][:3] == wanted(library, 1, text)[:3] and got[0][3] and got[1][:3] == wanted(library, 2, "-" * 200_000)[:3]
    assert time.time() - began < 120


def test_each_distinct_pre_token_is_counted_once(spark):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog")], "doc_id long, text string")
    assert sorted(tuple(r) for r in C.vocabulary(docs, PATH).collect()) == [(" cat", 2, 1), (" dog", 1, 1), (" the", 1, 1), ("the", 2, 1)]


def test_characters_of_all_kinds(library):
    """Every code point next to a letter, a digit and a sign, as the library counts it."""
    pre = C.PreTokens(C.special_strings(PATH), C.disputed())
    latin = [chr(c) for c in range(256)]
    for text in ["".join(f"a{c}1{c}!{c}{d} '{c}" for c in latin) for d in latin]:
        assert pre.all(text) == C._library_cut(text)
    for low in range(0, 0x40000, 2048):
        text = "".join(f"a{c}1{c}!{c} " for c in map(chr, range(low, low + 2048)) if not "\ud800" <= c <= "\udfff")
        assert sum(pre(text).values()) == len(C._library_cut(text))


def test_other_kinds_of_files_are_errors():
    with pytest.raises(ValueError, match="byte-level"):
        C.special_strings(public_tokenizers.path("word_bpe_49k.json"))
