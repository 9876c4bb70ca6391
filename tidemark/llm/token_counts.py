"""Token counts of a byte-level BPE, from pre-tokens counted once.

A text falls into pre-tokens (words, numbers, runs of signs or of white space), none of which shares a
piece with another. So the pieces of each distinct pre-token are counted once for the whole corpus, and a
document's tokens are the sum, over its distinct pre-tokens, of frequency times pieces: no document is
tokenized and no ids are made. Three passes:

1. distinct pre-tokens with their occurrences, combined within tasks before the shuffle;
2. the pieces of each of them (`vocabulary`, a written table);
3. each document's pre-token frequencies, joined to these counts. The commonest pre-tokens, which are
   most occurrences and all hot keys, are joined inside the scan: HEAD of them at most, of HEAD_BYTES at
   most, so what is sent has a fixed bound. Only the rest is shuffled; pre-tokens too long for the head are
   salted, as one of them may still be common.

The special tokens of the tokenizer's file count as one token wherever their strings stand, as the library
does by default. A null text is empty: no bytes, no tokens. Rows are counted one by one, so repeated rows and
null doc_ids each keep their row. Extra columns are ignored. A tokenizer file of another kind than byte-level
BPE without normalizer is an error.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize

LIMIT = 1024
#: Pre-tokens joined inside the scan, at most, and the bytes of the longest: 16 MiB together.
HEAD, HEAD_BYTES = 1 << 16, 256
#: Rows of one pre-token that is too long for the head go to this many places.
SALTS = 16
#: A task's table of pre-tokens is handed on when it holds so many, or so many characters.
HELD, HELD_CHARS = 1 << 18, 1 << 25

# Fixed value: the published pre-token pattern of this family of tokenizers.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of the first 256 code points only, whose letters, numbers and white space are listed; most texts of Latin
#: script are such, and this form takes 0.4 of the time.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = rf" ?[{_L}]+| ?[{_N}]+|'(?:[sdmt]|ll|ve|re)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def special_strings(path: str) -> list[str]:
    """The strings of the file's added tokens, the longest first. An error if pre-tokens are not its own."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    cut = described.get("pre_tokenizer") or {}
    if described["model"]["type"] != "BPE" or described.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level BPE without normalizer")
    return sorted((t["content"] for t in described.get("added_tokens", [])), key=len, reverse=True)


def _library_cut(text: str) -> list[str]:
    from tokenizers import pre_tokenizers

    return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


@functools.cache
def disputed() -> str:
    """A character class of the code points that the tokenizers library and the regex module hold for different
    kinds of characters, as their versions of Unicode differ. All planes with letters are tried."""
    cut, found = regex.compile(PRE_TOKEN).findall, []

    def differ(points):
        text = "".join(f"a{c}1{c}!{c} " for c in map(chr, points))
        return cut(text) != _library_cut(text)

    ranges = [range(low, low + 4096) for low in [*range(0, 0x40000, 4096), 0xE0000] if not 0xD000 <= low < 0xE000] + [range(0xD000, 0xD800)]
    while ranges:
        points = ranges.pop()
        if differ(points):
            if len(points) == 1:
                found.append(points[0])
            else:
                ranges += [points[: len(points) // 2], points[len(points) // 2 :]]
    found.sort()
    edges = [i for i, c in enumerate(found) if i == 0 or found[i - 1] != c - 1] + [len(found)]
    return "".join(f"\\U{found[a]:08x}-\\U{found[b - 1]:08x}" for a, b in itertools.pairwise(edges))


class PreTokens:
    """Frequencies of a text's pre-tokens; each special string is one of them. Where a text has disputed
    characters, the library cuts it, which takes longer."""

    def __init__(self, specials: list[str], disputed: str):
        self.find, self.find_latin, self.specials = regex.compile(PRE_TOKEN).findall, re.compile(LATIN).findall, set(specials)
        self.odd = regex.compile(f"[{disputed}]").search if disputed else lambda text: None
        self.parts = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else lambda text: [text]

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _library_cut(text) if self.odd(text) else self.find(text)
        return self.find_latin(text)

    def all(self, text: str) -> list[str]:
        """The text's pre-tokens in order."""
        if not any(s in text for s in self.specials):
            return self.cut(text)
        return [t for part in self.parts(text) for t in ([part] if part in self.specials else self.cut(part))]

    def __call__(self, text: str) -> Counter:
        return Counter(self.all(text))


def _texts(batches) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of some rows at a time; a null text is empty."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield part.column("doc_id").to_pylist(), pc.fill_null(part.column("text").cast(pa.large_string()), "").to_pylist()


def _distinct(*pre: object):
    def run(batches):
        pre_tokens, held, read = PreTokens(*pre), Counter(), 0

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pre_token", "n"])

        for _, texts in _texts(batches):
            for text in texts:
                held.update(pre_tokens.all(text))
                read += len(text)
            full = len(held) > HELD
            if read > HELD_CHARS:  # the table can't hold more characters than were read
                read, full = 0, full or sum(map(len, held)) > HELD_CHARS // 2
            if full:
                yield handed()
                held.clear()
                read = 0
        yield handed()

    return run


def _pieces(path: str):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # a pre-token stays whole
        for batch in batches:
            pieces = [len(e) for low in range(0, batch.num_rows, 1024) for e in tokenizer.encode_batch_fast(batch.column("pre_token").slice(low, 1024).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["pre_token", "n", "pieces"])

    return run


def _documents(head, *pre: object):
    def run(batches):
        pre_tokens, pieces_of = PreTokens(*pre), head.value.get
        for doc_ids, texts in _texts(batches):
            n_bytes, in_head, rest, frequencies, ends = [], [], [], [], [0]
            for text in texts:
                tokens = 0
                for t, n in pre_tokens(text).items():
                    pieces = pieces_of(t)
                    if pieces is None:
                        rest.append(t)
                        frequencies.append(n)
                    else:
                        tokens += n * pieces
                n_bytes.append(len(text.encode()))
                in_head.append(tokens)
                ends.append(len(rest))
            beyond = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(frequencies, pa.int64())], names=["pre_token", "n"])
            columns = [pa.array(doc_ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(in_head, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), beyond)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "in_head", "rest"])

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> pre_token, n (occurrences), pieces: each distinct pre-token once. A written table."""
    specials = special_strings(path)
    found = docs.mapInArrow(_distinct(specials, disputed()), "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return materialize(found.mapInArrow(_pieces(path), "pre_token string, n long, pieces long"))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, one row for each of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = vocabulary(docs, path)
    common = counted.where(F.octet_length("pre_token") <= HEAD_BYTES).orderBy(F.desc("n"), "pre_token").limit(head)
    sent = spark.sparkContext.broadcast({r["pre_token"]: r["pieces"] for r in common.select("pre_token", "pieces").collect()})

    rows = docs.mapInArrow(_documents(sent, special_strings(path), disputed()), "doc_id long, n_bytes long, in_head long, rest array<struct<pre_token: string, n: bigint>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    long = F.octet_length("pre_token") > HEAD_BYTES
    left = rows.select("row", F.explode("rest").alias("p")).select("row", "p.*").withColumn("salt", F.when(long, F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(0))
    right = counted.select("pre_token", "pieces", F.explode(F.when(long, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    beyond = left.join(right, ["pre_token", "salt"]).groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("beyond_head"))
    n_tokens = F.col("in_head") + F.coalesce("beyond_head", F.lit(0))
    out = rows.select("row", "doc_id", "n_bytes", "in_head").join(beyond, "row", "left")
    return out.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
