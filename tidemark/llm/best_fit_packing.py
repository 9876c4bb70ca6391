"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents longer than a sequence are cut into full-length pieces, which need no packing; only the
last, shorter piece of each document is packed. Short pieces are dealt by a hash of their document
into packing shares of a bounded number of tokens, and each share is packed online in one streamed
pass: a fixed number of open bins is kept in a bitset keyed by free space, a piece goes to the open
bin with the least sufficient space, and when no bin fits and all are open the fullest closes.
A task holds the open bins only, never its share.

A null text is an empty document (only the end token). Ties of hash are broken by doc_id; rows may
repeat, each is packed for itself. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize

SEQUENCE = 2048
OPEN_BINS = 1024
#: Tokens of a packing share: about 8,192 sequences, so that bins left open at its end are few.
SHARE_TOKENS = 1 << 24
#: Chunks of text whose ids a Python worker remembers; beyond it starts afresh.
CACHE_CHUNKS = 800_000


class ChunkTokenizer:
    """Ids of a text as the ids of its chunks between ASCII white space, each encoded once.

    Right for tokenizers that lower-case, split at white space and drop it, and part a run of
    punctuation from the letters before it. Chunks that aren't known yet are encoded together,
    parted by a special token; texts with the beginning of one are encoded as they are."""

    #: A run of points and commas behind a word: told from it, so that words are known with or without.
    TAIL = re.compile(rb"(?<=[a-z0-9])[.,]+(?=[ \n])")

    def __init__(self, path: str, parting: str = "<|endoftext|>", beginning: bytes = b"<|"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parting, self.beginning = tokenizer.encode_batch_fast, parting, beginning
        self.parting_id = tokenizer.token_to_id(parting)
        self._forget()

    def _forget(self) -> None:
        self.places: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)  # a chunk's place in the table
        self.flat, self.starts, self.lengths, self.held = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _learn(self, chunks: list[bytes]) -> None:
        """Adds the ids of chunks, in order, to the table."""
        groups = [chunks[at : at + 64] for at in range(0, len(chunks), 64)]
        encoded = self.encode([self.parting.encode().join(g).decode() for g in groups], add_special_tokens=False)
        flats, lengths = [self.flat], [self.lengths]
        for e in encoded:
            ids = np.array(e.ids, "<u4")
            edges = np.concatenate([[-1], np.flatnonzero(ids == self.parting_id), [len(ids)]])
            lengths.append(np.diff(edges) - 1)
            flats.append(ids[ids != self.parting_id])
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held += sum(map(len, chunks))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.places) > CACHE_CHUNKS or self.held > 32 * CACHE_CHUNKS:
            self._forget()
        odd = [i for i, t in enumerate(texts) if self.beginning in t]
        split = [self.TAIL.sub(rb" \g<0>", t.lower()).split() for t in texts]
        for i in odd:
            split[i] = []
        known = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        if len(self.places) > known:
            self._learn(list(itertools.islice(self.places, known, None)))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) for c in split])])]
        out = [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i, e in zip(odd, self.encode([texts[i].decode() for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def _pieces(path: str, end_id: int, length: int):
    end = np.array([end_id], "<u4").tobytes()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = ChunkTokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            doc_ids = batch.column("doc_id").to_pylist()
            for low in range(0, len(texts), 1024):
                rows = []
                for doc_id, ids in zip(doc_ids[low:], tokenizer.ids(texts[low : low + 1024].to_pylist()), strict=False):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=columns)

    return run


class OpenBins:
    """At most `most` open bins, as one bitset of the free spaces that occur and a stack of bins for each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.bits = capacity, most, 0, 0
        self.at: dict[int, list] = {}

    def _put(self, free: int, number: int) -> None:
        if free:
            self.at.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        stack = self.at[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int, fresh: int) -> tuple[int, int]:
        """(bin, offset) for a piece; `fresh` names a new bin should one be opened."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, fresh
        self._put(free - length, number)
        return number, self.capacity - free


def _pack(capacity: int, most: int):
    """Rows (share, length, ...) sorted by share -> the same with bin and offset."""

    def run(batches):
        share, bins, fresh = None, None, 0
        for batch in batches:
            numbers, offsets = [], []
            for own, length in zip(batch.column("share").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != share:
                    share, bins, fresh = own, OpenBins(capacity, most), 0
                number, offset = bins.place(length, fresh)
                fresh += number == fresh
                numbers.append(number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "bin", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, share_tokens: int = SHARE_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(cut.mapInArrow(_pieces(tokenizer_path, end_id, sequence), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    full = pieces.where(F.col("length") == sequence).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < sequence)
    tokens = short.agg(F.sum("length")).first()[0] or 0
    shares = max(1, round(tokens / share_tokens))
    order = F.xxhash64("doc_id", "ids_crc32", "piece")
    dealt = short.withColumn("share", F.pmod(order, F.lit(shares)).cast("int")).repartition("share").sortWithinPartitions("share", order, "doc_id")
    packed = dealt.mapInArrow(_pack(sequence, open_bins), dealt.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", bin long, offset long")
    packed = packed.withColumn("sequence_id", F.col("bin") * shares + F.col("share")).drop("share", "bin")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(columns).unionByName(packed.select(columns))


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), _path())


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, _path())
