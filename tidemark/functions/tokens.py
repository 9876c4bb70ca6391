"""The field tokenizer of audit records inside Arrow batches: the same pairs as `functions.text.record_entries`.

A record is cut by one compiled pattern; pairs and fields are built as flat Arrow columns, without a row of Python objects.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Unicode white space. Python's own class has the separators 1C to 1F too.
SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIELD = re.compile(rf'([^{SPACE}=]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\([^)]*\)|[^{SPACE}]+)')
#: The same pattern for ASCII text, where a class is one small table.
ASCII_FIELD = re.compile(r'([^ \t-\r=]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\([^)]*\)|[^ \t-\r]+)')
HEADER_END = re.compile(rf"\):[{SPACE}]*")
HEX = re.compile("[0-9A-Fa-f]+")
ARGUMENT = re.compile(r"a([0-9]{1,9})(?:\[([0-9]{1,9})\])?")
PAM = re.compile(r"\bmsg='([^']*)'")


def pairs_of(line: str) -> list[tuple[str, str]]:
    """All pairs of a record: the body's parts between group separators, then the inside of msg='...'."""
    end = HEADER_END.search(line)
    body = line[end.end() :] if end else line
    pattern = ASCII_FIELD if body.isascii() else FIELD
    found = pattern.findall(body) if "\x1d" not in body else [p for part in body.split("\x1d") for p in pattern.findall(part)]
    inside = PAM.search(body) if "msg='" in body else None
    return found + pattern.findall(inside[1]) if inside else found


def argument_text(value: str) -> str:
    """`functions.text.decode` of one argument, with NUL bytes kept."""
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return value[1:-1]
    if value in ("(null)", "(none)", "?"):
        return ""
    return bytes.fromhex(value).decode("utf-8", "replace") if len(value) % 2 == 0 and HEX.fullmatch(value) else value


def argument_line(pairs: list[tuple[str, str]]) -> str:
    """`functions.text.command_line`: the arguments in order, each whole or from its chunks."""
    whole: dict[int, list[str]] = {}
    chunks: dict[int, list[tuple[int, str]]] = {}
    for key, value in dict(pairs).items():
        if place := ARGUMENT.fullmatch(key):
            if place[2]:
                chunks.setdefault(int(place[1]), []).append((int(place[2]), argument_text(value)))
            else:
                whole.setdefault(int(place[1]), []).append(argument_text(value))
    shown = lambda i: "".join(text for _, text in sorted(chunks[i])) if i in chunks else max(whole[i])
    return " ".join(shown(i) for i in sorted(whole.keys() | chunks.keys()))


def values_of(column: pa.Array) -> list:
    """`to_pylist` of a flat column, by way of numpy where it has no nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def flat_lists(rows: list) -> tuple[pa.Array, list]:
    """Offsets of the rows' items, and all items."""
    return pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), list(itertools.chain.from_iterable(rows))


def pair_lists(rows: list[list[tuple[str, str]]]) -> pa.ListArray:
    offsets, items = flat_lists(rows)
    names = [pa.array([x[i] for x in items], pa.string()) for i in range(2)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(names, names=["k", "v"]))


def _batches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pairs_of(v) for v in values_of(batch.column("value"))]
        offsets, items = flat_lists([list(dict(pairs).items()) for pairs in rows])  # of a repeated key the last stays
        fields = pa.MapArray.from_arrays(offsets, pa.array([x[0] for x in items], pa.string()), pa.array([x[1] for x in items], pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pair_lists(rows), fields], names=[*batch.schema.names, "pairs", "fields"])


def with_fields(records: DataFrame) -> DataFrame:
    """records (value, ...), no value null, with pairs and fields (the last value of each key)."""
    more = StructType.fromDDL("pairs array<struct<k: string, v: string>>, fields map<string, string>")
    return records.mapInArrow(_batches, StructType([*records.schema.fields, *more.fields]))
