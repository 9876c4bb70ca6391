"""Records of one audit id become one row, inside the block of the file where they stand.

The records of an id are neighbours in a log, so nearly all ids begin and end in one block. Each task joins the records of
its own block, with a bounded number of open ids, and writes a row per id: no record is shuffled for it. Then only the
hashes of ids are exchanged, to find those that have several rows: ids open at a block's edge, ids that another block or file
has too, and ids that were handed on early. The records of these alone are shuffled and joined by `events.staple`,
which is exact for any order. On scattered logs that are all ids, and this plan is the other one.

A null line is no record. Repeated lines and columns beside file, line_no and value change nothing: a repeated line stands in `raw`
as often as in the log. Extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tokens import argument_line, flat_lists, pairs_of, values_of
from tidemark.operators.events import PICKED, parse_records, staple
from tidemark.operators.storage import save

#: Ids that a task holds open.
MOST_OPEN = 1 << 14

_AT = "struct<file: string, line_no: bigint>"
_PICKS = [f"s_{name}" for name in PICKED]
_OTHERS = {"PATH": ("name", "path_name"), "PROCTITLE": ("proctitle", "proctitle"), "SOCKADDR": ("saddr", "saddr")}
_TEXTS = [*_PICKS, *(column for _, column in _OTHERS.values())]
#: The columns of `events.staple`.
STAPLED = ["host", "audit_id", "epoch", "first_at", "has_syscall", "has_execve", *_TEXTS, "argv_line", "raw"]
_SCHEMA = (
    f"host string, audit_id string, epoch double, first_at {_AT}, has_syscall boolean, has_execve boolean, {', '.join(c + ' string' for c in _TEXTS)}, "
    "argv_line string, lines array<struct<file: string, line_no: bigint, value: string>>"
)
_ITEM = pa.struct([("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])


def _row(key: tuple[str, str], epoch: float, records: list[tuple]) -> tuple:
    """records: (file, line_no, value, record_type) of one id."""
    records.sort(key=lambda r: r[:2])
    kinds = {r[3] for r in records}
    picks, argv = dict.fromkeys(_TEXTS), []
    for _, _, value, kind in records:
        if kind == "SYSCALL":
            fields = dict(pairs_of(value))
            for name, field in PICKED.items():
                if field in fields:
                    picks[f"s_{name}"] = fields[field]
        elif kind == "EXECVE":
            argv += pairs_of(value)
        elif kind in _OTHERS:
            field, column = _OTHERS[kind]
            picks[column] = dict(pairs_of(value)).get(field, picks[column])
    return (*key, epoch, records[0][:2], "SYSCALL" in kinds, "EXECVE" in kinds, *picks.values(), argument_line(argv), [r[:3] for r in records])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["host", "audit_id", "epoch", "first_at", "has_syscall", "has_execve", *_TEXTS, "argv_line", "lines"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    offsets, items = flat_lists(columns[-1])
    arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())]
    first = [pa.array([x[0] for x in columns[3]], pa.string()), pa.array([x[1] for x in columns[3]], pa.int64())]
    arrays += [pa.StructArray.from_arrays(first, names=["file", "line_no"]), pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.bool_())]
    arrays += [pa.array(c, pa.string()) for c in columns[6:-1]]
    parts = [pa.array([x[i] for x in items], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
    arrays.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_ITEM))))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _in_blocks(most_open: int):
    def run(batches):
        held: OrderedDict[tuple[str, str], tuple[float, list]] = OrderedDict()  # a plain dict searches for its first key past all that went
        for batch in batches:
            done = []
            columns = [values_of(batch.column(c)) for c in ("host", "audit_id", "epoch", "file", "line_no", "value", "record_type")]
            for host, audit_id, epoch, *record in zip(*columns, strict=True):
                key = (host, audit_id)
                if key not in held:
                    if len(held) >= most_open:
                        oldest, own = held.popitem(last=False)
                        done.append(_row(oldest, *own))
                    held[key] = (epoch, [])
                held[key][1].append(tuple(record))
            if done:
                yield _batch(done)
        rest = list(held.items())
        for at in range(0, len(rest), 4096):
            yield _batch([_row(key, *own) for key, own in rest[at : at + 4096]])

    return run


def staple_lines(lines: DataFrame, most_open: int = MOST_OPEN) -> DataFrame:
    """lines (file, line_no, value) of class exec with their headers, as `events.headed_records` gives them -> the rows of `events.staple`."""
    rows = lines.select("host", "audit_id", "epoch", "file", "line_no", "value", "record_type").mapInArrow(_in_blocks(most_open), _SCHEMA)
    rows = save(rows.withColumn("id_hash", F.xxhash64("host", "audit_id")))
    several = save(rows.groupBy("id_hash").count().where("count > 1").select("id_hash"))
    whole = rows.join(several, "id_hash", "left_anti").where("has_syscall")
    whole = whole.withColumn("raw", F.transform("lines", lambda x: x["value"])).select(STAPLED)
    if several.isEmpty():
        return whole
    parted = rows.join(several, "id_hash", "left_semi").select(F.explode("lines").alias("l")).select("l.*")
    return whole.unionByName(staple(parse_records(parted)).select(STAPLED))
