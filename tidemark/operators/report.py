"""Sinks: text tables, terminal report, JSON, JSON lines and SARIF. Incidents and report rows are few
and are brought to the driver; event tables stay DataFrames of finished cells."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.events import auth_failure_groups
from tidemark.operators.hosts import PIDS
from tidemark.operators.incidents import graph_layers, numbered
from tidemark.schemas import SEVERITIES, severity_label

TOOL, VERSION, PREFIX = "tidemark", "0.1.0", "TIDEMARK"
# The event table's columns and their widths.
COLUMNS = {"#": 6, "type": 10, "time": 19, "exe": 26, "commandline": 44, "key": 16, "result": 10, "uid": 16, "pid": 8, "ppid": 8}
_COLORS = ("\x1b[90m", "\x1b[36m", "\x1b[33m", "\x1b[31m", "\x1b[1;31m")
_DIM, _RESET = "\x1b[2m", "\x1b[0m"


def cell(c: Column, width: int | Column) -> Column:
    flat = F.translate(c, "\t\n", "  ")
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, F.lit(1), width - 1), F.lit("…"))).otherwise(F.rpad(flat, width, F.lit(" ")))


def flagged(events: DataFrame) -> DataFrame:
    return events.where((F.size("danger") > 0) | (F.col("auth") == "failed"))


def event_cells(events: DataFrame) -> DataFrame:
    """pos and the ten texts of each event's table row."""
    number = F.concat(F.when(F.size("danger") > 0, "! ").otherwise(""), F.col("seq").cast("string"))
    result = F.when(F.col("auth") == "failed", "auth failed").when(F.col("success"), "success").otherwise("failed")
    user = F.when(F.col("uid_name") == "", F.col("uid").cast("string")).otherwise(F.concat(F.col("uid").cast("string"), F.lit(" ("), F.col("uid_name"), F.lit(")")))
    values = [number, F.col("kind"), F.col("ts"), F.col("exe"), F.col("cmdline"), F.col("audit_key"), result, user, F.col("pid").cast("string"), F.col("ppid").cast("string")]
    return events.select("pos", *[v.alias(n) for n, v in zip(COLUMNS, values, strict=True)])


def event_lines(events: DataFrame, flagged_only: bool = False, full: bool = False) -> DataFrame:
    """(pos, line): the rows of the table, cells cut to their widths; with full, to the longest cell."""
    cells = event_cells(flagged(events) if flagged_only else events)
    widths = dict(COLUMNS)
    if full:
        longest = cells.agg(*[F.max(F.length(n)).alias(n) for n in COLUMNS]).first()
        widths = {n: max(longest[n] or 0, len(n)) for n in COLUMNS}
    return cells.select("pos", F.concat_ws(" | ", *[cell(F.col(n), w) for n, w in widths.items()]).alias("line"))


def _header(names: Iterable[str], widths: Iterable[int]) -> list[str]:
    names, widths = list(names), list(widths)
    return [" | ".join(n.ljust(w) if len(n) <= w else n[: w - 1] + "…" for n, w in zip(names, widths, strict=True)), "-" * (sum(widths) + 3 * (len(names) - 1))]


def event_table(events: DataFrame, flagged_only: bool = False, full: bool = False) -> Iterator[str]:
    """The lines of the table, a partition at a time on the driver."""
    rows = (r["line"] for r in event_lines(events, flagged_only, full).orderBy("pos").toLocalIterator())
    widths = list(COLUMNS.values())
    top = next(rows, None)
    if full:
        widths = [len(x) for x in top.split(" | ")] if top is not None and top.count(" | ") == 9 else widths if top is not None else [len(n) for n in COLUMNS]
    yield from _header(COLUMNS, widths)
    if top is not None:
        yield top
        yield from rows
    dangerous = events.where(F.size("danger") > 0).count()
    if dangerous and not flagged_only:
        yield from ("", f"{dangerous} flagged (potentially dangerous) event(s)")


def event_header() -> list[str]:
    return _header(COLUMNS, COLUMNS.values())


def auth_table(failures: DataFrame) -> str:
    names = ["acct", "from", "via", "reason", "count", "first", "last"]
    groups = auth_failure_groups(failures).orderBy("acct", "source", "reason", "exe").collect()
    rows = [[g["acct"] or "-", g["source"], g["exe"].rsplit("/", 1)[-1], g["reason"], str(g["failures"]), g["first"], g["last"]] for g in groups]
    widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    total = sum(g["failures"] for g in groups)
    lines = [" | ".join(c.replace("\t", " ").replace("\n", " ").ljust(w) for c, w in zip(r, widths, strict=True)) for r in rows]
    return "\n".join(["", f"AUTH FAILURES  ({total} total, {len(rows)} distinct source(s))", *_header(names, widths), *lines]) + "\n"


def stats(events: DataFrame, found: DataFrame, flows: DataFrame, incidents: DataFrame) -> str:
    """One line of four numbers, counted in one job."""
    what = ("events ingested", "rule signals", "taint flows", "incidents")
    tagged = reduce(DataFrame.unionAll, [df.select(F.lit(i).alias("i")) for i, df in enumerate((events, found, flows, incidents))])
    counts = {r["i"]: r["count"] for r in tagged.groupBy("i").count().collect()}
    return " · ".join(f"{counts.get(i, 0)} {name}" for i, name in enumerate(what))


def incident_rows(incidents: DataFrame) -> list[dict]:
    """As JSON objects, in order; empty edges are left out."""
    rows = []
    for r in incidents.orderBy(F.desc("severity"), "root").collect():
        row = r.asDict(recursive=True)
        row.pop("root")
        if not row.get("host"):
            row.pop("host", None)
        row["severity"] = SEVERITIES[row["severity"]]
        if not row["edges"]:
            row.pop("edges")
        rows.append(row)
    return rows


def as_json(incidents: DataFrame, stats_line: str) -> str:
    return json.dumps({"tool": TOOL, "version": VERSION, "stats": stats_line, "incidents": incident_rows(incidents)}, indent=2, ensure_ascii=False)


def json_lines(incidents: DataFrame) -> DataFrame:
    """(root, value): one JSON object per incident."""
    return incidents.select("root", F.to_json(F.struct("title", severity_label(F.col("severity")).alias("severity"), "actors", "chain", "findings", "taints", "carriers", "seq_from", "seq_to", "summary", "edges")).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity >= 3, "error").when(severity >= 1, "warning").otherwise("note")


def sarif_results(incidents: DataFrame) -> DataFrame:
    """One row per incident with its id, level and message."""
    own = numbered(incidents)
    return own.select("incident_no", F.format_string(f"{PREFIX}-INC-%03d", "incident_no").alias("rule_id"), sarif_level(F.col("severity")).alias("level"), "title", F.concat("summary", F.lit(" ["), "chain", F.lit("]")).alias("message"), severity_label(F.col("severity")).alias("severity"), "actors", "taints", "carriers")


def as_sarif(incidents: DataFrame) -> str:
    rows = [r.asDict(recursive=True) for r in sarif_results(incidents).orderBy("incident_no").collect()]
    rules = [{"id": r["rule_id"], "shortDescription": {"text": r["title"]}, "defaultConfiguration": {"level": r["level"]}} for r in rows]
    results = [{"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "properties": {k: r[k] for k in ("severity", "actors", "taints", "carriers")}} for r in rows]
    run = {"tool": {"driver": {"name": TOOL, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def terminal(incidents: DataFrame, stats_line: str) -> str:
    title = f"  {TOOL} — incident report".ljust(58)
    out = ["", "┌" + "─" * 58 + "┐", "│" + title + "│", "└" + "─" * 58 + "┘", "", f"{_DIM}{stats_line}{_RESET}", ""]
    rows = incident_rows(incidents)
    if not rows:
        return "\n".join([*out, "  \x1b[32m✓ No incidents correlated.\x1b[0m"]) + "\n"
    for i, r in enumerate(rows):
        out.append(f"{_COLORS[SEVERITIES.index(r['severity'])]}[{r['severity'].upper():>8}] {r['title']}{_RESET}")
        shown = [("chain", r["chain"]), ("signals", ", ".join(r["findings"])), ("taint", ", ".join(r["taints"])), ("carriers", ", ".join(r["carriers"])), ("scope", f"seq {r['seq_from']}–{r['seq_to']}"), ("summary", r["summary"])]
        out += [f"  {_DIM}{(name + ':').ljust(10)}{_RESET}{value}" for name, value in shown if value or name not in ("taint", "carriers")]
        if i + 1 < len(rows):
            out.append("")
    return "\n".join(out) + "\n\n"


def graph_text(incidents: DataFrame, tree: DataFrame, hops: DataFrame, root: int, width: int = 120) -> str:
    """One incident's actors by layer with their flows, then the hops that no ancestry explains."""
    own = incidents.where(F.col("root") == root)
    row = own.first()
    if row is None:
        return ""
    host = root - root % PIDS
    names = {r["pid"] - host: r["exe"] for r in tree.where(F.col("pid").isin([host + p for p in row["actors"]])).select("pid", "exe").collect()}
    node = lambda p: f"{names[p].rsplit('/', 1)[-1]}({p})" if names.get(p) else f"pid {p}"
    out = [f"{row['title']} [{SEVERITIES[row['severity']].upper()}]", ""]
    for layer in graph_layers(own).orderBy("depth").collect():
        for i, pid in enumerate(layer["pids"]):
            branch = "├─" if i + 1 < len(layer["pids"]) else "└─"
            flows = "".join(f"  ╌╌▶ {e['label'] or 'sink'}" for e in row["edges"] if e["edge_kind"] == "flow" and e["from_pid"] == pid)
            out.append("  " * layer["depth"] + f"{branch} {node(pid)}{flows}")
    far = hops.where(F.col("root") == root).orderBy("from_pid", "to_pid", "label").collect()
    if far:
        out += ["", "carrier-mediated hops (cross-tree):"] + [f"  {node(h['from_pid'])} ╌[{h['label'] or 'file'}]╌▶ {node(h['to_pid'])}" for h in far]
    if row["carriers"]:
        out += ["", "carriers: " + ", ".join(row["carriers"])]
    return "\n".join(x[:width] for x in out) + "\n"
