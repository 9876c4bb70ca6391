"""python -m tidemark LOG: analyze a log and print a report. Exit status: 2 with incidents, 1 without events, else 0."""

from __future__ import annotations

import argparse
import contextlib
import signal
import sys
import threading
import time
import uuid

from pyspark.sql import SparkSession

from tidemark.functions.paths import NoiseConfig
from tidemark.operators import report as R
from tidemark.operators.incidents import at_least
from tidemark.operators.storage import save, scratch
from tidemark.plans.analysis import analyze_jsonl, analyze_log
from tidemark.schemas import SEVERITIES


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("input", help="path of a log, anything that Spark reads, or - for standard input")
    p.add_argument("--jsonl", action="store_true", help="the input is normalized JSON lines")
    p.add_argument("-f", "--format", choices=["terminal", "json", "sarif"], default="terminal")
    p.add_argument("--plain", action="store_true", help="print the event table instead of incidents")
    p.add_argument("--full", action="store_true", help="with --plain: don't cut cells")
    p.add_argument("--flagged", action="store_true", help="with --plain: flagged events only")
    p.add_argument("-F", "--follow", action="store_true", help="go on with lines that are appended; ends at an interrupt")
    p.add_argument("--state", metavar="FOLDER", help="with --follow: keep the state in this shared folder and go on from it; else it starts afresh")
    p.add_argument("--seconds", type=int, help="with --follow: end after so many seconds, behind the lines that are there by then")
    p.add_argument("--out", metavar="FOLDER", help="with --follow: write incidents there as JSON lines, each batch once, and print none")
    p.add_argument("--include-noise", action="store_true")
    p.add_argument("--exclude", action="append", default=[], metavar="PREFIX")
    p.add_argument("--replace-noise", action="store_true")
    p.add_argument("--calls", action="append", default=[], metavar="TABLE=FILE", help="names of further system calls: a kernel's header or table of calls, for x86_64, i386 or aarch64")
    p.add_argument("--window", type=int, default=200_000, help="events that --follow retains")
    p.add_argument("-m", "--min-severity", choices=SEVERITIES, default="low")
    return p.parse_args(argv)


def stop_signal() -> threading.Event:
    """Set at an interrupt or a request to end, where signals can be caught."""
    event = threading.Event()
    for number in (signal.SIGINT, signal.SIGTERM):
        with contextlib.suppress(ValueError):  # not the main thread
            signal.signal(number, lambda *_: event.set())
    return event


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    noise = NoiseConfig(a.include_noise, tuple(a.exclude), a.replace_noise)
    least = SEVERITIES.index(a.min_severity)
    calls = dict(x.split("=", 1) for x in a.calls)
    if a.follow:
        from tidemark.streaming.session import StreamSession, follow
        from tidemark.streaming.sinks import IncidentFiles

        folder = a.state.rstrip("/") if a.state else f"{scratch(spark)}/follow-{uuid.uuid4().hex}"
        lines = lambda rows: [print(r[0], flush=True) for r in rows.toLocalIterator()]
        incidents = lambda df, _: lines(R.json_lines(at_least(df, least)).select("value"))
        table = lambda df, _: lines(R.event_lines(df, a.flagged).orderBy("pos").select("line"))
        if a.plain:
            print("\n".join(R.event_header()), flush=True)
        emit = IncidentFiles(a.out, least) if a.out else None if a.plain else incidents
        session = StreamSession(spark, f"{folder}/state", emit=emit, emit_events=table if a.plain else None, window=a.window, noise=noise, calls=calls)
        query = follow(spark, a.input, session, f"{folder}/checkpoint", start="begin")
        stopped = stop_signal()
        until = None if a.seconds is None else time.monotonic() + a.seconds
        while query.isActive and not stopped.wait(0.2):
            if until is not None and time.monotonic() > until:
                query.processAllAvailable()
                break
        failed = query.exception()
        query.stop()
        if failed is not None:
            raise failed
        if query.lastProgress is not None:
            session.metrics.wait_for(query.lastProgress["batchId"], 5)
        session.flush()
        print(f"{session.metrics.summary()} · {session.evicted()} evicted", file=sys.stderr)
        return 0
    found = analyze_jsonl(spark, a.input) if a.jsonl else analyze_log(spark, a.input, noise=noise, calls=calls)
    if found.events.isEmpty():
        print("no events", file=sys.stderr)
        return 1
    if a.plain:
        for line in R.event_table(found.events, a.flagged, a.full):
            print(line)
        if found.auth_failures is not None and not found.auth_failures.isEmpty():
            print(R.auth_table(found.auth_failures), end="")
        return 0
    shown = save(at_least(found.incidents, least))
    stats = R.stats(found.events, found.findings, found.flows, shown)
    print({"terminal": lambda: R.terminal(shown, stats), "json": lambda: R.as_json(shown, stats), "sarif": lambda: R.as_sarif(shown)}[a.format]())
    return 0 if shown.isEmpty() else 2


if __name__ == "__main__":
    sys.exit(main())
