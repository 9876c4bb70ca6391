"""The batch plan: lines or events in, findings, flows and incidents out, all lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import NoiseConfig
from tidemark.operators import events as E
from tidemark.operators.hosts import keyed, number_hosts, with_host
from tidemark.operators.incidents import correlate
from tidemark.operators.process_tree import ancestor_paths, build_tree, chains
from tidemark.operators.rules import Rule, confirm_taints, findings
from tidemark.operators.storage import save
from tidemark.operators.syscalls import syscall_dimension
from tidemark.operators.taint import taint_flows
from tidemark.operators.taint_fold import CARRIER_CAP
from tidemark.sources.logs import parse_jsonl, read_lines, split_lines


@dataclass(frozen=True)
class Analysis:
    events: DataFrame
    tree: DataFrame
    paths: DataFrame
    chains: DataFrame
    findings: DataFrame
    flows: DataFrame
    incidents: DataFrame
    errors: DataFrame | None = None
    auth_failures: DataFrame | None = None


def analyze(events: DataFrame, rules: list[Rule] | None = None, exec_clears_taint: bool = False, confirm: bool = False, carrier_cap: int | None = None, errors: DataFrame | None = None, auth_failures: DataFrame | None = None) -> Analysis:
    """events with pos, their order, and maybe host: pids in tree, paths, chains, findings and flows are then numbers over
    all hosts (operators/hosts.py), incidents name theirs. confirm: findings also list the kinds that their process leaked.
    carrier_cap: so many tainted paths are remembered per host; None for all, analyze_log and analyze_jsonl keep CARRIER_CAP."""
    hosts = save(number_hosts(events)) if "host" in events.columns else None
    given, events = events, events if hosts is None else keyed(events, hosts)
    tree = save(build_tree(events))
    paths = save(ancestor_paths(tree, save))
    lines = save(chains(tree, paths))
    found = findings(events, rules)
    flows = save(taint_flows(events, lines, exec_clears_taint, carrier_cap))
    found = confirm_taints(found, flows) if confirm else found
    incidents = correlate(found, flows, lines)
    if hosts is not None:
        incidents = with_host(incidents, "root", hosts).orderBy(F.desc("severity"), "root")
    return Analysis(given, tree, paths, lines, found, flows, incidents, errors, auth_failures)


def analyze_lines(lines: DataFrame, noise: NoiseConfig | None = None, calls: dict[str, str] | None = None, **options) -> Analysis:
    """lines (file, line_no, value) of raw audit logs."""
    good, errors = split_lines(lines)
    events, records = E.events_of_lines(good, syscall_dimension(lines.sparkSession, calls), noise)
    return analyze(events, errors=errors, auth_failures=E.auth_failures(records), **options)


def analyze_log(spark: SparkSession, path: str, **options) -> Analysis:
    return analyze_lines(read_lines(spark, path), **{"carrier_cap": CARRIER_CAP, **options})


def analyze_jsonl(spark: SparkSession, path: str, **options) -> Analysis:
    events, errors = parse_jsonl(read_lines(spark, path))
    return analyze(save(events.drop("extra")), errors=errors, **{"carrier_cap": CARRIER_CAP, **options})
