"""Detection rules on single events, as one narrow projection: each event yields a finding per rule that holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import holds
from tidemark.functions.text import ascii_lower
from tidemark.schemas import CRITICAL, HIGH, LOW, MEDIUM


@dataclass(frozen=True)
class Rule:
    """cases: (predicate, detail) in order; the first that holds gives the finding's detail."""

    id: str
    title: str
    severity: int
    cases: Callable[[], list[tuple[Column, str]]]

    def detail(self) -> Column:
        out = F.lit(None).cast("string")
        for test, detail in reversed(self.cases()):
            out = F.when(test, detail).otherwise(out)
        return out


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _low(name: str) -> Column:
    return ascii_lower(F.col(name))


def _reverse_shell() -> list[tuple[Column, str]]:
    c = F.col("cmdline")
    tools = holds(c, ["/dev/tcp/", "mkfifo", "nc -e", "ncat -e", "socat EXEC"]) & c.contains("&")
    return [(c.contains("sh") & (tools | (c.contains("/dev/tcp/") & c.contains("bash"))), "classic reverse-shell primitives (bash /dev/tcp, mkfifo, nc -e) in argv")]


def _escalation() -> list[tuple[Column, str]]:
    tool = F.col("exe").endswith("/sudo") | F.col("exe").endswith("/su") | F.col("cmdline").startswith("sudo ")
    return [(_is("exec") & tool & (F.col("uid") != 0), "privilege escalation binary executed by non-root user")]


def _ssh_key() -> list[tuple[Column, str]]:
    t = _low("target")
    return [(_is("file") & t.contains("/.ssh/") & (t.endswith("id_rsa") | t.endswith("id_ed25519") | t.contains("authorized_keys")), "process read private/authorized SSH key material")]


def _cloud() -> list[tuple[Column, str]]:
    return [(_is("file") & holds(_low("target"), [".aws/credentials", ".config/gcloud", ".kube/config"]), "cloud provider credential store touched")]


def _raw_address() -> list[tuple[Column, str]]:
    host = F.substring_index("target", ":", 1)
    return [(_is("net-connect") & F.col("success") & host.rlike(r"^[0-9.]+\z") & host.contains("."), "direct IP connection (bypasses DNS logging)")]


def _persistence() -> list[tuple[Column, str]]:
    return [
        (_is("file") & holds(_low("target"), ["/etc/cron", "/etc/systemd/system", "/.ssh/authorized_keys"]), "persistence location written"),
        (_is("exec") & holds(_low("cmdline"), ["crontab", "systemctl enable", "systemctl link"]), "persistence mechanism registered"),
    ]


def _wiped() -> list[tuple[Column, str]]:
    return [(_is("file") & holds(_low("target"), ["/.bash_history", "/var/log/"]) & holds(_low("cmdline"), ["> ", "truncate", "shred", "echo -n"]), "log or shell history appears truncated/wiped")]


def _dump() -> list[tuple[Column, str]]:
    c = _low("cmdline")
    return [(_is("exec") & (holds(c, ["mysqldump", "pg_dump"]) | (c.contains("sqlite3") & c.contains(".dump"))), "database dump command executed")]


def _archive() -> list[tuple[Column, str]]:
    c = _low("cmdline")
    return [(_is("exec") & holds(c, ["tar ", "zip ", "7z "]) & holds(c, [".aws", ".ssh", "/etc/", "home"]), "archive command covers sensitive paths")]


# Ids, titles and severities, and the detail texts above.
RULES = [
    Rule("LT001", "Reverse shell pattern in command line", CRITICAL, _reverse_shell),
    Rule("LT002", "Privilege escalation attempt (sudo/su from non-root session)", HIGH, _escalation),
    Rule("LT003", "User account created", HIGH, lambda: [(_is("user-add"), "new local account created")]),
    Rule("LT004", "SSH key material accessed", MEDIUM, _ssh_key),
    Rule("LT005", "Cloud credentials file accessed", MEDIUM, _cloud),
    Rule("LT006", "Outbound connection to raw IP (no hostname resolution)", LOW, _raw_address),
    Rule("LT007", "Cron/service persistence modified", HIGH, _persistence),
    Rule("LT008", "History/log file truncated (anti-forensics)", MEDIUM, _wiped),
    Rule("LT009", "Database dump created", MEDIUM, _dump),
    Rule("LT010", "Archive of sensitive scope created", MEDIUM, _archive),
]
DENIED = ("ESC-001", "Privilege escalation attempted and denied", HIGH)


def findings(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings with `ord` (phase, pos, rule's place), their order: rules by event, then denied escalations."""
    found = []
    rules = RULES if rules is None else rules

    def row(phase: int, place: int, rule_id: str, title: str, severity: int, detail: Column) -> Column:
        return F.struct(F.struct(F.lit(phase).alias("phase"), F.col("pos"), F.lit(place).alias("place")).alias("ord"), F.lit(rule_id).alias("rule_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), detail.alias("detail"))

    for place, rule in enumerate(rules):
        found.append(F.when(rule.detail().isNotNull(), row(0, place, rule.id, rule.title, rule.severity, rule.detail())))
    denied = F.concat(F.lit("execve succeeded (kernel loaded the binary) but the same-pid PAM check was rejected: `"), F.col("cmdline"), F.lit("`"))
    found.append(F.when(F.col("auth") == "failed", row(1, 0, *DENIED, denied)))
    fanned = events.withColumn("f", F.explode(F.array_compact(F.array(*found))))
    return fanned.select("f.ord", "f.rule_id", "f.title", "f.severity", "seq", "pid", "exe", "f.detail", F.array().cast("array<string>").alias("taints"))


def confirm_taints(found: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings with the sorted kinds that reached a sink in their process; without any, as they were."""
    kinds = flows.groupBy(F.col("sink_pid").alias("tainted_pid")).agg(F.array_sort(F.collect_set("taint.kind")).alias("kinds"))
    return found.join(kinds, F.col("pid") == F.col("tainted_pid"), "left").withColumn("taints", F.coalesce("kinds", "taints")).drop("tainted_pid", "kinds")
