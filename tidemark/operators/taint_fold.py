"""Taint by one pass in order: the state of a stream, and the way when carriers are capped.

Used per host in the stream, and to check the relational form. Only events of the kinds that taint
reads need to be passed, in order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tidemark.schemas import TAINT_KINDS

CARRIER_CAP = 4096


def source_ranks(path: str) -> set[int]:
    p = path.translate({u: u + 32 for u in range(65, 91)})
    has = lambda *parts: any(x in p for x in parts)
    tests = (
        has("/id_rsa", "/id_ed25519", ".ssh/authorized_keys", "/.ssh/control", "/ssh-agent") or p.endswith((".pem", ".gnupg")) or (has(".env") and not has("/proc/")),
        p.endswith((".kdbx", ".p12", ".pfx")) or has(".gnupg/", "/keystore"),
        has("cookies", "/login-data", ".mozilla/", ".config/google-chrome"),
        has(".aws/credentials", ".config/gcloud", ".azure/", ".kube/config"),
        p.endswith(".sql") or has(".mysql/history") or (has("dump") and p.endswith(".gz")),
        has(".csv") and has("customer", "user", "klient"),
    )
    return {i for i, t in enumerate(tests) if t}


@dataclass
class TaintState:
    """carriers keep their order of arrival; the oldest goes, with its origin, when there are more than cap."""

    cap: int = CARRIER_CAP
    carriers: dict[str, set[int]] = field(default_factory=dict)
    origins: dict[str, int] = field(default_factory=dict)
    held: dict[int, set[int]] = field(default_factory=dict)
    label: dict[int, str] = field(default_factory=dict)

    def to_json(self) -> str:
        """The state as text; carriers keep their order."""
        kinds = lambda held: [[key, sorted(k)] for key, k in held.items()]
        return json.dumps({"carriers": kinds(self.carriers), "origins": list(self.origins.items()), "held": kinds(self.held), "label": list(self.label.items())})

    @classmethod
    def from_json(cls, text: str, cap: int = CARRIER_CAP) -> TaintState:
        d = json.loads(text)
        sets = lambda rows: {key: set(k) for key, k in rows}
        return cls(cap, sets(d["carriers"]), dict(d["origins"]), sets(d["held"]), dict(d["label"]))

    def stain(self, path: str, kinds: set[int], pid: int) -> None:
        self.carriers.setdefault(path, set()).update(kinds)
        while len(self.carriers) > self.cap:
            oldest = next(iter(self.carriers))
            del self.carriers[oldest]
            self.origins.pop(oldest, None)
        self.origins.setdefault(path, pid)

    def keep_pids(self, live: set[int]) -> None:
        self.held = {p: k for p, k in self.held.items() if p in live}
        self.label = {p: x for p, x in self.label.items() if p in live}

    def step(self, pid: int, ppid: int, kind: str, target: str, cmdline: str) -> list[tuple[int, str, str, int]]:
        """Apply one successful event; the flows it makes as (kind rank, sink kind, carrier, origin)."""
        if kind == "exec":
            self.label.pop(pid, None)
            got = set(self.held.get(ppid, ()))
            for token in re.split(r"[^\S\x1c-\x1f]+", cmdline):
                direct = source_ranks(token) if "/" in token else set()
                if direct:
                    got |= self.carriers.get(token, set()) | direct
                    self.stain(token, direct, pid)
            if got:
                self.held.setdefault(pid, set()).update(got)
            return []
        if kind == "file":
            direct = source_ranks(target)
            if direct:
                self.stain(target, direct, pid)
                self.held.setdefault(pid, set()).update(direct)
                self.stain(target, self.held[pid], pid)
            elif self.carriers.get(target):
                self.held.setdefault(pid, set()).update(self.carriers[target])
            elif pid in self.held:
                self.stain(target, self.held[pid], pid)
            else:
                return []
            self.label[pid] = target
            low = target.translate({u: u + 32 for u in range(65, 91)})
            if direct or not low.endswith((".tar", ".tar.gz", ".tgz", ".zip", ".7z")):
                return []
            return [(k, "archive-write", target, self.origins.get(target, pid)) for k in sorted(self.held[pid])]
        if kind in ("net-connect", "net-send", "net-accept") and ":" in target:
            carrier = self.label.get(pid, "")
            origin = self.origins.get(carrier, pid)
            sink = "net-accept" if kind == "net-accept" else "net-exfil"
            return [(k, sink, carrier, origin) for k in sorted(self.held.get(pid) or self.held.get(ppid) or ())]
        return []


def fold(events: list[dict], state: TaintState | None = None) -> list[dict]:
    """Flows of events in order (failed ones are skipped), without chains."""
    state = state or TaintState()
    out = []
    for e in events:
        if e["success"]:
            for rank, sink, carrier, origin in state.step(e["pid"], e["ppid"], e["kind"], e["target"], e["cmdline"]):
                out.append({"pos": e["pos"], "kind": TAINT_KINDS[rank], "kind_rank": rank, "sink_pid": e["pid"], "origin_pid": origin, "sink_seq": e["seq"], "sink_kind": sink, "sink_target": e["target"], "carrier": carrier})
    return out
