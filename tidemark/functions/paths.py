"""Predicates on paths and command lines: sensitivity, noise, danger and kinds of sensitive data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import U, ascii_lower, basename, bind
from tidemark.schemas import TAINT_KINDS

# Parts of paths (lower case) that are of interest whatever the noise rules say.
SENSITIVE = [
    ".aws/credentials", ".config/gcloud", ".azure/", ".kube/config", "/.ssh/", "id_rsa", "id_ed25519", "id_ecdsa", ".ssh/authorized_keys", ".gnupg", ".kdbx", ".env",
    ".bash_history", ".mysql_history", "/etc/shadow", "/etc/passwd", "/etc/sudoers", "/etc/cron", "/etc/systemd/system", "cookies", "login-data", ".p12", ".pfx",
]
# Prefixes of paths that carry no data.
NOISE = ["/proc/", "/sys/", "/dev/", "/run/", "/var/run/", "/tmp/.X11-unix/", "/usr/lib/locale/", "/etc/ld.so.cache", "/usr/lib/", "/lib/", "/usr/share/"]
# Dangerous programs by name.
DANGER_PROGRAMS = {
    "shred": "secure file wipe", "wipefs": "disk signature wipe", "blkdiscard": "disk discard", "useradd": "user/group change", "userdel": "user/group change", "usermod": "user/group change",
    "groupadd": "user/group change", "groupdel": "user/group change", "passwd": "password change", "chpasswd": "password change", "visudo": "sudoers change", "setenforce": "SELinux mode change",
    "insmod": "kernel module insert", "auditctl": "audit config change",
}
# Dangerous commands, as (pattern, label); AT is where a command can begin.
AT = r"(?:^|[;|&]\s*|\b(?:sudo|xargs|env)\s+|\s-c\s+)"
DANGER_PATTERNS = [
    (AT + r"rm\s+(?:-\S+\s+)*(?:-[a-zA-Z]*r|--recursive\b)", "recursive rm"),
    (AT + r"(?:useradd|userdel|usermod|groupadd|passwd|chpasswd)\b", "account/password change"),
    (r"\bmkfs(?:\.\w+)?\s", "filesystem format"),
    (r"\bdd\s[^|;&]*\bof=/dev/(?:sd|nvme|vd|hd|mmcblk)", "dd to raw disk"),
    (r"(?:curl|wget|fetch)\s[^|]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh|python[0-9.]*|perl|ruby)(?:\s|$)", "pipe download to interpreter"),
    (r"\b(?:base64|xxd|openssl enc)\b[^|]*\|\s*(?:sh|bash)(?:\s|$)", "decode then execute"),
    (r"/dev/(?:tcp|udp)/[\w.\-]+/\d+", "shell network socket"),
    (r"\b(?:nc|ncat|netcat)\s[^|;]*\s-[a-zA-Z]*e[a-zA-Z]*\s", "netcat with -e"),
    (r"/etc/sudoers\b", "sudoers change"),
    (r"/etc/(?:shadow|gshadow)\b", "credential file access"),
    (r"\bauthorized_keys\b", "authorized_keys change"),
    (r"\bsetenforce\s+0\b|\bselinux=0\b|\benforcing=0\b", "SELinux disabled"),
    (r"\b(?:iptables|ip6tables)\s[^|;]*?(?:-F\b|--flush\b)|\bnft\s+flush\b", "firewall flush"),
    (r"\bauditctl\s+-e\s*0\b|\bpkill\s+\S*auditd\b|\bservice\s+auditd\s+stop\b", "auditd disabled"),
    (r"\bauditctl\b", "audit config change"),
    (r"/etc/audit\b", "audit config file touched"),
    (r"\bhistory\s+-c\b|\bunset\s+HISTFILE\b|>\s*\S*\.bash_history\b", "shell history cleared"),
    (r"(?:>|truncate\s[^;|]*|rm\s[^;|]*)\s*/var/log/", "log files wiped"),
    (r"\bcrontab\s+-r\b", "crontab removed"),
    (r"\bsudo\s+(?:-i|-s|su|bash|sh)(?:\s|$)|\bsudo\s+-u\s+root\s+(?:sh|bash)\b", "root shell via sudo"),
    (r"\b(?:tar|zip|7z)\b[^|;]*\s(?:.*)(?:\.aws|\.ssh|/etc/|\.kube|\.gnupg)", "archive of sensitive scope"),
]
#: For each pattern parts of which one stands in every text that it matches: a plain search for these is much cheaper, and
#: the pattern is tried on what is left. Where a text has none, no pattern runs on it.
DANGER_PARTS = [
    ("rm",), ("useradd", "userdel", "usermod", "groupadd", "passwd"), ("mkfs",), ("of=/dev/",), ("curl", "wget", "fetch"), ("base64", "xxd", "openssl enc"), ("/dev/tcp/", "/dev/udp/"), ("nc", "netcat"), ("/etc/sudoers",),
    ("shadow",), ("authorized_keys",), ("setenforce", "selinux=0", "enforcing=0"), ("tables", "nft"), ("audit",), ("auditctl",), ("/etc/audit",), ("history", "HISTFILE"), ("/var/log/",), ("crontab",), ("sudo",), ("tar", "zip", "7z"),
]
# Folders that everybody can write to, tools that change the user, and endings of archives.
WORLD_WRITABLE = ["/tmp/", "/dev/shm/", "/var/tmp/"]
ESCALATION_TOOLS = ["sudo", "su", "sudo-rs", "doas"]
ARCHIVES = [".tar", ".tar.gz", ".tgz", ".zip", ".7z"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def holds(c: Column, parts: list[str]) -> Column:
    return any_of([c.contains(p) for p in parts])


def starts(c: Column, prefixes: list[str]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def ends(c: Column, suffixes: list[str]) -> Column:
    return any_of([c.endswith(p) for p in suffixes])


def is_sensitive(path: Column) -> Column:
    """Any of the parts, whatever the case of ASCII letters: one pattern, instead of a search per part."""
    return path.rlike("(?i)" + "|".join(re.escape(p) for p in SENSITIVE))


@dataclass(frozen=True)
class NoiseConfig:
    """Which paths are noise: all is kept with include_noise; `extra` prefixes are added to the built-in ones or, with replace, used alone."""

    include_noise: bool = False
    extra: tuple[str, ...] = ()
    replace: bool = False

    def is_excluded(self, path: Column) -> Column:
        """Named by the operator: beats sensitivity."""
        return F.lit(False) if self.include_noise else starts(path, list(self.extra))

    def is_noise(self, path: Column) -> Column:
        if self.include_noise:
            return F.lit(False)
        if self.replace:
            return starts(path, list(self.extra))
        return starts(path, [*self.extra, *NOISE]) | ends(path, [".so", "ld.so.cache"]) | path.contains(".so.")


def danger_labels(exe: Column, cmdline: Column, *more: Column) -> Column:
    """Sorted distinct reasons why a command looks dangerous; `more` are reasons of the caller's own, null where they don't apply.
    They are joined here, as a second copy of the patterns in a plan makes a method that the JVM doesn't compile."""
    both, base = F.concat_ws(" ", cmdline, exe), basename(exe)
    program = F.lit(None).cast("string")
    for name, label in reversed(DANGER_PROGRAMS.items()):
        program = F.when(base == name, label).otherwise(program)
    program = F.when(base.isin(*DANGER_PROGRAMS), program).when(base.startswith("mkfs"), "filesystem format")
    found = [program, *[F.when(holds(both, list(parts)) & both.rlike(U + p), label) for (p, label), parts in zip(DANGER_PATTERNS, DANGER_PARTS, strict=True)], F.when(starts(exe, WORLD_WRITABLE), "binary in world-writable dir"), *more]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def source_kinds(path: Column) -> Column:
    """Kinds of sensitive data that a path is a source of, as sorted places in TAINT_KINDS."""
    return bind(ascii_lower(path), _source_kinds)


def _source_kinds(p: Column) -> Column:
    # Parts and endings of paths by kind.
    kinds = {
        "credentials": holds(p, ["/id_rsa", "/id_ed25519", ".ssh/authorized_keys", "/.ssh/control", "/ssh-agent"]) | ends(p, [".pem", ".gnupg"]) | (p.contains(".env") & ~p.contains("/proc/")),
        "crypto-key": ends(p, [".kdbx", ".p12", ".pfx"]) | holds(p, [".gnupg/", "/keystore"]),
        "session-token": holds(p, ["cookies", "/login-data", ".mozilla/", ".config/google-chrome"]),
        "cloud-credentials": holds(p, [".aws/credentials", ".config/gcloud", ".azure/", ".kube/config"]),
        "database-dump": p.endswith(".sql") | p.contains(".mysql/history") | (p.contains("dump") & p.endswith(".gz")),
        "personal-data": p.contains(".csv") & holds(p, ["customer", "user", "klient"]),
    }
    return F.array_compact(F.array(*[F.when(kinds[k], F.lit(i)) for i, k in enumerate(TAINT_KINDS)]))


def is_network_sink(target: Column) -> Column:
    return target.contains(":")


def is_archive(target: Column) -> Column:
    return ends(ascii_lower(target), ARCHIVES)


def carrier_tokens(cmdline: Column) -> Column:
    """Words of a command line that are paths of sources."""
    return F.filter(F.split(cmdline, U + r"\s+"), lambda t: t.contains("/") & (F.size(source_kinds(t)) > 0))
