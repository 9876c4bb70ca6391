"""System calls as a dimension table: (arch_table, nr) to name and kind.

The built-in rows are the calls whose kind matters. The rest of the kernel's names, which only label
events, come from its files of calls, given as a parameter, or from the records themselves where the audit
daemon has written them (its enriched format).
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.syscall_table import TABLES

# Architecture tokens of audit records, and the table of each.
ARCHITECTURES = {"c000003e": "x86_64", "40000003": "i386", "c00000b7": "aarch64", "40000028": "aarch64"}
# Kinds of calls by name.
KINDS = {
    "exec": "execve execveat",
    "file": "open openat openat2 creat close read pread64 readv preadv preadv2 write writev pwrite64 pwritev pwritev2 truncate ftruncate unlink unlinkat rename renameat renameat2 "
    "chmod fchmod fchmodat chown fchown lchown fchownat symlink symlinkat link linkat mkdir mkdirat rmdir mknod mknodat setxattr lsetxattr fsetxattr removexattr lremovexattr "
    "fremovexattr copy_file_range sendfile splice tee vmsplice fallocate mmap mmap2 msync mremap shmget shmat",
    "file-meta": "stat lstat fstat fstatat newfstatat statx statfs fstatfs access faccessat faccessat2 readlink readlinkat getdents getdents64 getcwd chdir fchdir lseek dup dup2 dup3 "
    "fcntl fcntl64 ioctl flock fsync fdatasync sync syncfs umask utimensat utimes futimesat",
    "net-connect": "connect",
    "net-accept": "accept accept4",
    "net-send": "sendto sendmsg sendmmsg",
    "net-recv": "recvfrom recvmsg recvmmsg",
    "socket": "socket socketpair bind listen shutdown getsockname getpeername setsockopt getsockopt",
}

KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}

_DEFINED = re.compile(r"^\s*#\s*define\s+__NR(?:3264)?_(\w+)\s+(\d+)\b", re.MULTILINE)
_LISTED = re.compile(r"^(\d+)\s+\w+\s+(\w+)", re.MULTILINE)


def kernel_calls(path: str) -> dict[int, str]:
    """Numbers and names of a kernel's file of calls: a header's `#define __NR_name number` lines, or a table's lines
    of number, interface and name. Of two names for a number the first in order counts; a file of neither kind is an error."""
    text = Path(path).read_text()
    pairs = [(name, int(number)) for name, number in _DEFINED.findall(text)] or [(name, int(number)) for number, name in _LISTED.findall(text)]
    if not pairs:
        raise ValueError(f"{path} names no system calls")
    found: dict[int, str] = {}
    for name, number in sorted(pairs):
        if name not in ("syscalls", "arch_specific_syscall"):
            found.setdefault(number, name)
    return found


def syscall_dimension(spark: SparkSession, calls: dict[str, str] | None = None) -> DataFrame:
    """(arch_table, nr, name, syscall_kind): the calls whose kind matters, the same on every machine, and the names of all
    others from the kernel's files of calls that are given by table; kinds follow from the names."""
    rows = {(table, int(number)): name for table, text in TABLES.items() for number, name in map(str.split, text.strip().splitlines())}
    for table, path in (calls or {}).items():
        rows = {(table, number): name for number, name in kernel_calls(path).items()} | rows
    schema = "arch_table string, nr string, name string, syscall_kind string"
    return spark.createDataFrame([(table, str(number), name, KIND_OF.get(name, "other")) for (table, number), name in sorted(rows.items())], schema)


def classify(name: str):
    """The kind of a call's name, `other` if it has none of interest."""
    out = F.lit("other")
    for kind, names in KINDS.items():
        out = F.when(F.col(name).isin(*names.split()), kind).otherwise(out)
    return out


def arch_table(arch: str):
    out = F.lit(None).cast("string")
    for token, table in ARCHITECTURES.items():
        out = F.when(F.col(arch) == token, table).otherwise(out)
    return out


def with_syscall(df: DataFrame, dimension: DataFrame, arch: str = "arch", nr: str = "syscall_nr") -> DataFrame:
    """Adds syscall_name and syscall_kind, null for an unknown architecture or number. The dimension is
    broadcast: a kernel has a few hundred calls per architecture."""
    dim = dimension.withColumnsRenamed({"arch_table": "dim_table", "nr": "dim_nr", "name": "syscall_name"})
    number = F.regexp_replace(F.coalesce(F.col(nr).try_cast("int").cast("string"), F.lit("")), "^-.*$", "")
    return df.join(F.broadcast(dim), (arch_table(arch) == F.col("dim_table")) & (number == F.col("dim_nr")), "left").drop("dim_table", "dim_nr")
