from oracle import compare, connect
from tidemark.operators import syscalls as S
from tidemark.plans.queries import CALLS, ORACLE, QUERIES


def test_all_calls_are_named(spark, sf_dir):
    """Also those whose kind is `other`, in the query and in its SQL."""
    known = {(r["arch_table"], int(r["nr"])): (r["name"], r["syscall_kind"]) for r in S.syscall_dimension(spark, CALLS).collect()}
    assert {t: sum(k[0] == t for k in known) for t in CALLS} == {"x86_64": 375, "i386": 452, "aarch64": 327}
    assert known["x86_64", 101] == ("ptrace", "other") and known["x86_64", 11] == ("munmap", "other") and known["x86_64", 221] == ("fadvise64", "other") and known["i386", 11] == ("execve", "exec")
    rows = {r["event_id"]: r for r in QUERIES["sys_classify"](spark, sf_dir).collect()}
    tables = ["x86_64", "i386", "aarch64", None]
    assert len(rows) > 440
    for i, r in rows.items():
        assert (r["syscall_name"], r["syscall_kind"]) == known.get((tables[i % 4], i % 440), (None, None))
    assert compare(spark, connect(sf_dir), QUERIES["sys_classify"], ORACLE["sys_classify"], sf_dir) == len(rows)
