"""What lines cost: they are built, and searched for their headers, once."""

import time

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.tokens import FIELD, pairs_of
from tidemark.operators import events as E
from tidemark.operators import staple as ST
from tidemark.operators import syscalls as S
from tidemark.operators.process_tree import ancestor_paths, build_tree, chains
from tidemark.operators.storage import save
from tidemark.operators.taint import taint_flows
from tidemark.plans.bindings import audit_events, audit_lines, log_lines
from tidemark.sources.logs import line_class


def test_bound_lines_are_written(spark, sf_dir):
    """A plan over lines that are built anew has the text of a record in every predicate."""
    for lines in (audit_lines(spark, sf_dir), log_lines(spark, sf_dir)):
        plan = lines.where(F.col("value").contains("x") & F.col("value").contains("y"))._jdf.queryExecution().optimizedPlan().toString()
        assert "arch=c000003e" not in plan and "PAM:bad_ident" not in plan


def test_danger_is_read_from_written_events(spark, sf_dir):
    """Who doesn't ask for danger doesn't pay for it, and the patterns aren't in the plan that types events."""
    events, _ = E.events_of_lines(audit_lines(spark, sf_dir), S.syscall_dimension(spark))
    assert "authorized_keys" not in events.drop("danger")._jdf.queryExecution().optimizedPlan().toString()
    assert "authorized_keys" in events._jdf.queryExecution().optimizedPlan().toString()


def test_open_ids_leave_in_order_at_once():
    """The oldest of many open ids is found without a walk over those that went."""
    import pyarrow as pa

    n = 120_000
    batch = pa.record_batch({"host": [""] * n, "audit_id": [str(i) for i in range(n)], "epoch": [1.0] * n, "file": ["f"] * n, "line_no": list(range(n)), "value": ["x"] * n, "record_type": ["CWD"] * n})
    began = time.process_time()
    out = [x for b in ST._in_blocks(1 << 16)([batch]) for x in b.column("audit_id").to_pylist()]
    assert out == [str(i) for i in range(n)] and time.process_time() - began < 30


def test_short_cuts_give_what_the_patterns_give(spark):
    lines = ["", " ", "\u00a0", "a", " a", "a\u3000", "\u2003a b\t", "# x", " \u00a0#", "a #", "a\n", "\n\n", "type=X msg=audit(1.0:2): a=b c=\"d e\" ", "x\x1cy\x1f", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    plain = F.regexp_replace("v", T.U + r"^\s+|\s+$", "")
    empty = (plain == "") | plain.startswith("#")
    want_class = F.when(F.col("v").isNull() | empty, "blank").when(F.col("v").contains("type=") | F.col("v").contains("msg=audit("), "record").otherwise("error")
    pairs = [(T.strip(F.col("v")), plain), (T.strip_end(F.col("v")), F.regexp_replace("v", T.U + r"\s+$", "")), (line_class(F.col("v")), want_class)]
    for got, want in pairs:
        assert df.where(~got.eqNullSafe(want)).collect() == []
    for body in ["a=b c=d", 'a="x y" b=(c d) e', "a=\x0bb\x0cc=d\re=f", "a=b\x1cc=d\x1fe=f", 'k="a\\"b" z=1', "=x a==b"]:
        assert pairs_of("h): " + body) == FIELD.findall(body)


def test_command_lines_are_cut_once(spark, sf_dir):
    """No plan of a fixpoint's round or of flows cuts command lines into words again."""
    events = save(audit_events(spark, sf_dir))
    tree = save(build_tree(events))
    flows = taint_flows(events, save(chains(tree, ancestor_paths(tree, save))))
    assert "split(" not in flows._jdf.queryExecution().optimizedPlan().toString() and flows.count() > 0
