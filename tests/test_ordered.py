"""Line rules against plain loops: on shuffled rows, with both scan plans."""

import random

import brute
import pytest

from gistline import schema
from gistline.operators import ordered as O
from gistline.operators.scan import WINDOW, BlockScan, run_ordered

STATES = [
    {"name": "a", "enter": "^A", "keep": ["A", "x"], "drop": ["xx"]},
    {"name": "b", "enter": "B", "keep": [], "drop": ["y"]},
    {"name": "c", "enter": "^A", "keep": ["z"]},
]

RULES = {
    "dedup": (lambda d, o: O.dedup_adjacent(d, o), brute.dedup),
    "collapse_repeated": (
        lambda d, o: O.collapse_repeated(d, "x", "[... {count} x ...]", 3, o),
        lambda s: brute.collapse_repeated(s, "x", "[... {count} x ...]", 3)),
    "collapse_between": (
        lambda d, o: O.collapse_between(d, "^A|T", "^B|T", "[... {count} in ...]", o),
        lambda s: brute.collapse_between(s, "^A|T", "^B|T", "[... {count} in ...]")),
    "head": (lambda d, o: O.head(d, 4, o), lambda s: brute.head(s, 4)),
    "tail": (lambda d, o: O.tail(d, 4, o), lambda s: brute.tail(s, 4)),
    "head_after": (lambda d, o: O.head_after(d, 2, "B", o), lambda s: brute.head_after(s, 2, "B")),
    "tail_before": (lambda d, o: O.tail_before(d, 2, "B", o), lambda s: brute.tail_before(s, 2, "B")),
    "state_machine": (lambda d, o: O.state_machine(d, STATES, o), lambda s: brute.state_machine(s, STATES)),
    "truncate_to": (lambda d, o: O.truncate_to(d, 23, o), lambda s: brute.truncate_to(s, 23)),
    "envelope": (lambda d, o: O.head_tail_envelope(d, 3, 2, o), lambda s: brute.envelope(s, 3, 2)),
    "envelope_head": (lambda d, o: O.head_tail_envelope(d, 3, 0, o), lambda s: brute.envelope(s, 3, 0)),
    "envelope_tail": (lambda d, o: O.head_tail_envelope(d, 0, 3, o), lambda s: brute.envelope(s, 0, 3)),
    "chain": (
        lambda d, o: O.dedup_adjacent(O.collapse_between(O.collapse_repeated(
            d, "x", "[... {count} x ...]", 2, o), "A", "B", "[... {count} in ...]", o), o),
        lambda s: brute.dedup(brute.collapse_between(
            brute.collapse_repeated(s, "x", "[... {count} x ...]", 2), "A", "B", "[... {count} in ...]"))),
}


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(7)
    pool = ["x", "xx", "A", "B", "T", "é", "y", "z", "A x", ""]
    return {
        f"s{i}": [(rng.choice(pool), rng.random() < 0.1) for _ in range(rng.randint(1, 25))]
        for i in range(80)
    }


@pytest.fixture(scope="module")
def lines(spark, sessions):
    rows = [(s, i, 0, t, p) for s, ls in sessions.items() for i, (t, p) in enumerate(ls)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schema.LINES).repartition(5).cache()


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.line_no, r.sub_no)):
        out.setdefault(r.session_id, []).append((r.text, r.is_placeholder))
    return out


@pytest.mark.parametrize("name", RULES)
def test_rule_matches_loops(name, lines, sessions):
    rule, loop = RULES[name]
    want = {s: loop(ls) for s, ls in sessions.items()}
    want = {s: ls for s, ls in want.items() if ls}
    assert want != sessions
    assert collected(rule(lines, WINDOW)) == want


@pytest.mark.parametrize("name", RULES)
def test_block_plan_matches_loops(name, lines, sessions):
    rule, loop = RULES[name]
    want = {s: loop(ls) for s, ls in sessions.items()}
    got = collected(rule(lines, BlockScan(parts=4)))
    assert got == {s: ls for s, ls in want.items() if ls}


def test_mixed_plan_is_exact(lines, sessions):
    rule, loop = RULES["chain"]
    got = collected(run_ordered(lines, rule, max_lines=12, parts=5))
    assert got == {s: loop(ls) for s, ls in sessions.items()}


def test_block_plan_on_sparse_numbers_and_null_sessions(spark):
    base = 1_760_000_000_000_000_000
    rows = [(s, base + i * 1_000_003, 0, i) for s in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, line_no long, sub_no int, x long")
    from gistline.operators.scan import prev, running
    from pyspark.sql import functions as F

    out = BlockScan(parts=7).scan(df, prev("before", F.col("x")), running("n", F.lit(1))).collect()
    assert len(out) == 600
    assert all(r.n == r.x + 1 and r.before == (r.x - 1 if r.x else None) for r in out)


LARGE = {
    "ndjson": ["", '{"a": 1}', '{"a": "[x"}', '[2, "\\\\"]'], "log": ["[INFO] up", "2026-01-02 03:04:05 DEBUG x", "debug: y", "[12:30:01] z"],
    "log2": ["[2024-01-02 10:00] a b", "info: c", "debug: d"], "diff": ["[x]", "--- a", "+++ b", "@@ -1 +1 @@"],
    "stack_trace": ["{ oops", "Traceback (most recent call last):", " in it"], "tabular": ["[1] a", "[2] b", "[3] c"],
    "plain": ["[ERROR] down", "up again now"], "open": ["{", '"a": [1, 2],', '"b": {}'], "two": ["[1", "]", "[2", "]"], "wide": ["[1 2", "]"],
}
DOCUMENT = ["  {", '"a \\" [b": [1, -2.5e3, true,', "", ' "thread \'main\' panicked at {"],', '"c": {"d": null}', "}", " "]


@pytest.mark.parametrize("order", [WINDOW, BlockScan(parts=5)])
def test_line_tables_have_the_class_of_their_texts(spark, order):
    from gistline.functions.formats import with_format
    from gistline.operators.formats import detect_format_lines

    every = {**LARGE, "json": DOCUMENT, "empty": [""], None: ["[", "]"], "twice": ['{"a":1,', '"a":2}'], "nbsp": ["\u00a0[1]"], "late": ["[1]\u00a0"]}
    rows = [(s, i, 0, x) for s, ls in every.items() for i, x in enumerate(ls)]
    df = spark.createDataFrame(rows, "session_id string, line_no long, sub_no int, text string")
    texts = spark.createDataFrame([(s, "\n".join(ls)) for s, ls in every.items()], "session_id string, text string")
    got = {r.session_id: r.format for r in detect_format_lines(df, order).collect()}
    assert got == {r.session_id: r.format for r in with_format(texts).collect()}
    assert all(got[f] == f for f in ("ndjson", "log", "diff", "stack_trace", "tabular", "plain", "json")) and got["log2"] == "log"
    assert all(got[f] == "plain" for f in ("open", "two", "wide", "late")) and all(got[f] == "json" for f in (None, "twice", "nbsp"))


def test_debug_lines_of_a_log_that_starts_with_a_bracket_are_dropped(spark):
    from gistline.plans import queries_tables, reduce

    rows = [("s", i, 0, x, False, "none") for i, x in enumerate(LARGE["log2"])]
    df = spark.createDataFrame(rows, "session_id string, line_no long, sub_no int, text string, is_placeholder boolean, fingerprint string")
    out = reduce.reduce_lines(df, queries_tables.one_rule_set(spark, [{"kind": "dedup"}]))
    assert [x for x, _ in collected(out)["s"]] == ["[2024-01-02 10:00] a b", "info: c"]
