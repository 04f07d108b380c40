"""Reduce, judge and learn as whole pipelines."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import gistline.plans.reduce as R
from gistline import schema, session
from gistline.operators import account as A, bypass as B, judge as G, learn as L, lines as N, versions as V
from gistline.operators.scan import BlockScan, running
from gistline.plans.judge import judge
from gistline.plans.learn import as_profiles, learn, self_test
from gistline.session import local_frame, lookup
from gistline.sources.rulesets import RULESETS, load_profiles

SETS = {
    "one": [{"kind": "strip_ansi"}, {"kind": "keep_lines", "pattern": "a|x"}, {"kind": "dedup"}],
    "two": [{"kind": "drop_lines", "pattern": "^b"}, {"kind": "collapse_repeated", "pattern": "x", "placeholder": "[... {count} ...]"},
            {"kind": "head", "n": 6}],
    "three": [{"kind": "collapse_between", "pattern": "a", "pattern2": "b", "placeholder": "[... {count} ...]"},
              {"kind": "tail", "n": 5}],
    "four": [{"kind": "head_after", "n": 2, "pattern": "b"}, {"kind": "tail_before", "n": 1, "pattern": "b"}],
    "five": [{"kind": "state_machine", "states": [{"name": "s", "enter": "^a", "keep": ["a"], "drop": []},
                                                  {"name": "t", "enter": "^b", "keep": [], "drop": ["x"]}]},
             {"kind": "truncate_to", "bytes": 9}],
    "six": [{"kind": "ndjson_filter", "field": "k", "keep_values": ["a"]}],
    "seven": [{"kind": "json_path_keep", "paths": ["$.k"]}],
    "eight": [{"kind": "json_path_drop", "paths": ["$.k"]}],
}


def brute_rules(name, lines):
    for r in SETS[name]:
        k, p = r["kind"], r.get("pattern")
        if k == "keep_lines":
            lines = [x for x in lines if x[1] or brute.hit(x, p)]
        elif k == "drop_lines":
            lines = [x for x in lines if not brute.hit(x, p)]
        elif k == "dedup":
            lines = brute.dedup(lines)
        elif k == "collapse_repeated":
            lines = brute.collapse_repeated(lines, p, r["placeholder"], 3)
        elif k == "collapse_between":
            lines = brute.collapse_between(lines, p, r["pattern2"], r["placeholder"])
        elif k in ("head", "tail"):
            lines = getattr(brute, k)(lines, r["n"])
        elif k in ("head_after", "tail_before"):
            lines = getattr(brute, k)(lines, r["n"], p)
        elif k == "state_machine":
            lines = brute.state_machine(lines, r["states"])
        elif k == "truncate_to":
            lines = brute.truncate_to(lines, r["bytes"])
    return lines


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [{"profile_id": 10 + i, "fingerprint": fp, "version": "1", "schema": "1.0", "provenance": "synthesized",
             "status": "active", "created_at": 1, "format_claim": "plain", "rules": rules, "invariants": []}
            for i, (fp, rules) in enumerate(SETS.items())]
    return local_frame(spark, rows, schema.PROFILES)


@pytest.fixture(scope="module")
def sessions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        fp = list(SETS)[i % 5] if i < 150 else "none"
        rows.append((f"s{i}", fp, "".join(rng.choice(["a", "b", "x", "x", "ax", ""]) + "\n" for _ in range(rng.randint(0, 14)))))
    rows += [("j1", "six", '{"k":"a"}\n{"k":"b"}\n{"k":1}\nno\n'), ("j2", "seven", '{"k":\n"a","z":1}\n'),
             ("j3", "seven", "no json\n"), ("j4", "eight", '{"k":"a","z":1}\n')]
    return spark.createDataFrame(rows, "session_id string, fingerprint string, text string").repartition(4)


def expected(sessions):
    out = {}
    for s in sessions.collect():
        lines = brute.dedup([(t, False) for t in s.text.split("\n")[:-1]])
        if s.fingerprint in ("six", "seven", "eight"):
            lines = [(t, False) for t in {"j1": ['{"k":"a"}'], "j2": ['{"$.k":"a"}'], "j3": ["no json"], "j4": ['{"z":1}']}[s.session_id]]
        elif s.fingerprint in SETS:
            lines = brute_rules(s.fingerprint, lines)
        if lines:
            out[s.session_id] = lines
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.line_no, r.sub_no)):
        out.setdefault(r.session_id, []).append((r.text, r.is_placeholder))
    return out


@pytest.mark.parametrize("mode", ["literal", "broadcast", "salted"])
def test_all_rule_kinds_in_one_table(spark, profiles, sessions, mode, monkeypatch):
    if mode != "literal":
        monkeypatch.setattr(R, "PLAN_RULE_SETS", 0)
    if mode == "salted":
        monkeypatch.setattr(R, "fits_broadcast", lambda df: False)
    table = R.compile_rules(profiles)
    assert (table.known is not None) == (mode == "literal") and table.small == (mode != "salted")
    assert collected(R.reduce_sessions(sessions, table)) == expected(sessions)


def test_many_kind_sequences(spark, profiles, sessions, monkeypatch):
    monkeypatch.setattr(R, "PLAN_RULE_SETS", 0)
    monkeypatch.setattr(R, "MAX_SEQUENCES", 1)
    some = "fingerprint in ('one', 'four')"
    table = R.compile_rules(profiles.where(some))
    assert len(table.steps) == 15 and table.known is None
    assert collected(R.reduce_sessions(sessions.where(some), table)) == expected(sessions.where(some))


def test_line_tables_of_any_length(spark, profiles, sessions):
    some = "fingerprint in ('one', 'two', 'none')"
    table = R.compile_rules(profiles.where(some))
    texts = sessions.where(some)
    lines = N.explode_lines(texts, keep=("fingerprint",)).repartition(3)
    want = expected(texts)
    assert collected(R.reduce_lines(lines, table)) == want
    assert collected(R.reduce_lines(lines, table, max_lines=9, parts=4)) == want


def test_reduce_reads_the_table_once_with_one_exchange(spark, sf_dir):
    from gistline.plans.views import view

    reduced = R.reduce_sessions(view(spark, sf_dir, "tools"), R.compile_rules(load_profiles(spark)))
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("hashpartitioning") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_sizes_in_one_pass(spark, profiles, sessions):
    some = sessions.where("fingerprint not in ('six', 'seven', 'eight')")
    table = R.compile_rules(profiles.where("fingerprint in ('one', 'two', 'three', 'four', 'five')"))
    sizes = R.session_sizes(some, table)
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin")
    got = {r.session_id: (r.fingerprint, r.raw_bytes, r.compressed_bytes) for r in sizes.collect()}
    lines = expected(some)
    assert got == {s.session_id: (s.fingerprint, len(s.text.encode()),
                                  sum(len(t.encode()) + 1 for t, _ in lines.get(s.session_id, [])))
                   for s in some.collect()}
    assert any(raw and not cmp for _, raw, cmp in got.values())


def test_common_sequence_contains_all():
    kinds = [tuple(r["kind"] for r in s[3]) for s in RULESETS]
    steps = R.common_sequence(kinds)
    for k in kinds:
        R._places(k, steps)
    first_ordered = next(i for i, k in enumerate(steps) if k not in R.ONE_LINE)
    assert all(k not in R.ONE_LINE for k in steps[first_ordered:])


def test_rule_cost_and_guard(spark, profiles, sessions):
    table = R.compile_rules(profiles)
    lines = N.clean_lines(R.clean_and_dispatch(sessions, table), ("rule_key",))
    cost = R.rule_cost(lines, table).cache()
    got = {r.session_id: (r.steps, r.peak_bytes) for r in cost.collect()}
    for s in sessions.collect():
        if s.fingerprint not in ("one", "two", "three", "four"):
            continue
        now = brute.dedup([(t, False) for t in s.text.split("\n")[:-1]])
        if not now:
            continue
        steps, peak = 0, 0
        for rule in SETS[s.fingerprint]:
            peak = max(peak, sum(len(t.encode()) for t, _ in now))
            if rule["kind"] in ("head", "tail"):
                steps += min(rule["n"], len(now))
            elif rule["kind"] == "head_after":
                i = brute.first_hit(now, rule["pattern"])
                steps += len(now) if i is None else min(len(now), i + 1 + rule["n"] + 1)
            elif rule["kind"] == "tail_before":
                i = brute.first_hit(now, rule["pattern"])
                steps += len(now) if i is None else i + 1 + len(now) - max(i - rule["n"], 0)
            else:
                steps += len(now)
            SETS["tmp"] = [rule]
            now = brute_rules("tmp", now)
            peak = max(peak, sum(len(t.encode()) for t, _ in now))
        SETS.pop("tmp", None)
        assert got[s.session_id] == (steps, peak), s
    guard = R.budget_guard(cost, max_steps=20)
    assert 0 < guard.where("aborted").count() < guard.count()
    reduced = R.apply_rules(lines, table)
    out = collected(R.guarded_output(reduced, lines, guard))
    aborted = {r.session_id for r in guard.where("aborted").collect()}
    clean = collected(lines)
    assert all(out[s] == clean[s] for s in aborted)


def test_dispatch_prefers_newest_stored(spark, sessions):
    bundled = load_profiles(spark)
    own = bundled.where("fingerprint = 'psql'").withColumns({
        "profile_id": F.lit(5).cast("bigint"), "provenance": F.lit("imported"), "created_at": F.lit(9).cast("bigint"), "version": F.lit("2")})
    old = own.withColumns({"profile_id": F.lit(6).cast("bigint"), "created_at": F.lit(3).cast("bigint"), "version": F.lit("1")})
    off = own.withColumns({"profile_id": F.lit(7).cast("bigint"), "created_at": F.lit(99).cast("bigint"), "status": F.lit("quarantined")})
    table = R.compile_rules(R.choose_profiles(bundled, own.unionByName(old).unionByName(off)))
    df = spark.createDataFrame([("a", "psql"), ("b", "tsc"), ("c", "?")], "session_id string, fingerprint string")
    got = {r.session_id: (r.tier, r.profile_id, r.version) for r in R.dispatch_profile(df, table).collect()}
    assert got == {"a": ("learned", 5, "2"), "b": ("bundled", None, "1.0.0"), "c": ("format", None, None)}


def test_judge_on_bundled(spark, sf_dir):
    from gistline.plans.views import view

    sessions = view(spark, sf_dir, "tools")
    table = R.compile_rules(load_profiles(spark))
    keyed = R.dispatch_profile(sessions, table)
    reduced = R.reduce_sessions(sessions, table)
    results, subset, score = judge(keyed, reduced, table)
    failed = {r["name"] for r in results.where("not passed").collect()}
    # Only two rule sets can lose what they promise: build errors named inside a line, and
    # documents that are no JSON because prose follows.
    assert failed <= {"ErrorLinesPreserved", "JsonWellFormed"}
    assert subset.where("invented > 0").count() == 0
    assert score.where("self_fidelity <> 1").count() == 0
    raw = sessions.agg(F.sum(F.octet_length("text"))).first()[0]
    assert N.output_bytes(reduced).agg(F.sum("compressed_bytes")).first()[0] < raw


def test_structural_subset_literal(spark):
    raw = N.explode_lines(spark.createDataFrame([("s", "a  \nb\nb\n")], "session_id string, text string"), True)
    cmp = N.explode_lines(spark.createDataFrame([("s", "a\nz\nz\n\n[... x\n")], "session_id string, text string"), True)
    assert G.structural_subset(raw, cmp).first().asDict() == {
        "session_id": "s", "lines_in_raw": 2, "lines_in_compressed": 5, "invented": 2, "passed": False}


def learn_samples(spark):
    rows = [(i, "good", i, 0, f"head\nrun {i}\nrow (x)\n\nexit: 0\n") for i in range(6)]
    rows += [(10 + i, "bad", i, 0, f"head\nerror: {i}\nexit: 0\n") for i in range(6)]
    rows += [(20 + i, "same", i, 0, "a\nb\n") for i in range(3)]
    rows += [(30 + i, "few", i, 0, f"a{i}\n") for i in range(4)]
    return spark.createDataFrame(rows, schema.SAMPLES)


def test_learn_both_ways(spark):
    profiles, runs = learn(learn_samples(spark), 100)
    assert {r.fingerprint for r in profiles.collect()} == {"good", "same"}
    assert {r.fingerprint: r.outcome for r in runs.collect()} == {
        "good": "locked_in", "bad": "rejected", "same": "locked_in", "few": "accumulating"}
    keep = {p.fingerprint: p.rules[1].pattern for p in profiles.collect()}
    assert keep == {"good": r"^(exit: 0|head|row \(x\))$", "same": "^(a|b)$"}


def test_self_test_budget(spark):
    samples = learn_samples(spark).where("fingerprint = 'good'")
    learned = as_profiles(L.learn_profile(samples), 1)
    assert self_test(samples, learned).first().passed
    assert not self_test(samples, learned, max_steps=2).first().passed


def test_classify_first_sample(spark):
    got = {r.line: r["class"] for r in L.classify_lines(learn_samples(spark).where("fingerprint = 'good'")).collect()}
    assert got == {"head": "constant", "run 0": "varying", "row (x)": "constant", "": "constant", "exit: 0": "constant"}


@pytest.mark.parametrize("n, want", [(4, False), (5, True), (10, True), (15, False), (20, True), (40, True), (30, False)])
def test_doubling(spark, n, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(L.doubling_checkpoint(F.col("n"))).first()[0] is want


def test_salted_lookup_equals_broadcast(spark):
    big = spark.range(2000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(lookup(big, small, ["k"]).collect(), key=str)
    salted = lookup(big, small, ["k"], measure=False)
    assert sorted(salted.select("k", "id", "v").collect(), key=str) == plain


def near_brute(rows):
    out, ordered = {}, sorted(rows, key=lambda r: (r[2], r[0]))
    for i, r in enumerate(ordered):
        out[r[0]] = sum(b[1] == r[1] and r[2] - b[2] <= 30 for b in ordered[max(i - 3, 0):i])
    return out


def test_near_duplicates_across_blocks(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([0, 0, 7]) + i // 3 * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, fingerprint string, started_at long").repartition(6)
    got = {r.run_id: r.near_hits for r in B.near_duplicate_global(df).collect()}
    assert got == near_brute(rows) and sum(got.values()) > 10


def test_range_blocks_number_a_hot_profile(spark):
    rng = random.Random(6)
    rows = [(1 if i % 3 else 2, f"s{i}", rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "profile_id long, session_id string, at long").repartition(5)
    got = {(r.profile_id, r.session_id): r.run_no for r in B.number_runs(df).collect()}
    for p in (1, 2):
        ordered = sorted((at, s) for q, s, at in rows if q == p)
        assert [got[p, s] for _, s in ordered] == list(range(1, len(ordered) + 1))


def test_score_over_time_across_blocks(spark):
    rng = random.Random(8)
    scores = [rng.random() for _ in range(50)]
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "profile_id long, run_no long, score double")
    got = {r.run_no: r.bypass_score for r in B.bypass_score_over_time(df, window=7, warmup=3, block_runs=8).collect()}
    for i in range(3, 50):
        part = scores[max(3, i - 6): i + 1]
        assert got[i + 1] == pytest.approx(sum(part) / len(part))
    assert len(got) == 47


def test_rolling_score_counts_clean_runs(spark):
    rows = [(f"s{i}", 1, "invariant_pass", None, None, None, None, i) for i in range(50)]
    rows += [("s7", 1, "bypass_signal", "raw_re_fetch", 0.9, 0.9, None, 60), ("s7", 1, "bypass_signal", "x", 0.9, 0.9, None, 61)]
    events = spark.createDataFrame(rows, schema.FIDELITY_EVENTS)
    r = B.rolling_bypass_score(events).first()
    assert (r.score, r.n_sessions) == (pytest.approx(1 / 50), 50)
    assert B.bypass_quarantine(events).count() == 0
    assert B.bypass_quarantine(events, threshold=0.01).first().detail == "rolling score 0.020 > threshold 0.01"


def test_skew_needs_fifty_runs(spark):
    rows = [("a", 50, 1000, 100, 50, 1000, 500), ("b", 49, 1000, 100, 50, 1000, 500), ("c", 50, 1000, 0, 50, 1000, 500)]
    df = spark.createDataFrame(rows, "fingerprint string, ok_runs long, ok_raw long, ok_cmp long, fail_runs long, fail_raw long, fail_cmp long")
    got = {r.fingerprint: (r.skew_factor, r.needs_relearning) for r in A.exit_code_skew(df).collect()}
    assert got == {"a": (pytest.approx(5.0), True), "b": (0.0, False), "c": (0.0, False)}


def test_versions(spark):
    rows = [(1, "f", "superseded", 1), (2, "f", "active", 2), (3, "f", "pending", 3), (4, "g", "active", 1)]
    df = spark.createDataFrame(rows, "profile_id long, fingerprint string, status string, created_at long")
    status = lambda d: {r.profile_id: r.status for r in d.collect()}
    assert status(V.promote(df, df.where("profile_id = 3"))) == {1: "superseded", 2: "superseded", 3: "active", 4: "active"}
    assert status(V.rollback(df)) == {1: "active", 2: "superseded", 3: "pending", 4: "active"}
    assert status(V.revoke_profile(df, "f")) == {1: "superseded", 2: "quarantined", 3: "pending", 4: "active"}
    assert status(V.purge_profile(df, "f")) == {4: "active"}


def test_block_scan_totals(spark):
    df = spark.createDataFrame([("s", i, 0) for i in range(10)], "session_id string, line_no long, sub_no long")
    out = BlockScan(3).scan(df, running("n", F.lit(1)))
    assert [r.n for r in out.orderBy("line_no").collect()] == list(range(1, 11))


def test_checkpoint_folder_is_the_configured_one(spark):
    assert session.shared_folder(spark) == spark.sparkContext._jsc.sc().getCheckpointDir().get()
