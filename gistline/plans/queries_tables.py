"""Registered queries: dispatch and reduce, judging, accounting, scores, versions, learning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gistline import schema
from gistline.functions import metrics as M
from gistline.functions.fingerprint import file_stem
from gistline.functions.redaction import redact_text
from gistline.operators import account as A
from gistline.operators import bypass as B
from gistline.operators import judge as G
from gistline.operators import learn as L
from gistline.operators import lines as N
from gistline.operators import versions as V
from gistline.operators.formats import detect_format_lines
from gistline.plans import reduce as R
from gistline.plans.judge import judge
from gistline.plans.run import run as run_job
from gistline.plans.learn import as_profiles, learn, self_test
from gistline.plans.queries_lines import FORMAT_CASE, flags_twin
from gistline.plans.views import REGISTRY, table, twin, view
from gistline.session import local_frame, shared_folder
from gistline.sources.rulesets import RULESETS, load_profiles
from gistline.sources.sessions import preserve_raw_policy, purge_sessions, session_facts, session_mode, write_sessions

query = REGISTRY.add
NOW = 928_195_200  # a day inside the order dates
ROUND = 9


# -- dispatch and reduce

def rule_table(spark):
    """Bundled rule sets, every second one also stored as an imported profile."""
    bundled = load_profiles(spark)
    stored = bundled.where("profile_id % 2 = 0").withColumns({
        "profile_id": 1000 - F.col("profile_id"), "provenance": F.lit("imported"), "created_at": F.lit(100).cast("bigint")})
    older = stored.withColumns({"profile_id": F.col("profile_id") + 1000, "created_at": F.lit(50).cast("bigint"),
                                "rules": F.slice("rules", 1, 1)})
    return R.compile_rules(R.choose_profiles(bundled, stored.unionByName(older)))


def quoted(x) -> str:
    return "null" if x is None else "'" + str(x).replace("'", "''") + "'"


def sql_filter() -> str:
    """Keep and drop rules of all rule sets as one SQL condition."""
    cases = []
    for fp, _, _, rules, _ in RULESETS:
        tests = [f"{'not ' if r['kind'] == 'drop_lines' else ''}regexp_matches(text, {quoted(r['pattern'])})"
                 for r in rules if r["kind"] in ("keep_lines", "drop_lines")]
        if tests:
            cases.append(f"when {quoted(fp)} then {' and '.join(tests)}")
    cases.append("when 'unknown log' then not regexp_matches(text, '(?i)\\b(debug|trace)\\b')")
    return f"case fingerprint {' '.join(cases)} else true end"


DEDUPED = ", ".join(quoted(fp) for fp, _, _, rules, _ in RULESETS if any(r["kind"] == "dedup" for r in rules))
PODS = r"^\S+\s+1/1\s+Running\s+[0-9]+\s+\S+$"
REDUCED = f"""with kept as (select *, fingerprint = 'kubectl get pods' and regexp_matches(text, '{PODS}') as hit
  from tools_clean where {sql_filter()}),
isl as (select *, sum(case when hit then 0 else 1 end) over (partition by session_id order by line_no) as island from kept),
runs as (select *, count(*) over (partition by session_id, island, hit) as len, row_number() over (
  partition by session_id, island, hit order by line_no) as k from isl),
folded as (select session_id, fingerprint, doc_id, line_no, hit and len >= 3 as is_placeholder, case when hit and len >= 3 then
  '[... ' || cast(len as varchar) || ' healthy Running pods elided ...]' else text end as text
  from runs where not hit or len < 3 or k = 1),
reduced as (select session_id, fingerprint, doc_id, line_no, text, is_placeholder from (select *, lag(text) over (
  partition by session_id order by line_no) as p from folded)
  where fingerprint not in ({DEDUPED}) or p is null or p <> text)
"""
STORED = ", ".join(quoted(r[0]) for i, r in enumerate(RULESETS, 1) if i % 2 == 0)
BUNDLED = ", ".join(quoted(r[0]) for i, r in enumerate(RULESETS, 1) if i % 2 == 1)
PROFILE_ID = "case fingerprint " + " ".join(
    f"when {quoted(r[0])} then {1000 + i}" for i, r in enumerate(RULESETS, 1) if i % 2 == 0) + " end"


@query("load_profiles", twin("tools", "with b(fingerprint, version, format_claim, n_rules) as (values " + ", ".join(
    f"({quoted(r[0])}, {quoted(r[1])}, {quoted(r[2])}, {len(r[3])})" for r in RULESETS) + """)
select b.*, n_sessions from b left join (select fingerprint, count(*) as n_sessions from tools group by 1) using (fingerprint)"""))
def _(spark, d):
    used = view(spark, d, "tools").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_sessions"))
    return load_profiles(spark).select("fingerprint", "version", "format_claim", F.size("rules").alias("n_rules")).join(
        used, "fingerprint", "left")


@query("dispatch_profile", twin("tools", f"""
select session_id, fingerprint, cast({PROFILE_ID} as bigint) as profile_id, case when fingerprint in ({STORED}) then 'learned'
 when fingerprint in ({BUNDLED}) then 'bundled' else 'format' end as tier from tools"""))
def _(spark, d):
    return R.dispatch_profile(view(spark, d, "tools"), rule_table(spark)).select(
        "session_id", "fingerprint", "profile_id", "tier")


@query("reduce_sessions", twin("tools_clean", REDUCED + "select session_id, line_no, text, is_placeholder from reduced"))
def _(spark, d):
    return R.reduce_sessions(view(spark, d, "tools"), rule_table(spark)).select(
        "session_id", "line_no", "text", "is_placeholder")


@query("reduce_gain", twin("tools_clean", REDUCED + """,
out as (select session_id, sum(strlen(text) + 1) as cmp from reduced group by session_id),
s as (select t.fingerprint, strlen(t.text) as raw, coalesce(cmp, 0) as cmp from tools t left join out using (session_id))
select fingerprint, count(*) as runs, cast(sum(raw) as bigint) as raw_bytes, cast(sum(cmp) as bigint) as compressed_bytes,
 round(sum(cmp) / sum(raw), 9) as ratio, cast(greatest(sum(raw) - sum(cmp), 0) // 4 as bigint) as tokens_saved
from s group by fingerprint"""))
def _(spark, d):
    sizes = R.session_sizes(redact_text(view(spark, d, "tools")), rule_table(spark))
    gain = A.gain_by_fingerprint(sizes.withColumn("mode", F.lit("Full")), top=None)
    return gain.select("fingerprint", "runs", "raw_bytes", "compressed_bytes",
                       F.round("ratio", ROUND).alias("ratio"), "tokens_saved")


@query("session_sizes", twin("tools_clean", REDUCED + """,
out as (select session_id, sum(strlen(text) + 1) as cmp from reduced group by session_id)
select t.session_id, t.fingerprint, strlen(t.text) as raw_bytes, cast(coalesce(cmp, 0) as bigint) as compressed_bytes
from tools t left join out using (session_id)"""))
def _(spark, d):
    return R.session_sizes(view(spark, d, "tools"), rule_table(spark))


@query("session_facts", twin("tools_clean", REDUCED + f""", out as (select session_id,
 string_agg(text || chr(10), '' order by line_no) as c from reduced group by session_id),
f as (select t.session_id, t.fingerprint, cast({PROFILE_ID.replace('fingerprint', 't.fingerprint', 1)} as bigint) as profile_id,
 t.text, coalesce(c, '') as c from tools t left join out using (session_id))
select session_id, fingerprint, profile_id, case when fingerprint <> 'psql' then sha256(text) end as raw_sha,
 sha256(c) as compressed_sha, strlen(text) as raw_bytes, strlen(c) as compressed_bytes,
 greatest(strlen(text) - strlen(c), 0) // 4 as tokens_saved,
 case when fingerprint in ({STORED}, {BUNDLED}) then 'Full' else 'Passthrough' end as mode from f"""))
def _(spark, d):
    rules = rule_table(spark)
    sessions = view(spark, d, "tools")
    out = N.assemble_output(R.reduce_sessions(sessions, rules)).withColumnRenamed("text", "compressed")
    keyed = R.dispatch_profile(sessions.withColumnRenamed("text", "raw"), rules).join(out, "session_id", "left")
    return session_facts(keyed.withColumns({
        "compressed": F.coalesce("compressed", F.lit("")),
        "mode": session_mode(F.col("tier") != "format", F.lit(False)), "started_at": F.lit(NOW).cast("bigint"),
        "exit_code": F.lit(0), "preserve_raw": preserve_raw_policy(F.col("fingerprint"), True, ["psql"], [])})).drop(
        "started_at", "exit_code")


def one_rule_set(spark, rules, fingerprint="all"):
    row = {"profile_id": 1, "fingerprint": fingerprint, "version": "1.0.0", "schema": "1.0", "provenance": "synthesized",
           "status": "active", "created_at": 0, "format_claim": "plain", "rules": rules, "invariants": []}
    return R.compile_rules(local_frame(spark, [row], schema.PROFILES))


LINE_RULES = [{"kind": "drop_lines", "pattern": "^TRACE"}, {"kind": "dedup"},
              {"kind": "collapse_repeated", "pattern": "^(DEBUG|INFO)", "placeholder": "[... {count} ...]", "min": 2},
              {"kind": "tail", "n": 40}]


@query("reduce_lines", twin("event_lines", """
with c as (select *, session_id like '%3' as ruled from (select *, lag(text) over (partition by session_id order by line_no) as p
  from event_lines) where p is null or p <> text),
d as (select * from (select * exclude (p), lag(text) over (partition by session_id order by line_no) as p from c
  where not ruled or is_placeholder or text not like 'TRACE%') where not ruled or p is null or p <> text),
h as (select *, ruled and not is_placeholder and regexp_matches(text, '^(DEBUG|INFO)') as hit from d),
i as (select *, sum(case when hit then 0 else 1 end) over (partition by session_id order by line_no) as island from h),
r as (select *, count(*) over (partition by session_id, island, hit) as len,
  row_number() over (partition by session_id, island, hit order by line_no) as k from i),
f as (select session_id, line_no, ruled, case when hit and len >= 2 then '[... ' || cast(len as varchar) || ' ...]' else text end as text,
  is_placeholder or (hit and len >= 2) as is_placeholder from r where not hit or len < 2 or k = 1),
n as (select *, row_number() over (partition by session_id order by line_no desc) as back from f)
select session_id, line_no, text, is_placeholder from n where not ruled or back <= 40"""))
def _(spark, d):
    lines = view(spark, d, "event_lines").withColumn(
        "fingerprint", F.when(F.col("session_id").endswith("3"), "all").otherwise("none"))
    return R.reduce_lines(lines, one_rule_set(spark, LINE_RULES)).select("session_id", "line_no", "text", "is_placeholder")


@query("detect_format_lines", flags_twin(f"select session_id, {FORMAT_CASE} as format from f where session_id in "
                                         "(select session_id from format_texts_lines)"))
def _(spark, d):
    return detect_format_lines(N.explode_lines(view(spark, d, "format_texts"), check=True))


COSTED = [
    {"kind": "strip_ansi"}, {"kind": "drop_lines", "pattern": "^tick"},
    {"kind": "keep_lines", "pattern": "[aeiou]"}, {"kind": "dedup"}, {"kind": "head_after", "n": 3, "pattern": "^error"},
    {"kind": "head", "n": 12},
]
COST = """with l0 as (select session_id, line_no, regexp_replace(text, '\\x1b\\[[0-9;?]*[A-Za-z]', '', 'g') as text,
  strlen(text) as b0 from planted_lines),
c0 as (select session_id, count(*) as n0, sum(b0) as b0, sum(strlen(text)) as b1 from l0 group by session_id),
l2 as (select * from l0 where not regexp_matches(text, '^tick')),
c2 as (select session_id, count(*) as n2, sum(strlen(text)) as b2 from l2 group by session_id),
l3 as (select * from l2 where regexp_matches(text, '[aeiou]')),
c3 as (select session_id, count(*) as n3, sum(strlen(text)) as b3 from l3 group by session_id),
l4 as (select *, row_number() over (partition by session_id order by line_no) as rn from (select *, lag(text) over (
  partition by session_id order by line_no) as p from l3) where p is null or p <> text),
c4 as (select session_id, count(*) as n4, min(case when regexp_matches(text, '^error') then rn end) as a from l4 group by session_id),
cost as (select session_id, cast(n0 + n0 + n2 + n3 + least(n4, coalesce(a + 4, n4)) + least(12, least(n4, coalesce(a + 3, n4)))
  as bigint) as steps, cast(greatest(b0, b1, b2, b3) as bigint) as peak_bytes
  from c0 join c2 using (session_id) join c3 using (session_id) join c4 using (session_id))
"""


def planted_cost(spark, d):
    table_ = one_rule_set(spark, COSTED)
    lines = N.explode_lines(view(spark, d, "planted")).withColumn("rule_key", F.lit(0).cast("bigint"))
    return R.rule_cost(lines, table_)


@query("rule_cost", twin("planted_lines", COST + "select * from cost"))
def _(spark, d):
    return planted_cost(spark, d)


@query("budget_guard", twin("planted_lines", COST + """select session_id, steps, peak_bytes, steps > 90 or peak_bytes > 9000 as aborted,
 case when steps > 90 or peak_bytes > 9000 then 'rule budget exceeded; profile quarantined' end as detail from cost"""))
def _(spark, d):
    return R.budget_guard(planted_cost(spark, d), max_steps=90, max_bytes=9000)


# -- judge

MIXED = """with cmp as (select session_id, line_no, case when text = 'inner row' and doc_id % 2 = 0 then 'made up row' else text end as text
 from planted_clean where doc_id % 5 <> 0 or not starts_with(text, 'e'))
"""


def planted_sides(spark, d):
    sessions = view(spark, d, "planted")
    raw = N.explode_lines(sessions, check=True)
    # The cleaned text is the reduced side. Every fifth session loses its error and exit lines, and made-up lines
    # are put into every second one, so that checks fail too.
    cmp = N.generic_clean(sessions, ("doc_id",)).where("doc_id % 5 <> 0 or not startswith(text, 'e')")
    made_up = (F.col("text") == "inner row") & (F.col("doc_id") % 2 == 0)
    return sessions, raw, cmp.withColumn("text", F.when(made_up, "made up row").otherwise(F.col("text"))).drop("doc_id")


RAW_LINES = ("raw as (select session_id, line_no, case when ends_with(text, chr(13)) then left(text, len(text) - 1) "
             "else text end as text from planted_lines)")


@query("structural_subset", twin("planted_clean", MIXED + f""", {RAW_LINES},
r as (select distinct session_id, rtrim(text, ' ' || chr(13)) as line from raw),
m as (select c.session_id, rtrim(c.text) as line, r.line is null and trim(c.text) <> '' and not starts_with(ltrim(c.text), '[... ')
  as invented from cmp c left join r on r.session_id = c.session_id and r.line = rtrim(c.text)),
a as (select session_id, count(*) as n, count(*) filter (invented) as bad from m group by session_id),
b as (select session_id, count(*) as n from r group by session_id)
select b.session_id, b.n as lines_in_raw, coalesce(a.n, 0) as lines_in_compressed, coalesce(bad, 0) as invented,
 coalesce(bad, 0) = 0 as passed from b left join a using (session_id)"""))
def _(spark, d):
    _, raw, cmp = planted_sides(spark, d)
    return G.structural_subset(raw, cmp)


KEY = "^(error|tick|key|exit)"


@query("all_matching_preserved", twin("planted_clean", MIXED + f""", {RAW_LINES},
have as (select distinct session_id, text from cmp where regexp_matches(text, '{KEY}')),
hit as (select r.session_id, h.text is null as gone from raw r left join have h on h.session_id = r.session_id and h.text = r.text
  where regexp_matches(r.text, '{KEY}'))
select session_id, count(*) as hits, count(*) filter (gone) as missing from hit group by session_id"""))
def _(spark, d):
    _, raw, cmp = planted_sides(spark, d)
    return G.all_matching_preserved(raw, cmp, KEY).where("hits > 0")


def edge_twin(agg):
    return twin("planted_clean", MIXED + f"""select p.session_id, regexp_matches(coalesce(e.t, ''), '^([A-Z]|done)') as passed
from planted p left join (select session_id, {agg}(text, line_no) as t from cmp group by session_id) e using (session_id)""")


@query("first_line_matches", edge_twin("arg_min"))
def _(spark, d):
    sessions, _, cmp = planted_sides(spark, d)
    return G.edge_lines_match(cmp, sessions, "^([A-Z]|done)")


@query("last_line_matches", edge_twin("arg_max"))
def _(spark, d):
    sessions, _, cmp = planted_sides(spark, d)
    return G.edge_lines_match(cmp, sessions, "^([A-Z]|done)", last=True)


@query("count_matches_at_least", twin("planted_clean", MIXED + """, h as (select session_id, count(*) as n from cmp
 where regexp_matches(text, '^(tick|pod|inner|error)') group by session_id)
select p.session_id, coalesce(n, 0) as got, coalesce(n, 0) >= 2 as passed from planted p left join h using (session_id)"""))
def _(spark, d):
    sessions, _, cmp = planted_sides(spark, d)
    return G.count_matches_at_least(cmp, sessions, "^(tick|pod|inner|error)", 2)


EXIT = "(?i)^(exit[: ]|process exited|command failed|error code)"


@query("exit_line_preserved", twin("planted_clean", MIXED + f""", {RAW_LINES},
r as (select distinct session_id from raw where regexp_matches(text, '{EXIT}')),
c as (select distinct session_id from cmp where regexp_matches(text, '{EXIT}'))
select p.session_id, r.session_id is not null as raw_has, r.session_id is null or c.session_id is not null as passed
from planted p left join r using (session_id) left join c using (session_id)"""))
def _(spark, d):
    sessions, raw, cmp = planted_sides(spark, d)
    return G.exit_line_preserved(raw, cmp, sessions)


CHECK_ROWS = ", ".join(
    f"({quoted(fp)}, {quoted(v['name'])}, {quoted(v['check'])}, {quoted(v.get('pattern'))}, {v.get('count', 0)})"
    for fp, _, _, _, invariants in RULESETS for v in invariants)
# Every fourth session loses every second reduced line on purpose, so that checks fail too.
JUDGED = REDUCED + f""", shown as (select * from reduced where cast(substr(session_id, 2) as bigint) % 4 <> 0 or line_no % 2 = 0),
inv(fingerprint, name, chk, pattern, cnt) as (values {CHECK_ROWS}),
w as (select t.session_id, t.fingerprint, inv.name, inv.chk, inv.pattern, inv.cnt from tools t join inv using (fingerprint)),
rl as (select w.session_id, w.name, l.text, count(*) as n from w join tools_lines l using (session_id)
  where w.chk = 'all_matching_preserved' and regexp_matches(l.text, w.pattern) group by all),
cl as (select w.session_id, w.name, l.text, count(*) as n from w join shown l using (session_id)
  where w.chk in ('all_matching_preserved', 'count_matches_at_least') and regexp_matches(l.text, w.pattern) group by all),
ms as (select rl.session_id, rl.name, sum(case when cl.text is null then rl.n else 0 end) as missing
  from rl left join cl on cl.session_id = rl.session_id and cl.name = rl.name and cl.text = rl.text group by all),
cn as (select session_id, name, sum(n) as got from cl group by all),
fl as (select session_id, arg_min(text, line_no) as t from shown group by session_id),
tx as (select session_id, string_agg(text, chr(10) order by line_no) as doc from shown group by session_id),
results as (select w.session_id, w.name, w.chk as "check", case w.chk when 'all_matching_preserved' then coalesce(missing, 0) = 0
  when 'count_matches_at_least' then coalesce(got, 0) >= cnt when 'first_line_matches' then regexp_matches(coalesce(t, ''), w.pattern)
  else coalesce(json_valid(doc), false) end as passed, missing, got, cnt from w left join ms using (session_id, name)
  left join cn using (session_id, name) left join fl using (session_id) left join tx using (session_id))
"""


def judged(spark, d):
    rules = rule_table(spark)
    sessions = view(spark, d, "tools")
    reduced = R.reduce_sessions(sessions, rules).where(
        "cast(substr(session_id, 2) as bigint) % 4 <> 0 or line_no % 2 = 0")
    return judge(R.dispatch_profile(sessions, rules), reduced, rules)


@query("invariant_results", twin("tools_clean", JUDGED + """select session_id, name, "check", passed, case when passed then null
 when "check" = 'all_matching_preserved' then cast(missing as varchar) || ' matching lines missing from compressed'
 when "check" = 'count_matches_at_least' then 'expected >= ' || cast(cnt as varchar) || ', got ' || cast(coalesce(got, 0) as varchar)
 end as detail from results"""))
def _(spark, d):
    return judged(spark, d)[0]


@query("self_fidelity", twin("tools_clean", JUDGED + f""",
n as (select session_id, count(*) as total, count(*) filter (passed) as ok from results group by session_id)
select t.session_id, case when t.fingerprint in ({STORED}) then round(coalesce(ok, 0) / greatest(coalesce(total, 0), 1), 9)
 else 1 end as self_fidelity from tools t left join n using (session_id)"""))
def _(spark, d):
    return judged(spark, d)[2].select("session_id", F.round("self_fidelity", ROUND).alias("self_fidelity"))


DETAIL = """case when passed then null
 when "check" = 'all_matching_preserved' then cast(missing as varchar) || ' matching lines missing from compressed'
 when "check" = 'count_matches_at_least' then 'expected >= ' || cast(cnt as varchar) || ', got ' || cast(coalesce(got, 0) as varchar) end"""


@query("fidelity_events", twin("tools_clean", JUDGED + f""",
rw as (select distinct session_id, rtrim(text) as line from tools_lines),
bad as (select s.session_id, count(*) filter (r.line is null and trim(s.text) <> '' and not starts_with(ltrim(s.text), '[... ')) as n
  from shown s left join rw r on r.session_id = s.session_id and r.line = rtrim(s.text) group by 1),
ids as (select session_id from rw union select session_id from shown),
e as (select session_id, case when passed then 'invariant_pass' else 'invariant_fail' end as kind, name as signal, {DETAIL} as detail from results
  union all select session_id, case when coalesce(n, 0) = 0 then 'structural_pass' else 'structural_fail' end, null,
  case when n > 0 then cast(n as varchar) || ' invented line(s)' end from ids left join bad using (session_id))
select t.session_id, cast({PROFILE_ID.replace('fingerprint', 't.fingerprint', 1)} as bigint) as profile_id, kind, signal, detail,
 cast({NOW} as bigint) as "at" from e join tools t using (session_id) where t.fingerprint in ({STORED})"""))
def _(spark, d):
    rules = rule_table(spark)
    sessions = R.dispatch_profile(view(spark, d, "tools"), rules)
    results, subset, _ = judged(spark, d)
    events = G.fidelity_events(results, subset, sessions, NOW)
    return events.select("session_id", "profile_id", "kind", "signal", "detail", "at")


# -- the whole job

def stored_profiles(spark):
    bundled = load_profiles(spark)
    return bundled.where("profile_id % 2 = 0").withColumns({
        "profile_id": 1000 - F.col("profile_id"), "provenance": F.lit("imported"), "created_at": F.lit(100).cast("bigint")})


@query("run_pipeline", twin("tools_clean", REDUCED + f""",
lens as (select session_id, sum(strlen(text) + 1) as bytes, string_agg(text || chr(10), '' order by line_no) as doc from reduced group by 1)
select t.session_id, t.fingerprint, cast({PROFILE_ID.replace('fingerprint', 't.fingerprint', 1)} as bigint) as profile_id,
 case when t.fingerprint in ({STORED}) or t.fingerprint in ({BUNDLED}) then 'Full' else 'Passthrough' end as mode,
 strlen(t.text) as raw_bytes, cast(coalesce(bytes, 0) as bigint) as compressed_bytes,
 sha256(coalesce(doc, '')) as compressed_sha from tools t left join lens using (session_id)"""))
def _(spark, d):
    # The tools' texts hold nothing to redact, so the twin needs no redaction.
    sessions = view(spark, d, "tools").withColumns({"started_at": F.lit(NOW).cast("bigint"), "exit_code": F.lit(0)})
    done = run_job(sessions, load_profiles(spark), stored_profiles(spark), NOW)
    return done.facts.select("session_id", "fingerprint", "profile_id", "mode", "raw_bytes", "compressed_bytes", "compressed_sha")


# -- accounting

LIVE = "coalesce(mode, '') <> 'Shadow'"
SUMS = ("count(*) as runs, cast(coalesce(sum(raw_bytes), 0) as bigint) as raw_bytes, "
        "cast(coalesce(sum(compressed_bytes), 0) as bigint) as compressed_bytes")
DERIVED = ("round(case when raw_bytes = 0 then 0 else compressed_bytes / raw_bytes end, 9) as ratio, "
           "greatest(raw_bytes - compressed_bytes, 0) // 4 as tokens_saved, "
           "round((greatest(raw_bytes - compressed_bytes, 0) // 4) * 15.0 / 1000000, 9) as usd_saved")


def rounded(df):
    return df.withColumns({c: F.round(c, ROUND) for c in ("ratio", "usd_saved")})


@query("gain_total", twin("ledger", f"select *, {DERIVED.replace('* 15.0 / 1000000', '* 15e0 / 1e6')} from (select {SUMS} from ledger where {LIVE})"))
def _(spark, d):
    return rounded(A.gain_total(view(spark, d, "ledger")))


def gain_twin(where, group="group by fingerprint", tail="order by tokens_saved desc, fingerprint limit 20"):
    derived = DERIVED.replace("* 15.0 / 1000000", "* 15e0 / 1e6")
    return twin("ledger", f"select *, {derived} from (select fingerprint, {SUMS} from ledger where {where} {group}) {tail}")


@query("gain_by_fingerprint", gain_twin(LIVE))
def _(spark, d):
    return rounded(A.gain_by_fingerprint(view(spark, d, "ledger")))


@query("gain_by_fingerprint_shadow", gain_twin("mode = 'Shadow'"))
def _(spark, d):
    return rounded(A.gain_by_fingerprint(view(spark, d, "ledger"), shadow=True))


@query("gain_rollup", gain_twin(LIVE, "group by rollup (fingerprint)", ""))
def _(spark, d):
    return rounded(A.gain_rollup(view(spark, d, "ledger")))


@query("gain_daily", twin("ledger", """
select strftime(to_timestamp(started_at) at time zone 'UTC', '%Y-%m-%d') as date, count(*) as runs,
 cast(sum(raw_bytes) as bigint) as raw_bytes, cast(sum(compressed_bytes) as bigint) as compressed_bytes,
 cast(sum(greatest(raw_bytes - compressed_bytes, 0) // 4) as bigint) as tokens_saved from ledger group by 1"""))
def _(spark, d):
    return A.gain_daily(view(spark, d, "ledger"))


BUCKETS = """with b as (select fingerprint, count(*) filter (exit_code = 0) as ok_runs,
 cast(coalesce(sum(raw_bytes) filter (exit_code = 0), 0) as bigint) as ok_raw,
 cast(coalesce(sum(compressed_bytes) filter (exit_code = 0), 0) as bigint) as ok_cmp,
 count(*) filter (exit_code <> 0) as fail_runs, cast(coalesce(sum(raw_bytes) filter (exit_code <> 0), 0) as bigint) as fail_raw,
 cast(coalesce(sum(compressed_bytes) filter (exit_code <> 0), 0) as bigint) as fail_cmp
 from ledger where exit_code is not null group by fingerprint) """


@query("exit_bucket_aggregates", twin("ledger", BUCKETS + "select * from b"))
def _(spark, d):
    return A.exit_bucket_aggregates(view(spark, d, "ledger"))


@query("exit_code_skew", twin("ledger", BUCKETS + """, r as (select fingerprint, ok_runs >= 50 and fail_runs >= 50 as enough,
 case when ok_raw = 0 then 0 else ok_cmp / ok_raw end as sr, case when fail_raw = 0 then 0 else fail_cmp / fail_raw end as fr from b)
select fingerprint, round(case when enough then sr else 0 end, 9) as success_ratio,
 round(case when enough then fr else 0 end, 9) as failure_ratio,
 round(case when enough and sr > 0 then fr / sr else 0 end, 9) as skew_factor,
 enough and sr > 0 and fr / sr > 2 as needs_relearning from r"""))
def _(spark, d):
    skew = A.exit_code_skew(A.exit_bucket_aggregates(view(spark, d, "ledger")))
    return skew.withColumns({c: F.round(c, ROUND) for c in ("success_ratio", "failure_ratio", "skew_factor")})


@query("recent_sessions", twin("ledger", "select * from ledger order by started_at desc, session_id limit 20"))
def _(spark, d):
    return A.recent_sessions(view(spark, d, "ledger"))


@query("retention_estimate", twin("ledger", f"""
select count(*) as sessions, cast(coalesce(sum(raw_bytes + compressed_bytes), 0) as bigint) as bytes
from ledger where started_at < {NOW} - 14 * 86400"""))
def _(spark, d):
    return A.retention_estimate(view(spark, d, "ledger"), NOW)


@query("purge_expired", twin("ledger", f"""
with x as (select * from ledger where started_at < {NOW} - 14 * 86400)
select 'kept' as part, session_id as key, cast(1 as bigint) as n from ledger where started_at >= {NOW} - 14 * 86400
union all select 'released', s, count(*) from (select raw_sha as s from x union all select compressed_sha from x)
where s is not null group by s"""))
def _(spark, d):
    kept, released = A.purge_expired(view(spark, d, "ledger"), NOW)
    return kept.select(F.lit("kept").alias("part"), F.col("session_id").alias("key"), F.lit(1).cast("bigint").alias("n")).unionByName(
        released.select(F.lit("released").alias("part"), F.col("sha256").alias("key"), F.col("released").alias("n")))


@query("purge_sessions", twin("ledger", f"""
with y as (select *, {NOW} - 17 * 86400 + started_at % 518400 as t from ledger),
x as (select * from y where t < {NOW} + 18000 - 14 * 86400)
select 'kept' as part, session_id as key, cast(1 as bigint) as n from y where t >= {NOW} + 18000 - 14 * 86400
union all select 'released', s, count(*) from (select raw_sha as s from x union all select compressed_sha from x)
where s is not null group by s"""))
def _(spark, d):
    # All times folded into six days; the limit is five hours into the fourth.
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4()}"
    at = F.lit(NOW - 17 * 86400) + F.col("started_at") % 518400
    write_sessions(view(spark, d, "ledger").withColumn("started_at", at), path)
    released = purge_sessions(spark, path, NOW + 18000)
    return spark.read.parquet(path).select(F.lit("kept").alias("part"), F.col("session_id").alias("key"), F.lit(1).cast("bigint").alias("n")).unionByName(
        released.select(F.lit("released").alias("part"), F.col("sha256").alias("key"), F.col("released").alias("n")))


@query("release_content", twin("ledger customers", f"""
with x as (select raw_sha as sha256, count(*) as released from ledger where started_at < {NOW} - 14 * 86400 group by 1)
select sha256, kind, size, created_at, ref_count - coalesce(released, 0) as ref_count from customers left join x using (sha256)
where ref_count - coalesce(released, 0) > 0"""))
def _(spark, d):
    _, released = A.purge_expired(view(spark, d, "ledger").withColumn("compressed_sha", F.lit(None).cast("string")), NOW)
    return A.release_content(view(spark, d, "customers"), released)


@query("content_refcount", twin("docs", """
select sha256(text) as sha256, count(*) as ref_count, min(doc_id) as created_at, min(strlen(text)) as size, 'raw' as kind
from docs group by 1"""))
def _(spark, d):
    return A.content_refcount(view(spark, d, "docs").select(
        "text", F.lit("raw").alias("kind"), F.col("doc_id").alias("created_at")))


@query("content_total_bytes", twin("contents", "select cast(coalesce(sum(size), 0) as bigint) as total_bytes from contents"))
def _(spark, d):
    return A.content_total_bytes(view(spark, d, "contents"))


@query("orphan_content", twin("ledger part_contents", """
select sha256, kind, size, created_at, ref_count from part_contents where sha256 not in (select raw_sha from ledger)
and sha256 not in (select compressed_sha from ledger where compressed_sha is not null)"""))
def _(spark, d):
    ledger = view(spark, d, "ledger")
    return A.orphan_content(view(spark, d, "part_contents"), ledger.select(F.col("raw_sha").alias("sha256")),
                            ledger.select(F.col("compressed_sha").alias("sha256")))


@query("session_lookup", twin("ledger customers", """
select session_id, fingerprint, raw_sha, c.kind, c.size from ledger left join customers c on c.sha256 = raw_sha
where session_id = 'o7'"""))
def _(spark, d):
    return A.session_lookup(view(spark, d, "ledger"), view(spark, d, "customers"), "o7").select(
        "session_id", "fingerprint", "raw_sha", "kind", "size")


@query("drift_check", """select s.page_id as key, case when c.page_id is null then 'MISSING' when s.sha = sha256(c.html) then 'OK'
 else 'DRIFT' end as status from (select page_id, case when page_id % 5 = 0 then sha256(url) else sha256(html) end as sha from pages
 where page_id % 11 <> 0) s left join (select * from pages where page_id % 7 <> 0) c using (page_id)""")
def _(spark, d):
    pages = table(spark, d, "pages")
    body = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html"))
    stored = pages.where("page_id % 11 <> 0").select(F.col("page_id").alias("key"), M.content_hash(body).alias("sha"))
    current = pages.where("page_id % 7 <> 0").select(F.col("page_id").alias("key"), F.col("html").alias("body"))
    return A.drift_check(stored, current)


# -- signals and scores

@query("near_duplicate_runs", twin("runs", """
with p as (select *, """ + ", ".join(
    f"lag({c}, {k}) over (order by started_at, run_id) as {c[0]}{k}" for c in ("fingerprint", "started_at") for k in (1, 2, 3))
    + """ from runs) select run_id, fingerprint, started_at, """ + " + ".join(
    f"cast(coalesce(f{k} = fingerprint and started_at - s{k} <= 30, false) as bigint)" for k in (1, 2, 3)) + " as near_hits from p"))
def _(spark, d):
    return B.near_duplicate_global(view(spark, d, "runs"))


@query("near_duplicate_by_agent", twin("runs", """
select run_id, agent, fingerprint, started_at, coalesce(started_at - lag(started_at) over (partition by agent, fingerprint
 order by started_at, run_id) <= 600, false) as near_duplicate from runs"""))
def _(spark, d):
    return B.near_duplicate_by_agent(view(spark, d, "runs"), seconds=600).select(
        "run_id", "agent", "fingerprint", "started_at", "near_duplicate")


@query("bypass_events", twin("part_argvs", """
with b as (select *, regexp_replace(regexp_replace(argv[1], '^.*/', ''), '\\.[^.]*$', '') as bin from part_argvs)
select id, 'raw_escape' as signal, 0.2e0 as weight from b where raw_escape
union all select id, 'raw_re_fetch', 0.9e0 from b where bin in ('cat', 'tail') and (contains(argv[1], 'gist') or
 contains(argv[2], 'gist') or contains(argv[2], 'sess_'))
union all select id, 'grep_after_read', 0.5e0 from b where bin in ('grep', 'rg')
union all select id, 'near_duplicate', 0.4e0 from b where near_duplicate"""))
def _(spark, d):
    return B.bypass_events(view(spark, d, "part_argvs").withColumnRenamed("id", "session_id")).withColumnRenamed(
        "session_id", "id")


@query("signal_weights", """select event_type as signal, count(*) as n, any_value(case event_type when 'view' then 0.7e0
 when 'click' then 0.6e0 end) as weight from events group by event_type""")
def _(spark, d):
    named = table(spark, d, "events").groupBy(F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("n"))
    mapped = F.when(F.col("signal") == "view", "show_raw").when(F.col("signal") == "click", "script_to_disk")
    return named.withColumn("weight", B.weight_of(mapped))


SCORES = """with s as (select profile_id, session_id, max("at") as latest,
 least(coalesce(sum(weight) filter (kind = 'bypass_signal'), 0), 1) as score from bypass group by all)"""
ROLLING = SCORES + """, r as (select *, row_number() over (partition by profile_id order by latest desc, session_id) as rn from s),
t as (select profile_id, sum(score) / count(*) as score, count(*) as n_sessions from r where rn <= 100 group by profile_id)"""


@query("session_scores", twin("bypass", SCORES + "select profile_id, session_id, latest, round(score, 9) as score from s"))
def _(spark, d):
    return B.session_scores(view(spark, d, "bypass")).withColumn("score", F.round("score", ROUND))


@query("rolling_bypass_score", twin("bypass", ROLLING + "select profile_id, round(score, 9) as score, n_sessions from t"))
def _(spark, d):
    return B.rolling_bypass_score(view(spark, d, "bypass")).withColumn("score", F.round("score", ROUND))


@query("number_runs", twin("bypass", SCORES + """select profile_id, session_id, row_number() over (partition by profile_id
 order by latest, session_id) as run_no from s"""))
def _(spark, d):
    runs = B.session_scores(view(spark, d, "bypass")).withColumnRenamed("latest", "at")
    return B.number_runs(runs).select("profile_id", "session_id", "run_no")


@query("bypass_score_over_time", twin("bypass", SCORES + """, n as (select *, row_number() over (partition by profile_id
 order by latest, session_id) as run_no from s)
select profile_id, run_no, round(avg(score) over (partition by profile_id order by run_no rows between 99 preceding and current row), 9)
 as bypass_score from n where run_no > 3"""))
def _(spark, d):
    runs = B.session_scores(view(spark, d, "bypass")).withColumnRenamed("latest", "at")
    return B.bypass_score_over_time(B.number_runs(runs)).withColumn("bypass_score", F.round("bypass_score", ROUND))


@query("bypass_quarantine", twin("bypass", ROLLING + """, o as (select profile_id, count(distinct session_id) as observed from bypass group by 1)
select profile_id, round(score, 9) as score, observed, 'quarantined' as status,
 'rolling score ' || printf('%.3f', score) || ' > threshold 0.3' as detail from t join o using (profile_id)
where observed > 3 and score > 0.3"""))
def _(spark, d):
    return B.bypass_quarantine(view(spark, d, "bypass")).withColumn("score", F.round("score", ROUND))


@query("distinct_sessions_per_profile", twin("bypass", """
select profile_id, count(distinct session_id) as n_sessions from bypass group by profile_id"""))
def _(spark, d):
    return B.distinct_sessions_per_profile(view(spark, d, "bypass"))


@query("event_count_per_profile", twin("bypass", "select profile_id, count(*) as n_events from bypass group by profile_id"))
def _(spark, d):
    return B.event_count_per_profile(view(spark, d, "bypass"))


# -- versions

ACTIVE = """with a as (select *, row_number() over (partition by fingerprint order by created_at desc, profile_id desc) as rn
 from versions where status = 'active')"""


@query("active_profile", twin("versions", ACTIVE + "select * exclude (rn) from a where rn = 1"))
def _(spark, d):
    return V.active_profile(view(spark, d, "versions"))


@query("promote", twin("versions", """
with c as (select fingerprint, max(profile_id) as new, list(profile_id) as every from versions where status = 'pending'
 and profile_id % 20 = 2 group by fingerprint)
select profile_id, fingerprint, case when profile_id = new then 'active' when list_contains(every, profile_id) then 'superseded'
 when new is not null and status = 'active' then 'superseded' else status end as status
from versions left join c using (fingerprint)"""))
def _(spark, d):
    versions = view(spark, d, "versions")
    chosen = versions.where("status = 'pending' and profile_id % 20 = 2")
    return V.promote(versions, chosen).select("profile_id", "fingerprint", "status")


@query("rollback", twin("versions", """
with c as (select fingerprint, arg_max(profile_id, created_at * 100000000 + profile_id) as back from versions
 where status = 'superseded' group by fingerprint)
select profile_id, fingerprint, case when profile_id = back then 'active' when back is not null and status = 'active'
 then 'superseded' else status end as status from versions left join c using (fingerprint)"""))
def _(spark, d):
    return V.rollback(view(spark, d, "versions")).select("profile_id", "fingerprint", "status")


ONE = "Brand#2 ECONOMY"


@query("revoke_profile", twin("versions", ACTIVE + f"""select v.profile_id, v.fingerprint, case when a.rn = 1 then 'quarantined'
 else v.status end as status from versions v left join a on a.profile_id = v.profile_id and a.rn = 1
 and a.fingerprint = '{ONE}'"""))
def _(spark, d):
    return V.revoke_profile(view(spark, d, "versions"), ONE).select("profile_id", "fingerprint", "status")


@query("set_status", twin("versions", """select profile_id, case when profile_id % 6 = 1 then 'quarantined' else status end as status
 from versions"""))
def _(spark, d):
    versions = view(spark, d, "versions")
    changes = versions.where("profile_id % 6 = 1").select("profile_id", F.lit("quarantined").alias("status"))
    return V.set_status(versions, changes).select("profile_id", "status")


@query("purge_profile", twin("versions", f"select profile_id, fingerprint from versions where fingerprint <> '{ONE}'"))
def _(spark, d):
    return V.purge_profile(view(spark, d, "versions"), ONE).select("profile_id", "fingerprint")


@query("profile_history", twin("versions", f"""select * from versions where fingerprint = '{ONE}'
 order by created_at desc, profile_id desc"""))
def _(spark, d):
    return V.profile_history(view(spark, d, "versions"), ONE)


@query("profile_listing", twin("versions", "select fingerprint, version, provenance, status, created_at, profile_id from versions union all "
       "select * from (values " + ", ".join(
           f"({quoted(r[0])}, {quoted(r[1])}, 'bundled', 'active', cast(0 as bigint), cast({-i} as bigint))"
           for i, r in enumerate(RULESETS, 1)) + ") order by fingerprint, created_at desc, profile_id desc"))
def _(spark, d):
    return V.profile_listing(load_profiles(spark), view(spark, d, "versions"))


@query("profile_usage", twin("versions ledger part_samples", """
with u as (select profile_id, max(started_at) as last_used_at, count(*) as uses from ledger where profile_id is not null group by 1),
n as (select fingerprint, count(*) as n from part_samples group by 1)
select v.profile_id, v.fingerprint, last_used_at, coalesce(uses, 0) as uses,
 case when status = 'active' then coalesce(n, 0) else 0 end as sample_count
from versions v left join u using (profile_id) left join n on n.fingerprint = v.fingerprint"""))
def _(spark, d):
    return V.profile_usage(view(spark, d, "ledger"), view(spark, d, "part_samples"), view(spark, d, "versions"))


# -- learning

@query("sample_count", twin("samples", "select fingerprint, count(*) as n_samples from samples group by fingerprint"))
def _(spark, d):
    return L.sample_count(view(spark, d, "samples"))


@query("samples_in_order", twin("samples", """
select sample_id, captured_at, md5(text) as text_md5 from samples where fingerprint = 'src3' order by captured_at, sample_id"""))
def _(spark, d):
    return L.samples_in_order(view(spark, d, "samples"), "src3").select(
        "sample_id", "captured_at", F.md5("text").alias("text_md5"))


@query("sample_cap", twin("samples", """
select sample_id, fingerprint from (select *, row_number() over (partition by fingerprint order by captured_at, sample_id) as rn
 from samples where fingerprint not in ('src1', 'src2')) where rn <= 8"""))
def _(spark, d):
    samples = view(spark, d, "samples")
    known = samples.where("fingerprint in ('src1', 'src2')")
    return L.sample_cap(samples, known, cap=8).select("sample_id", "fingerprint")


ZERO = """with z as (select fingerprint, count(*) as n_samples, count(distinct text) = 1 as zero_variance
 from small_samples group by fingerprint)"""


@query("zero_variance", twin("small_samples", ZERO + "select * from z"))
def _(spark, d):
    return L.zero_variance(view(spark, d, "small_samples"))


@query("lock_in_verdict", twin("small_samples", ZERO + """, v as (select fingerprint, n_samples, case when n_samples >= 5 then 'reached_n'
 when n_samples >= 3 and zero_variance then 'zero_variance_fast_path' else 'accumulating' end as reason from z)
select fingerprint, n_samples, reason <> 'accumulating' as should_lock, reason from v"""))
def _(spark, d):
    return L.lock_in_verdict(view(spark, d, "small_samples"))


@query("doubling_checkpoint", """select o_orderkey as id, o_custkey % 200 + 1 as n, (o_custkey % 200 + 1) in (5, 10, 20, 40, 80, 160) as hit
 from orders""")
def _(spark, d):
    n = (F.col("o_custkey") % 200 + 1).alias("n")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n).withColumn(
        "hit", L.doubling_checkpoint(F.col("n")))


@query("classify_lines", twin("samples", """
, sl as (select fingerprint, sample_id, captured_at, i - 1 as line_no, t as line from (select *, unnest(string_split(text, chr(10))) as t,
  generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from samples) where not (i = n and t = '')),
f as (select fingerprint, arg_min(sample_id, captured_at * 100000000 + sample_id) as first_id, count(*) as n from samples group by 1)
select a.fingerprint, a.line_no, a.line, case when count(*) filter (b.line = a.line) = any_value(f.n) then 'constant' else 'varying'
 end as class from sl a join f on f.fingerprint = a.fingerprint and f.first_id = a.sample_id
left join sl b on b.fingerprint = a.fingerprint and b.line_no = a.line_no group by a.fingerprint, a.line_no, a.line""".replace(
    ", sl as", "with sl as", 1)))
def _(spark, d):
    return L.classify_lines(view(spark, d, "samples"))


CONSTANT = """with sl as (select distinct fingerprint, sample_id, unnest(string_split(text, chr(10))) as line from samples),
n as (select fingerprint, count(*) as n from samples group by 1),
k as (select fingerprint, line from sl join n using (fingerprint) where trim(line) <> '' group by fingerprint, line having count(*) = any_value(n.n))
"""


@query("constant_lines", twin("samples", CONSTANT + "select fingerprint, line from k"))
def _(spark, d):
    return L.constant_lines(view(spark, d, "samples"))


@query("learn_profile", twin("samples", CONSTANT + """, e as (select fingerprint, string_agg(regexp_replace(line,
 '([\\\\.+*?()|\\[\\]{}^$#&\\-~])', '\\\\\\1', 'g'), '|' order by line) as alts from k group by fingerprint)
select s.fingerprint, 'strip_ansi' || case when alts is null then '' else ',keep_lines' end || ',drop_lines,dedup,truncate_to' as kinds,
 '^(' || alts || ')$' as anchors from (select distinct fingerprint from samples) s left join e using (fingerprint)"""))
def _(spark, d):
    learned = L.learn_profile(view(spark, d, "samples"))
    keep = F.get(F.filter("rules", lambda r: r["kind"] == "keep_lines"), F.lit(0))
    return learned.select("fingerprint", F.array_join(F.transform("rules", lambda r: r["kind"]), ",").alias("kinds"),
                          keep["pattern"].alias("anchors"))


# Sources with a short name have error lines that differ between samples; the learned rules
# drop them and the self-test must reject the rule set.
@query("self_test", twin("samples", """select fingerprint, count(*) as n_samples,
 case when length(fingerprint) = 4 then count(*) else 0 end as failures, length(fingerprint) <> 4 as passed
 from samples group by fingerprint"""))
def _(spark, d):
    samples = view(spark, d, "samples")
    return self_test(samples, as_profiles(L.learn_profile(samples), NOW))


@query("learning_runs", twin("samples", f"""select fingerprint, 'structural' as backend, case when length(fingerprint) = 4 then 'rejected'
 else 'locked_in' end as outcome, count(*) as n_samples, case when length(fingerprint) = 4 then 'self-test failed on a sample' end
 as error_detail, cast({NOW} as bigint) as at from samples group by fingerprint"""))
def _(spark, d):
    return learn(view(spark, d, "samples"), NOW)[1]


def rule_rows(spark, d):
    """Rule rows with planted faults, one rule and two invariants per part."""
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in schema.RULE_KINDS])
    texts = F.element_at(F.array(F.lit("^a"), F.lit(r"(a)\1"), F.lit("(?=b)b"), F.lit("x+")), (k % 4 + 1).cast("int"))
    paths = F.element_at(F.array(F.lit("$.a"), F.lit("a.b"), F.lit("$.a[*]")), (k % 3 + 1).cast("int"))
    state = F.struct(F.lit("s").alias("name"), texts.alias("enter"), F.array().cast("array<string>").alias("keep"),
                     F.array().cast("array<string>").alias("drop"))
    kind = F.get(kinds, (k % 15).cast("int"))
    patterned = kind.isin("keep_lines", "drop_lines", "collapse_repeated", "head_after", "tail_before")
    rule = L._rule(
        kind=kind, pattern=F.when(patterned, texts), n=F.col("p_size") % 3, min=F.col("p_size") % 4, bytes=F.col("p_size") % 2,
        paths=F.when(kind.startswith("json"), F.array(paths)), field=F.when(F.col("p_size") % 2 == 0, "f").otherwise(" "),
        keep_values=F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("v"))),
        states=F.when(kind == "state_machine", F.when(F.col("p_size") % 3 == 0, F.array(state, state)).otherwise(F.array(state))))
    second = F.when(k % 6 == 0, "First").otherwise("Second")
    invariants = F.array(
        L._invariant(name=F.lit("First"), check=F.lit("last_line_matches"), pattern=texts),
        L._invariant(name=second, check=F.lit("json_path_exists"), path=paths))
    return table(spark, d, "part").select(
        k.alias("profile_id"), F.when(k % 50 == 0, " ").otherwise(F.col("p_brand")).alias("fingerprint"),
        F.when(k % 70 == 0, "").otherwise("1.0.0").alias("version"), F.when(k % 30 == 0, "0.9").otherwise("1.0").alias("schema"),
        F.array(rule).alias("rules"), invariants.alias("invariants"))


KINDS = ", ".join(quoted(k) for k in schema.RULE_KINDS)


@query("profile_rule_checks", f"""with p as (select p_partkey as k, p_size as z, ([{KINDS}])[p_partkey % 15 + 1] as kind from part),
q as (select k, 'meta' as "where", case when k % 30 = 0 then 'unsupported schema' end as problem from p
union all select k, 'meta', case when k % 50 = 0 then 'empty fingerprint' end from p
union all select k, 'meta', case when k % 70 = 0 then 'empty version' end from p
union all select k, 'rule 0', case when kind in ('head', 'tail', 'head_after', 'tail_before') and z % 3 = 0 then 'n must be > 0' end from p
union all select k, 'rule 0', case when kind = 'truncate_to' and z % 2 = 0 then 'bytes must be > 0' end from p
union all select k, 'rule 0', case when kind = 'collapse_repeated' and z % 4 < 2 then 'min must be >= 2' end from p
union all select k, 'rule 0', case when kind = 'state_machine' and z % 3 = 0 then 'duplicate state' end from p
union all select k, 'rule 0', case when kind = 'ndjson_filter' and z % 2 <> 0 then 'empty field' end from p
union all select k, 'rule 0', case when kind = 'ndjson_filter' and z % 5 = 0 then 'empty keep_values' end from p
union all select k, 'rule 0', case when kind like 'json%' and k % 3 <> 0 then 'unsupported json path' end from p
union all select k, 'rule 0', case when kind in ('keep_lines', 'drop_lines', 'collapse_repeated', 'head_after', 'tail_before', 'state_machine')
 and k % 4 in (1, 2) then 'forbidden pattern construct' end from p
union all select k, 'invariant First', case when k % 4 in (1, 2) then 'forbidden pattern construct' end from p
union all select k, case when k % 6 = 0 then 'invariant First' else 'invariant Second' end, case when k % 3 <> 0 then 'unsupported json path' end from p
union all select k, 'invariant First', case when k % 6 = 0 then 'duplicate invariant' end from p)
select k as profile_id, "where", problem from q where problem is not null""")
def _(spark, d):
    return L.profile_rule_checks(rule_rows(spark, d))
