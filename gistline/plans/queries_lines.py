"""Registered queries: sources, per-line and ordered rules, JSON, text functions, formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gistline.functions import commands, fingerprint as FP, formats, jsontext as J, metrics as M, redaction as R
from gistline.functions import text as T
from gistline.operators import lines as L
from gistline.operators import ordered as O
from gistline.operators import stateless as S
from gistline.operators.scan import run_ordered
from gistline.plans.views import REGISTRY, twin, view
from gistline.session import shared_folder
from gistline.sources.sessions import (
    attestation_line, open_raw, preserve_raw_policy, read_sessions, redaction_policy, seal_raw, write_sessions,
)

query = REGISTRY.add


def planted_lines(spark, d):
    return L.explode_lines(view(spark, d, "planted"))


LINE = ["session_id", "line_no", "text"]
FULL = ["session_id", "line_no", "text", "is_placeholder"]


# -- sources

@query("read_sessions", twin("docs", "select session_id, fingerprint, strlen(text) as raw_bytes from docs"))
def _(spark, d):
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4()}"
    view(spark, d, "docs").write.parquet(path)
    return read_sessions(spark, path).select(
        "session_id", "fingerprint", F.octet_length("text").cast("bigint").alias("raw_bytes"))


@query("write_sessions", twin("ledger", """
select session_id, raw_bytes, cast(cast(to_timestamp(started_at - started_at % 31536000) at time zone 'UTC' as date) as varchar) as start_date
from ledger"""))
def _(spark, d):
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4()}"
    # All of a year on its first day, as a folder is written per day; and every day a second time.
    facts = view(spark, d, "ledger").withColumn("started_at", F.expr("started_at - started_at % 31536000"))
    write_sessions(facts, path)
    write_sessions(facts, path)
    return spark.read.parquet(path).select("session_id", "raw_bytes", F.col("start_date").cast("string").alias("start_date"))


@query("explode_lines", twin("planted_lines", "select session_id, line_no, text from planted_lines"))
def _(spark, d):
    return planted_lines(spark, d).select(LINE)


@query("assemble_output", twin("planted_lines", """
select session_id, string_agg(text, chr(10) order by line_no) || chr(10) as text
from planted_lines group by session_id"""))
def _(spark, d):
    return L.assemble_output(planted_lines(spark, d))


@query("attestation_line", twin("ledger", """
select session_id, '[gist: profile ' || coalesce(case when profile_id is not null then fingerprint end, '<none>') || '/v'
 || coalesce(cast(profile_id as varchar), '-') || ', fidelity ' || printf('%.2f', raw_bytes % 101 / 100e0)
 || ', mode=' || coalesce(mode, 'Full') || ', raw via gist show ' || session_id || ']'
 || case exit_code when 1 then chr(10) || '[gist: invariants failed: A, B]' else '' end as line from ledger"""))
def _(spark, d):
    failed = F.when(F.col("exit_code") == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    stored = F.col("profile_id").isNotNull()
    return view(spark, d, "ledger").select("session_id", attestation_line(
        F.when(stored, F.col("fingerprint")), F.col("profile_id").cast("string"),
        F.col("raw_bytes") % 101 / F.lit(100.0), F.coalesce("mode", F.lit("Full")), F.col("session_id"), failed).alias("line"))


@query("seal_raw", twin("docs", """
select session_id, 1 + 12 + strlen(text) + 16 as sealed_bytes, md5(text) as text_md5 from docs"""))
def _(spark, d):
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f000102030405060708090a0b0c0d0e0f"))
    sealed = seal_raw(view(spark, d, "docs"), key).withColumn("sealed_bytes", F.octet_length("sealed").cast("bigint"))
    return open_raw(sealed, key, redacted=False).select("session_id", "sealed_bytes", F.md5("text").alias("text_md5"))


# -- one line at a time

@query("keep_lines", twin("planted_lines", """
select session_id, line_no, text from planted_lines where regexp_matches(text, '^(error|exit|[A-Z][a-z]+ )')"""))
def _(spark, d):
    return S.keep_lines(planted_lines(spark, d), "^(error|exit|[A-Z][a-z]+ )").select(LINE)


@query("drop_lines", twin("planted_lines", """
select session_id, line_no, text from planted_lines where not regexp_matches(text, '^(tick|pod-|inner|[a-z])')"""))
def _(spark, d):
    return S.drop_lines(planted_lines(spark, d), "^(tick|pod-|inner|[a-z])").select(LINE)


@query("strip_ansi", twin("planted_lines", """
select session_id, line_no, replace(replace(text, chr(27) || '[31m', ''), chr(27) || '[0m', '') as text
from planted_lines"""))
def _(spark, d):
    return S.strip_ansi(planted_lines(spark, d)).select(LINE)


@query("strip_cr", twin("planted_lines", """
select session_id, line_no, rtrim(text, chr(13)) as text from planted_lines"""))
def _(spark, d):
    return S.strip_cr(planted_lines(spark, d)).select(LINE)


@query("ndjson_filter", twin("event_json", """
select session_id, text from event_json where json_valid(text) and json_type(text, '$.level') = 'VARCHAR'
and json_extract_string(text, '$.level') in ('ERROR', 'WARN')"""))
def _(spark, d):
    lines = view(spark, d, "event_json").withColumn("is_placeholder", F.lit(False))
    return S.ndjson_filter(lines, "level", ["ERROR", "WARN"]).select("session_id", "text")


@query("drop_debug_lines", twin("format_texts_lines", """
select session_id, line_no, text from format_texts_lines where not (doc_id % 9 = 6
and regexp_matches(text, '(?i)\\b(debug|trace)\\b'))"""))
def _(spark, d):
    lines = L.explode_lines(view(spark, d, "format_texts"), keep=("doc_id",))
    tagged = lines.withColumn("format", F.when(F.col("doc_id") % 9 == 6, "log").otherwise("plain"))
    return S.drop_debug_lines(tagged).select(LINE)


@query("is_placeholder_text", twin("planted_lines", """
select session_id, line_no, text from planted_lines where starts_with(ltrim(text), '[... ')
or starts_with(ltrim(text), '[gist:') or starts_with(ltrim(text), '[REDACTED:') or starts_with(ltrim(text), '--- [gist:')"""))
def _(spark, d):
    return planted_lines(spark, d).where(T.is_placeholder_text(F.col("text"))).select(LINE)


@query("passthrough_class", twin("commands", """
with t as (select id, command, ltrim(command) as c, regexp_extract(command, '^\\s*(\\S+)', 1) as f from commands)
select id, case when starts_with(c, 'GIST_RAW=1 ') then 'raw_escape'
 when starts_with(c, 'gist ') or c = 'gist' or ends_with(f, '/gist')
  or lower(regexp_replace(f, '\\.[^.]*$', '')) = 'gist' then 'already_wrapped'
 when f = '' or f in ('cd', 'echo', 'export') then 'builtin'
 when f in ('tee', 'cat') and regexp_matches(c, '[<>|]') then 'pipeline_plumbing'
 when regexp_matches(c, 'secret') then 'user_passthrough' else 'wrap' end as class from t"""))
def _(spark, d):
    return view(spark, d, "commands").select(
        "id", commands.passthrough_class(F.col("command"), ["secret"]).alias("class"))


POLICY = ("select id, b, b not in ('cat', 'tail') or b in ('tail') as redact, "
          "b in ('grep') or (true and b not in ('grep', 'rg')) as preserve from (select id, "
          "regexp_replace(regexp_replace(argv[1], '^.*/', ''), '\\.[^.]*$', '') as b from part_argvs)")


@query("redaction_policy", twin("part_argvs", f"select id, b as binary_name, redact from ({POLICY})"))
def _(spark, d):
    b = FP.file_stem(F.get("argv", F.lit(0)))
    return view(spark, d, "part_argvs").select("id", b.alias("binary_name"), redaction_policy(
        b, ["cat", "tail"], ["tail"]).alias("redact"))


@query("preserve_raw_policy", twin("part_argvs", f"select id, preserve from ({POLICY})"))
def _(spark, d):
    b = FP.file_stem(F.get("argv", F.lit(0)))
    return view(spark, d, "part_argvs").select("id", preserve_raw_policy(b, True, ["grep", "rg"], ["grep"]).alias("preserve"))


# -- ordered rules, over events (sessions without bound) and over whole documents

def event_rule(rule):
    def run(spark, d):
        lines = view(spark, d, "event_lines").select("session_id", "line_no", "sub_no", "text", "is_placeholder")
        return run_ordered(lines, rule).select(FULL)

    return run


def event_twin(body: str) -> str:
    return twin("event_lines", body)


W = "over (partition by session_id order by line_no)"
ALL = "session_id, line_no, text, is_placeholder"
NUMBERED = f"with n as (select *, row_number() {W} as rn, count(*) over (partition by session_id) as total from event_lines)"

query("dedup_adjacent", event_twin(f"""
select {ALL} from (select *, lag(text) {W} as p from event_lines) where p is null or p <> text"""))(
    event_rule(O.dedup_adjacent))

query("collapse_repeated", event_twin(f"""
with h as (select *, not is_placeholder and regexp_matches(text, '^(DEBUG|TRACE)') as hit from event_lines),
i as (select *, sum(case when hit then 0 else 1 end) {W} as island from h),
r as (select *, count(*) over (partition by session_id, island, hit) as len,
 row_number() over (partition by session_id, island, hit order by line_no) as k from i)
select session_id, line_no,
 case when hit and len >= 3 then '[... ' || cast(len as varchar) || ' quiet lines ...]' else text end as text,
 is_placeholder or (hit and len >= 3) as is_placeholder from r where not hit or len < 3 or k = 1"""))(
    event_rule(lambda x, o: O.collapse_repeated(x, "^(DEBUG|TRACE)", "[... {count} quiet lines ...]", 3, o)))

query("collapse_between", event_twin(f"""
with m as (select *, not is_placeholder and regexp_matches(text, '^(ERROR|INFO)') as b,
  not is_placeholder and regexp_matches(text, '^(WARN|INFO)') as e, row_number() {W} as rn,
  count(*) over (partition by session_id) as total from event_lines),
f as (select *, sum(case when b and e then 1 else 0 end) {W} as flips from m),
p as (select *, last_value(case when b <> e then {{'ins': b, 'at': flips}} end ignore nulls) {W} as mark from f),
a as (select *, (coalesce(mark.ins, false)) <> ((flips - coalesce(mark.at, 0)) % 2 = 1) as after from p),
s as (select *, coalesce(lag(after) {W}, false) as inside from a),
g as (select *, sum(case when not inside and b then 1 else 0 end) {W} as fence from s),
c as (select *, sum(case when inside and not e then 1 else 0 end) over (partition by session_id, fence order by line_no) as cnt from g)
select session_id, line_no, text, is_placeholder from c where not (inside and not e)
union all select session_id, line_no, '[... ' || cast(cnt as varchar) || ' inside ...]', true from c
where (inside and e) or (inside and not e and rn = total)"""))(
    event_rule(lambda x, o: O.collapse_between(x, "^(ERROR|INFO)", "^(WARN|INFO)", "[... {count} inside ...]", o)))

query("head", event_twin(f"{NUMBERED} select {ALL} from n where rn <= 10"))(event_rule(lambda x, o: O.head(x, 10, o)))
query("tail", event_twin(f"{NUMBERED} select {ALL} from n where rn > total - 10"))(event_rule(lambda x, o: O.tail(x, 10, o)))

ANCHOR = NUMBERED + (", a as (select *, min(case when not is_placeholder and regexp_matches(text, '^WARN') then rn end) "
                     "over (partition by session_id) as anchor from n)")
query("head_after", event_twin(f"{ANCHOR} select {ALL} from a where anchor is null or rn <= anchor + 5"))(
    event_rule(lambda x, o: O.head_after(x, 5, "^WARN", o)))
query("tail_before", event_twin(f"{ANCHOR} select {ALL} from a where anchor is null or rn >= anchor - 2"))(
    event_rule(lambda x, o: O.tail_before(x, 2, "^WARN", o)))

STATES = [
    {"name": "trouble", "enter": "^ERROR", "keep": [], "drop": ["click"]},
    {"name": "trade", "enter": "^(INFO|WARN)", "keep": ["purchase", "view"], "drop": ["TRACE"]},
]
query("state_machine", event_twin(f"""
with s as (select *, last_value(case when is_placeholder then null when regexp_matches(text, '^ERROR') then 0
 when regexp_matches(text, '^(INFO|WARN)') then 1 end ignore nulls) {W} as st from event_lines)
select {ALL} from s where is_placeholder or st is null or (st = 0 and not regexp_matches(text, 'click'))
 or (st = 1 and not regexp_matches(text, 'TRACE') and regexp_matches(text, 'purchase|view'))"""))(
    event_rule(lambda x, o: O.state_machine(x, STATES, o)))

query("truncate_to", event_twin(f"""
with u as (select *, sum(strlen(text) + 1) {W} as used from event_lines)
select session_id, line_no, case when used > 300 then '[... truncated to 300 bytes ...]' else text end as text,
 is_placeholder or used > 300 as is_placeholder from u where used <= 300 or used - strlen(text) - 1 <= 300"""))(
    event_rule(lambda x, o: O.truncate_to(x, 300, o)))


@query("head_tail_envelope", twin("planted_clean", f"""
with n as (select *, row_number() {W} as rn, count(*) over (partition by session_id) as total from planted_clean)
select session_id, line_no, text, false as is_placeholder from n where rn <= 4 or rn > total - 3
union all select session_id, line_no, '--- [gist: middle elided, showing first 4 and last ' ||
 cast(least(3, total - 4) as varchar) || ' lines] ---', true from n where rn > 4 and rn = greatest(4, total - 3) + 1"""))
def _(spark, d):
    return O.head_tail_envelope(L.generic_clean(view(spark, d, "planted")), 4, 3).select(FULL)


@query("generic_clean", twin("planted_clean", "select session_id, line_no, text from planted_clean"))
def _(spark, d):
    return L.generic_clean(view(spark, d, "planted")).select(LINE)


# -- JSON

@query("json_path_keep", twin("event_json", """
select session_id, case when not json_valid(text) then null else json_extract_string(text, '$.level') end as level,
 case when json_valid(text) then json_extract_string(text, '$.user.tags[1].t') end as tag,
 case when json_valid(text) then json_extract_string(text, '$.user.id') end as id,
 json_valid(text) as changed from event_json"""))
def _(spark, d):
    rows = view(spark, d, "event_json").select("session_id", "text", F.col("text").alias("k"))
    kept = J.json_path_keep(rows, "k", ["$.level", "$.user.tags[1].t", "$.user.id", "$.user.missing"])
    found = F.from_json("k", "struct<`$.level` string, `$.user.tags[1].t` string, `$.user.id` string>")
    changed = F.col("k") != F.col("text")
    return kept.select("session_id", F.when(changed, found).alias("f"), changed.alias("changed")).select(
        "session_id", F.col("f")["$.level"].alias("level"), F.col("f")["$.user.tags[1].t"].alias("tag"),
        F.col("f")["$.user.id"].alias("id"), "changed")


@query("json_path_drop", twin("event_json", """
select session_id, case when json_valid(text) then json_extract_string(text, '$.level') end as level,
 case when json_valid(text) and json_type(text, '$.user') = 'OBJECT' then cast(null as varchar) end as id,
 case when json_valid(text) then json_type(text, '$.user.tags') = 'ARRAY' end as has_tags from event_json"""))
def _(spark, d):
    out = J.json_path_drop(view(spark, d, "event_json"), "text", ["$.user.id", "$.user.none", "$.missing.x"])
    v = F.try_parse_json("text")
    return out.select(
        "session_id", F.try_variant_get(v, "$.level", "string").alias("level"),
        F.try_variant_get(v, "$.user.id", "string").alias("id"),
        F.when(F.try_variant_get(v, "$.user.tags", "variant").isNotNull(), F.lit(True)).alias("has_tags"))


@query("json_path_exists", twin("event_json", """
select session_id, json_valid(text) as root,
 case when json_valid(text) then json_exists(text, '$.user.none') else false end as nulled,
 case when json_valid(text) then json_exists(text, '$."user"."tags[1]"') else false end as indexed from event_json"""))
def _(spark, d):
    t = F.col("text")
    return view(spark, d, "event_json").select("session_id", *[
        F.coalesce(J.json_path_exists(t, p), F.lit(False)).alias(n)
        for n, p in (("root", "$"), ("nulled", "$.user.none"), ("indexed", "$.user.tags[1]"))])


@query("json_valid", twin("format_texts_lines", """
select session_id, line_no, json_valid(text) as valid from format_texts_lines"""))
def _(spark, d):
    return L.explode_lines(view(spark, d, "format_texts")).select(
        "session_id", "line_no", F.coalesce(J.json_valid(F.col("text")), F.lit(False)).alias("valid"))


# -- text functions

SHAPE = "('--format', '--output', '-o', '--json', '--pretty', '--oneline')"
TOKEN = ("case when regexp_matches({x}, '^-?\\d+(\\.\\d+)?$') then '<n>' when regexp_matches({x}, '^[0-9a-fA-F]{{6,}}$') "
         "then '<hash>' when regexp_matches({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') then "
         "regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) when contains({x}, '/') or contains({x}, '\\') "
         "or regexp_matches({x}, '^(\\.\\.?|[/~].*)$') or regexp_matches({x}, '^~$') or regexp_matches({x}, "
         "'^\\w[\\w.-]*\\.(rs|py|js|ts|go|java|c|cpp|h|toml|json|yaml|yml|md|txt|log|lock|gradle|xml|sh)$') then '<path>' "
         "when contains({x}, ' ') or contains({x}, chr(9)) then '<str>' else {x} end")


def canonical_sql(source: str) -> str:
    """Arguments unnested with the one before; tokens of a row are joined again in order."""
    flag, key, val = "starts_with(t, '-')", "split_part(t, '=', 1)", "substr(t, strpos(t, '=') + 1)"
    value = TOKEN.format(x="t")
    inline = TOKEN.format(x=f"({val})")
    return (
        f"with a as (select id, unnest(argv[2:]) as t, generate_subscripts(argv[2:], 1) as i, argv[1] as b from {source}), "
        f"p as (select *, lag(t) over (partition by id order by i) as before from a), "
        f"c as (select id, i, b, t, case when {flag} and contains(t, '=') then case when {key} in {SHAPE} then t "
        f"else {key} || '=' || ({inline}) end when {flag} or (before in {SHAPE}) then t else {value} end as c from p), "
        f"j as (select id, any_value(b) as b, string_agg(c, ' ' order by i) as tail from c group by id) ")


@query("canonical_token", twin("argvs", f"""
with a as (select id, unnest(argv) as t, generate_subscripts(argv, 1) as i from argvs)
select id, i - 1 as pos, {TOKEN.format(x='t')} as token from a"""))
def _(spark, d):
    return view(spark, d, "argvs").select("id", F.posexplode("argv").alias("pos", "t")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), FP.canonical_token(F.col("t")).alias("token"))


@query("canonical_argv", twin("argvs", canonical_sql(
    "(select id, case when id % 10 = 0 then flatten([argv for _ in range(20)]) else argv end as argv from argvs)") +
    "select id, tail as canonical from j"))
def _(spark, d):
    # Every tenth command has its arguments twenty times over: 320 of them.
    argv = F.when(F.col("id") % 10 == 0, F.flatten(F.array_repeat("argv", 20))).otherwise(F.col("argv"))
    rows = view(spark, d, "argvs").withColumn("argv", argv)
    tail = F.slice("argv", 2, F.size("argv"))
    return rows.select("id", F.array_join(FP.canonical_argv(tail), " ").alias("canonical"))


@query("fingerprint", twin("argvs part_argvs", canonical_sql(
    "(select id, argv from argvs union all select id + 1000000000, argv from part_argvs)") + """
select id, regexp_replace(regexp_replace(b, '^.*/', ''), '\\.[^.]*$', '') || ' ' || tail as fingerprint from j"""))
def _(spark, d):
    parts = view(spark, d, "part_argvs").select((F.col("id") + 1_000_000_000).alias("id"), "argv")
    both = view(spark, d, "argvs").unionByName(parts)
    return both.select("id", FP.fingerprint(F.col("argv")).alias("fingerprint"))


def redact_sql(x: str) -> str:
    for name, pattern in R.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED:{name}]', 'g')"
    return x


def entropy_sql(x: str) -> str:
    """Gaps and long tokens put together again, each token masked by its own entropy."""
    pattern = R.LONG_TOKEN
    return (f"list_reduce(list_transform(list_zip(regexp_split_to_array({x}, '{pattern}'), list_append("
            f"regexp_extract_all({x}, '{pattern}'), '')), lambda p: p[1] || case when p[2] <> '' and "
            f"list_entropy(string_split(p[2], '')) > 4.5 then '[REDACTED:high_entropy]' else p[2] end), lambda a, b: a || b)")


@query("redact_builtin", twin("planted", f"""
with r as (select session_id, {redact_sql('text')} as t from planted)
select session_id, {entropy_sql('t')} as text from r"""))
def _(spark, d):
    return R.redact_text(view(spark, d, "planted").select("session_id", "text"))


@query("redact_high_entropy", twin("planted", f"select session_id, {entropy_sql('text')} as text from planted"))
def _(spark, d):
    return view(spark, d, "planted").select("session_id", R.redact_high_entropy(F.col("text")).alias("text"))


@query("shannon_entropy", twin("planted_lines", """
select session_id, line_no, round(coalesce(list_entropy(regexp_extract_all(hex(encode(text)), '[0-9A-F]{2}')), 0), 6) as bits
from planted_lines"""))
def _(spark, d):
    return planted_lines(spark, d).select("session_id", "line_no", F.round(R.shannon_entropy(F.col("text")), 6).alias("bits"))


@query("redact_user", twin("planted", """
select session_id, regexp_replace(regexp_replace(text, 'case [0-9]', '[REDACTED:user]', 'g'),
 '(?i)SOURCE src[0-9]+', '[REDACTED:user]', 'g') as text from planted"""))
def _(spark, d):
    # The pattern in the middle is not valid and is skipped.
    return view(spark, d, "planted").select("session_id", R.redact_user(
        F.col("text"), ["case [0-9]", "([", "(?i)SOURCE src[0-9]+"]).alias("text"))


@query("redact_deny_sweep", twin("planted", """
select session_id, regexp_replace(text, '\\b[A-Za-z0-9_+/=-]{24,}\\b', '[REDACTED:deny]', 'g') as text from planted"""))
def _(spark, d):
    return view(spark, d, "planted").select("session_id", R.redact_deny_sweep(F.col("text")).alias("text"))


@query("tokens_saved", twin("ledger", """
select session_id, greatest(raw_bytes - compressed_bytes, 0) // 4 as tokens_saved from ledger"""))
def _(spark, d):
    return view(spark, d, "ledger").select("session_id", M.tokens_saved(
        F.col("raw_bytes"), F.col("compressed_bytes")).alias("tokens_saved"))


@query("compression_ratio", twin("ledger", """
select session_id, case when raw_bytes = 0 then 0 else round(compressed_bytes / raw_bytes, 9) end as ratio from ledger"""))
def _(spark, d):
    return view(spark, d, "ledger").select("session_id", F.round(M.compression_ratio(
        F.col("raw_bytes"), F.col("compressed_bytes")), 9).alias("ratio"))


@query("content_hash", twin("docs", "select session_id, sha256(text) as sha from docs"))
def _(spark, d):
    return view(spark, d, "docs").select("session_id", M.content_hash(F.col("text")).alias("sha"))


@query("utc_date", twin("runs", """
select run_id, strftime(to_timestamp(started_at) at time zone 'UTC', '%Y-%m-%d') as day from runs"""))
def _(spark, d):
    return view(spark, d, "runs").select("run_id", M.utc_date(F.col("started_at")).cast("string").alias("day"))


@query("template_placeholder", twin("event_lines", """
select session_id, '[... ' || cast(count(*) as varchar) || ' of ' || cast(count(*) as varchar) || ' ...]' as note
from event_lines group by session_id"""))
def _(spark, d):
    n = view(spark, d, "event_lines").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("session_id", T.template_placeholder("[... {count} of {count} ...]", F.col("n")).alias("note"))


# -- formats

FLAGS_SQL = """
with j as (select *, ltrim(text) as head from {v}),
l as (select *, json_valid(text) as ok, regexp_matches(text, '\\S') as filled,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words from {v}_lines),
k as (select *, row_number() over (partition by session_id, filled order by line_no) as rn from l),
s as (select session_id, bool_and(ok or not filled) filter (line_no < 5) and count(*) filter (filled) >= 2 as is_ndjson,
  count(*) filter (filled) >= 3 and min(words) filter (filled and rn <= 5) >= 2
  and min(words) filter (filled and rn <= 5) = max(words) filter (filled and rn <= 5) as is_tabular from k group by session_id),
f as (select session_id, (starts_with(head, '{{') or starts_with(head, '[')) and json_valid(head) as is_json,
  coalesce(is_ndjson, false) as is_ndjson,
  regexp_matches(text, '(?m)^@@ ') and regexp_matches(text, '(?m)^(diff --git|--- |\\+\\+\\+ )') as is_diff,
  regexp_matches(text, '(?m)(^\\s*Traceback \\(most recent call last\\):|^\\s*at [\\w.]+\\(|\\bthread ''main'' panicked at)') as is_stack_trace,
  coalesce(is_tabular, false) as is_tabular,
  regexp_matches(text, '(?m)^(\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}:\\d{{2}}|\\[\\d{{2}}:\\d{{2}}:\\d{{2}}\\]|\\w{{3}} \\d{{1,2}} \\d{{2}}:\\d{{2}}:\\d{{2}}|(?i)(debug|info|warn|error|fatal|trace)[: ])') as is_log
  from j left join s using (session_id))
"""
FORMAT_CASE = ("case when is_json then 'json' when is_ndjson then 'ndjson' when is_diff then 'diff' when is_stack_trace "
               "then 'stack_trace' when is_tabular then 'tabular' when is_log then 'log' else 'plain' end")


def flags_twin(select: str) -> str:
    return twin("format_texts_lines", FLAGS_SQL.format(v="format_texts") + select)


@query("detect_format", flags_twin(f"select session_id, {FORMAT_CASE} as format from f"))
def _(spark, d):
    return formats.with_format(view(spark, d, "format_texts")).select("session_id", "format")


def register_flag(name, test):
    @query(name, flags_twin(f"select session_id, {name} as hit from f"))
    def _(spark, d):
        facts = formats.with_line_facts(view(spark, d, "format_texts"), "text")
        return facts.select("session_id", F.coalesce(test(), F.lit(False)).alias("hit"))


register_flag("is_ndjson", lambda: formats.is_ndjson(F.col("_lines"), F.col("_filled")))
register_flag("is_diff", lambda: formats.is_diff(F.col("text")))
register_flag("is_stack_trace", lambda: formats.is_stack_trace(F.col("text")))
register_flag("is_tabular", lambda: formats.is_tabular(F.col("_filled"), F.col("_words")))
register_flag("is_log", lambda: formats.is_log(F.col("text")))
