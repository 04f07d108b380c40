"""Inputs of the registered queries, derived from the driver tables.

Each view is one list of SQL expressions over one table. Spark and the SQL twin evaluate
the same text, so a query and its twin start from the same rows. Carrier lines are planted
into whole documents, because the bare ones hold no colours, secrets or error lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistline.session import spread

NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(*parts: str) -> str:
    """SQL text of lines, each ended by a line feed."""
    return " || ".join(f"{p} || {NL}" for p in parts)


ID = "cast(doc_id as string)"
MD5 = f"md5({ID})"

SECRET = f"""case doc_id % 11
 when 0 then 'key AKIA' || upper(substr({MD5}, 1, 16)) || ' end'
 when 1 then 'key ghp_' || {MD5} || substr({MD5}, 1, 8)
 when 2 then 'key github_pat_' || {MD5} || '_' || {MD5}
 when 3 then 'key glpat-' || substr({MD5}, 1, 24)
 when 4 then 'key sk_live_' || substr({MD5}, 1, 24)
 when 5 then 'key sk_test_' || substr({MD5}, 1, 24)
 when 6 then 'key eyJ' || {MD5} || '.eyJ' || {MD5} || '.' || {MD5}
 when 7 then 'Authorization: Bearer ' || {MD5}
 when 8 then '-----BEGIN RSA PRIVATE KEY-----' || {NL} || {MD5} || {NL} || '-----END RSA PRIVATE KEY-----'
 when 9 then 'key abcdefghijklmnopqrstuvwxyz0123456789' || {ID} || ' end'
 else 'digest ' || {MD5} end"""

CARRIERS = " || ".join([
    f"chr(27) || '[31mred ' || {ID} || chr(27) || '[0m' || {NL}",
    f"'carriage ' || cast(doc_id % 3 as string) || repeat(chr(13), cast(doc_id % 3 as int)) || {NL}",
    f"repeat('tick' || {NL}, cast(doc_id % 4 as int))",
    f"repeat('pod-' || cast(doc_id % 3 as string) || ' 1/1 Running' || {NL}, cast(doc_id % 6 as int))",
    f"'error: case ' || cast(doc_id % 7 as string) || {NL}",
    f"case when doc_id % 3 = 0 then 'exit: ' || cast(doc_id % 2 as string) || {NL} else '' end",
    f"'== source ' || source || ' ==' || {NL}",
    f"'BEGIN section' || {NL}",
    f"repeat('inner row' || {NL}, cast(doc_id % 5 as int))",
    f"case when doc_id % 9 = 8 then '' else 'END section' || {NL} end",
    f"'[... 4 earlier lines elided ...]' || {NL}",
    f"'debug probe ' || cast(doc_id % 2 as string) || {NL}",
    f"{SECRET} || {NL}",
    f"case when doc_id % 2 = 0 then 'done' || {NL} else 'done' end",
])

FORMAT_TEXT = f"""case doc_id % 9
 when 0 then '{{"doc": ' || {ID} || ', "tags": ["a", "b"], "nested": {{"n": null, "k": 3}}}}'
 when 1 then '{{"doc": ' || {ID} || '}}' || {NL} || {NL} || '[1, 2]' || {NL} || '"x"'
 when 2 then 'diff --git a b' || {NL} || '@@ -1 +1 @@' || {NL} || text
 when 3 then text || {NL} || '  Traceback (most recent call last):' || {NL} || 'x'
 when 4 then text || {NL} || '    at com.acme.Main(Main:1)'
 when 5 then 'name  ready' || {NL} || 'a 1' || {NL} || 'b   ' || {ID} || {NL} || text
 when 6 then '2024-01-0' || cast(doc_id % 8 + 1 as string) || ' 10:00:00 DEBUG start' || {NL} || text || {NL} || 'info: Trace kept'
 when 7 then '{{"doc": 1}} trailing' || {NL} || text
 else text end"""

# Command outputs for dispatch: known commands by number, then two unknown ones.
TOOLS = {
    "aws s3 ls": ["'A newer version of the CLI'", "'2024 bucket-' || " + ID, "'2024 bucket-' || " + ID],
    "az webapp log tail": ["'10:00 DEBUG poll'", "'10:01 INFO up ' || " + ID, "'10:01 INFO up ' || " + ID],
    "cargo build": ["'   Compiling a v1'", "'error[E0' || " + ID + " || ']: bad'", "'  --> src'", "'warning: w'",
                    "'    Finished dev'"],
    "cargo test": ["'   Compiling a v1'", "'running 2 tests'", "'test a ... ok'", "'noise'", "'test result: ok'"],
    "docker ps": ["'WARNING: old'", "'CONTAINER ID  IMAGE'", "''", "'c' || " + ID + " || ' img'",
                  "'DEPRECATED: x'", "'c' || " + ID + " || ' img'"],
    "eslint": ["'/src/a.js'", "'  1:2  error  bad'", "'  3:4  warning  meh'", "'context'"],
    "gh pr list": ["'Hint: login'", "'#' || " + ID + " || ' fix'", "''", "'#' || " + ID + " || ' fix'"],
    "git branch -a": ["'* main'", "'  dev'", "'  remotes/origin/HEAD -> origin/main'", "'  remotes/origin/main'"],
    "git diff": ["'diff --git a b'", "'index 12ab'", "'@@ -1 +1 @@'", "' same'", "'+new ' || " + ID],
    "git log": ["'commit ' || " + MD5, "'Author: A'", "'Date: D'", "''", "'    message'", "'    message'"],
    "git status": ["'On branch main'", "'Changes not staged:'", "'  (use git add)'", "'  modified: f' || " + ID,
                   "'noise here now'"],
    "go test": ["'=== RUN A'", "'progress'", "'--- PASS: A'", "'ok  pkg'"],
    "jq .": ["'{'", "'  \"id\": ' || " + ID, "'}'"],
    "kubectl get pods": ["'NAME READY STATUS RESTARTS AGE'"] + ["'p' || " + ID + f" || '-{i} 1/1 Running 0 5d'"
                         for i in range(4)] + ["'bad 0/1 CrashLoopBackOff 9 5d'", "'W0101 deprecated'",
                                               "'q 1/1 Running 0 5d'", "'r 1/1 Running 0 5d'"],
    "make": ["'gcc -c a.c'", "'echo'", "'a.c:1:2: error: bad'", "'make: *** [all] Error 1'", "'some error line'"],
    "mypy <path>": ["'a.py:1: error: bad'", "'reading cache'", "'Found 1 error'"],
    "npm install": ["'npm warn old'", "'progress 1'", "'added ' || " + ID + " || ' packages'"],
    "psql": ["'Timing is on.'", "' id | v'", "' ' || " + ID + " || ' | x'", "'(1 row)'", "'Time: 3.2 ms'"],
    "pytest": ["'===== test session starts'", "'a.py::t PASSED'", "'detail'", "'==== 3 passed ===='"],
    "ruff check <path>": ["'a.py:1:2: F401 unused'", "'hint'", "'Found 1 error.'"],
    "terraform plan": ["'  # res will be created'", "'refreshing'", "'Plan: 1 to add'"],
    "tsc": ["'a.ts(1,2): error TS1005: x'", "'info'", "'Found 1 error.'"],
    "unknown log": ["'2024-01-01 10:00:00 start'", "'2024-01-01 10:00:01 DEBUG x ' || " + ID, "'trace here'"],
    "unknown text": ["'plain words here'", "'no debug here'", "'no debug here'"],
}
TOOL_NAME = "case doc_id % 24 " + " ".join(
    f"when {i} then '{name}'" for i, name in enumerate(TOOLS)) + " end"
TOOL_TEXT = "case doc_id % 24 " + " ".join(
    f"when {i} then {lines_of(*parts)}" for i, parts in enumerate(TOOLS.values())) + " end"

LEVEL = ("case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'purchase' then 'INFO' "
         "when 'click' then 'DEBUG' else 'TRACE' end")
EVENT_AT = "{epoch:ts}"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "docs": ("documents", [
        f"concat('d', {ID}) as session_id", "source as fingerprint", "doc_id", "text"]),
    "planted": ("documents", [
        f"concat('d', {ID}) as session_id", "source as fingerprint", "doc_id",
        f"text || {NL} || {CARRIERS} as text"]),
    "format_texts": ("documents", [
        f"concat('d', {ID}) as session_id", "source as fingerprint", "doc_id", f"{FORMAT_TEXT} as text"]),
    "tools": ("documents", [
        f"concat('d', {ID}) as session_id", f"{TOOL_NAME} as fingerprint", "doc_id",
        f"{TOOL_TEXT} || text as text"]),
    "samples": ("documents", [
        "doc_id as sample_id", "source as fingerprint", "doc_id * 7919 % 1000 as captured_at",
        "cast(doc_id % 3 as int) as exit_code",
        f"'== ' || source || ' (v1.0) ==' || {NL} || 'run ' || cast(doc_id % 2 as string) || {NL} || "
        f"case when length(source) = 4 then 'error: e' || {ID} || {NL} else '' end || text || {NL} || "
        f"'exit: 0' || {NL} || 'total [' || source || ']' || {NL} as text"]),
    "small_samples": ("lineitem", [
        "concat('order ', cast(l_orderkey as string)) as fingerprint", "l_returnflag || l_linestatus as text",
        "l_orderkey * 10 + l_linenumber as sample_id", "l_orderkey as captured_at"]),
    "event_lines": ("events", [
        "concat('u', cast(user_id as string)) as session_id", "event_id as line_no",
        "cast(0 as bigint) as sub_no", f"{LEVEL} || ' ' || event_type as text",
        "event_id % 37 = 0 as is_placeholder"]),
    "timed_lines": ("events", [
        "concat('u', cast(user_id as string)) as session_id", "event_id as line_no",
        "cast(0 as bigint) as sub_no", f"{LEVEL} || ' ' || event_type as text",
        "event_id % 37 = 0 as is_placeholder", f"{EVENT_AT} as at"]),
    "event_json": ("events", [
        "event_id", "concat('e', cast(event_id as string)) as session_id",
        "concat('u', cast(user_id as string)) as user_session", "event_id as line_no",
        f"case event_id % 10 when 7 then '{{\"level\": 5}}' when 8 then 'not json' when 9 then '{{\"user\": 1}}' "
        f"else '{{\"level\":\"' || {LEVEL} || '\",\"user\":{{\"id\":' || cast(user_id as string) || "
        "',\"tags\":[\"a\",{\"t\":' || cast(event_id % 3 as string) || '}],\"none\":null},\"a.b\":1}' end as text"]),
    "bypass": ("events", [
        "user_id % 10 as profile_id",
        "concat('u', cast(user_id as string), '-', cast(cast(ts as date) as string)) as session_id",
        "case when event_type = 'signup' then 'invariant_pass' else 'bypass_signal' end as kind",
        "event_type as signal",
        "case event_type when 'error' then 0.9e0 when 'click' then 0.5e0 when 'view' then 0.4e0 "
        "when 'purchase' then 0.2e0 end as weight", f"{EVENT_AT} as at"]),
    "runs": ("events", [
        "event_id as run_id", "event_type as fingerprint",
        "concat('agent-', cast(user_id % 5 as string)) as agent", f"{EVENT_AT} as started_at"]),
    "ledger": ("orders", [
        "concat('o', cast(o_orderkey as string)) as session_id", "o_orderpriority as fingerprint",
        "case when o_orderstatus = 'O' then o_custkey % 10 end as profile_id",
        "{epoch:o_orderdate} as started_at",
        "cast(case when o_custkey % 17 = 0 then null else o_custkey % 3 end as int) as exit_code",
        "cast(floor(o_totalprice) as bigint) as raw_bytes",
        "cast(floor(o_totalprice * case when o_custkey % 3 = 0 then 2e-1 else 6e-1 end) as bigint) as compressed_bytes",
        "case when o_orderkey % 13 = 0 then null when o_orderstatus = 'O' then 'Full' "
        "when o_orderstatus = 'P' then 'Passthrough' else 'Shadow' end as mode",
        "md5(cast(o_custkey as string)) as raw_sha",
        "case when o_orderkey % 5 = 0 then null else md5(cast(o_orderkey as string)) end as compressed_sha"]),
    "versions": ("part", [
        "p_partkey as profile_id", "concat(p_brand, ' ', p_type) as fingerprint",
        "concat('1.', cast(p_partkey as string)) as version", "'1.0' as schema",
        "case when p_partkey % 4 = 0 then 'imported' else 'synthesized' end as provenance",
        "case p_partkey % 10 when 0 then 'active' when 1 then 'quarantined' when 2 then 'pending' "
        "else 'superseded' end as status",
        "p_partkey * 31 % 977 as created_at"]),
    "contents": ("documents", [
        "md5(text) as sha256", "source as kind", "length(text) as size", "doc_id as created_at"]),
    "customers": ("customer", [
        "md5(cast(c_custkey as string)) as sha256", "'raw' as kind", "cast(length(c_name) as bigint) as size",
        "c_custkey as created_at", "c_custkey % 4 + 1 as ref_count"]),
    "part_contents": ("part", [
        "md5(cast(p_partkey as string)) as sha256", "'raw' as kind", "cast(length(p_name) as bigint) as size",
        "p_partkey as created_at", "p_partkey % 4 + 1 as ref_count"]),
    "part_samples": ("part", [
        "p_partkey as sample_id", "concat(p_brand, ' ', p_type) as fingerprint", "p_size as captured_at", "p_name as text"]),
    "argvs": ("pages", [
        "page_id as id", "array('/usr/bin/curl.exe', url, '-n', cast(page_id as string), '--format=json', "
        "concat('--out=', md5(cast(page_id as string))), 'two words', '-5', '-o', 'x.json', '--', 'src/a.rs', "
        "concat('--since=', cast(page_id as string)), substr(md5(cast(page_id as string)), 1, 7), '1.5', 'plain') as argv"]),
    "part_argvs": ("part", [
        "p_partkey as id", "array(case p_partkey % 4 when 0 then 'cat' when 1 then '/bin/grep' when 2 then 'tail' "
        "else 'rg.exe' end, case p_partkey % 3 when 0 then concat('sess_', cast(p_partkey as string)) "
        "when 1 then p_name else '-v' end, cast(p_partkey as string)) as argv",
        "p_partkey % 5 = 0 as raw_escape", "p_size % 7 = 0 as near_duplicate"]),
    "commands": ("part", [
        "p_partkey as id", "case p_partkey % 12 when 0 then 'GIST_RAW=1 ls ' when 1 then '  gist run ' "
        "when 2 then '/opt/gist ' when 3 then 'cd ' when 4 then 'cat a | grep ' when 5 then 'cat ' "
        "when 6 then 'tee > ' when 7 then 'make secret ' when 8 then '' when 9 then 'GIST.exe ' "
        "when 10 then 'gist' else 'cargo build ' end || case when p_partkey % 12 in (8, 10) then '' else p_name end "
        "as command"]),
}


def _render(expr: str, dialect: str) -> str:
    while "{epoch:" in expr:
        at = expr.index("{epoch:")
        end = expr.index("}", at)
        col = expr[at + 7:end]
        call = f"unix_timestamp({col})" if dialect == "spark" else f"cast(floor(epoch({col})) as bigint)"
        expr = expr[:at] + call + expr[end + 1:]
    if dialect == "duckdb":
        expr = expr.replace("array(", "list_value(")
    return expr


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    rows = table(spark, sf_dir, source)
    if source == "documents":
        rows = spread(rows.select("doc_id", "source", "text"))
    return rows.selectExpr(*[_render(e, "spark") for e in exprs])


def _line_cte(name: str) -> str:
    """Lines of a view's texts: no empty line for a final line feed."""
    return (
        f"select session_id, fingerprint, doc_id, i - 1 as line_no, t as text from (select session_id, fingerprint, "
        f"doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i, "
        f"len(string_split(text, chr(10))) as n from {name}) where not (i = n and t = '')")


# Cleaned lines: carriage returns, colours, adjacent repeats.
def _clean_cte(name: str) -> str:
    return (
        "select session_id, fingerprint, doc_id, line_no, text from (select *, lag(text) over (partition by session_id "
        "order by line_no) as p from (select session_id, fingerprint, doc_id, line_no, "
        "regexp_replace(rtrim(text, chr(13)), '\\x1b\\[[0-9;?]*[A-Za-z]', '', 'g') as text "
        f"from {name}_lines)) where p is null or p <> text")


def twin(views: str, body: str) -> str:
    """SQL text with the named views in front. ``x_lines`` are the lines of view ``x`` and
    ``x_clean`` its cleaned lines."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes:
            return
        if name.endswith("_clean"):
            add(name[:-6] + "_lines")
            ctes[name] = _clean_cte(name[:-6])
        elif name.endswith("_lines") and name not in VIEWS:
            add(name[:-6])
            ctes[name] = _line_cte(name[:-6])
        else:
            source, exprs = VIEWS[name]
            ctes[name] = f"select {', '.join(_render(e, 'duckdb') for e in exprs)} from {source}"

    for name in views.split():
        add(name)
    head = ", ".join(f"{n} as ({q})" for n, q in ctes.items())
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


REGISTRY = Registry()
