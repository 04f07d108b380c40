"""Explicit schemas of every table. Nothing here is ever inferred."""

from pyspark.sql import types as T

FORMATS = ("json", "ndjson", "diff", "stack_trace", "tabular", "log", "plain")
MODES = ("Full", "Degraded", "Passthrough", "Shadow")
STATUSES = ("pending", "active", "superseded", "quarantined")
PROVENANCES = ("bundled", "synthesized", "hand_tuned", "imported")

RULE_KINDS = (
    "keep_lines", "drop_lines", "collapse_repeated", "collapse_between", "head", "tail",
    "head_after", "tail_before", "dedup", "strip_ansi", "json_path_keep", "json_path_drop",
    "ndjson_filter", "state_machine", "truncate_to",
)
CHECK_KINDS = (
    "first_line_matches", "last_line_matches", "all_matching_preserved",
    "count_matches_at_least", "json_path_exists", "exit_line_preserved",
)

STATE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("enter", T.StringType()),
    T.StructField("keep", T.ArrayType(T.StringType())),
    T.StructField("drop", T.ArrayType(T.StringType())),
])

RULE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("pattern2", T.StringType()),
    T.StructField("placeholder", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("min", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("paths", T.ArrayType(T.StringType())),
    T.StructField("field", T.StringType()),
    T.StructField("keep_values", T.ArrayType(T.StringType())),
    T.StructField("states", T.ArrayType(STATE)),
])

INVARIANT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("path", T.StringType()),
])

SELF_TEST = T.StructType([
    T.StructField("sample_sha", T.StringType()),
    T.StructField("expected_sha", T.StringType()),
    T.StructField("expected_invariants", T.ArrayType(T.StringType())),
])

PROFILES = T.StructType([
    T.StructField("profile_id", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("provenance", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("format_claim", T.StringType()),
    T.StructField("rules", T.ArrayType(RULE)),
    T.StructField("invariants", T.ArrayType(INVARIANT)),
])

SESSIONS_RAW = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("argv", T.ArrayType(T.StringType())),
    T.StructField("agent", T.StringType()),
    T.StructField("started_at", T.LongType()),
    T.StructField("ended_at", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

LINES = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("sub_no", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_placeholder", T.BooleanType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("profile_id", T.LongType()),
    T.StructField("started_at", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("raw_sha", T.StringType()),
    T.StructField("compressed_sha", T.StringType()),
    T.StructField("raw_bytes", T.LongType()),
    T.StructField("compressed_bytes", T.LongType()),
    T.StructField("tokens_saved", T.LongType()),
    T.StructField("mode", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("captured_at", T.LongType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

FIDELITY_EVENTS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("profile_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("signal", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("detail", T.StringType()),
    T.StructField("at", T.LongType()),
])

CONTENT = T.StructType([
    T.StructField("sha256", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("ref_count", T.LongType()),
])
