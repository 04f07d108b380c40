"""Reduce whole tables of outputs, each by the rule set of its command.

A table holds outputs of thousands of commands with different rule sets. Scanning it once
per rule set, or once per kind of rule set, would not scale; so all rule sets are laid over
one common sequence of steps (``RuleTable``), and a step applies to a session only where its
rule set fills that step. The table is read once. What a step needs of a rule reaches the
lines by a size-checked lookup on one integer, when the step needs it, so the shuffled lines
carry no patterns.

Order of work: redact and clean inside the row, then the steps that look at one line, then
one exchange by session for the first step that looks at several.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistline import schema
from gistline.functions import jsontext as J
from gistline.functions.formats import with_format
from gistline.functions.regex import PatternError, matches, refused, translate, translate_column
from gistline.functions.text import DEBUG_WORD, line_bytes
from gistline.operators import ordered as O
from gistline.operators import stateless as S
from gistline.operators.formats import detect_format_lines, json_documents
from gistline.operators.lines import clean_arrays, clean_lines, clean_output
from gistline.operators.scan import MAX_TASK_LINES, WINDOW, run_ordered
from gistline.operators.versions import active_profile
from gistline.session import checkpoint, fits_broadcast, local_frame, lookup, ship, stored

# Fixed values.
MAX_STEPS = 10_000_000
MAX_BYTES = 64 * 1024 * 1024

ONE_LINE = ("strip_ansi", "keep_lines", "drop_lines", "ndjson_filter")
# What each kind of step reads of a rule.
FIELDS = {
    "strip_ansi": (), "dedup": (), "keep_lines": ("pattern",), "drop_lines": ("pattern",),
    "ndjson_filter": ("field", "keep_values"), "collapse_repeated": ("pattern", "placeholder", "min"),
    "collapse_between": ("pattern", "pattern2", "placeholder"), "head": ("n",), "tail": ("n",),
    "head_after": ("n", "pattern"), "tail_before": ("n", "pattern"), "state_machine": ("states",),
    "truncate_to": ("bytes",), "json_path_keep": ("paths",), "json_path_drop": ("paths",),
}


# First character of the key of a session's extra row; no session id starts with it.
EXTRA = "\u0000"
# Up to this many rule sets are written into the plan; more reach it by lookups.
PLAN_RULE_SETS = 64
# Up to this many different kind sequences are merged into a shortest one.
MAX_SEQUENCES = 200

RULES = T.StructType([
    T.StructField("rule_key", T.LongType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("profile_id", T.LongType()),
    T.StructField("tier", T.StringType()), T.StructField("steps", T.ArrayType(schema.RULE)),
    T.StructField("invariants", T.ArrayType(schema.INVARIANT)),
])


@dataclass(frozen=True)
class RuleTable:
    """Rule sets laid over common steps: ``rules`` has one row per rule set, whose ``steps``
    array holds a rule or null for each step. ``known`` are the same rows on the driver when
    they are few; ``rule_key`` is then their position in it."""

    steps: list[str]
    rules: DataFrame
    known: list[dict] | None
    small: bool

    def attach(self, df: DataFrame, columns: list[str], on: str, how: str = "left") -> DataFrame:
        narrow = self.rules.select(on, *[c for c in columns if c != on])
        if self.small:
            return df.join(F.broadcast(narrow), on, how)
        return lookup(df, narrow, [on], how, measure=False)

    def at_step(self, df: DataFrame, i: int) -> DataFrame:
        """Lines with ``__r``, their rule for this step, or null. Patterns are translated."""
        wanted = FIELDS[self.steps[i]]
        if self.known is not None:
            rules = [p["steps"][i] and {"kind": self.steps[i], **{f: p["steps"][i][f] for f in wanted}}
                     for p in self.known]
            part = T.ArrayType(T.StructType([schema.RULE["kind"], *[schema.RULE[f] for f in wanted]]))
            # One folded literal, read by position.
            literal = F.from_json(F.lit(json.dumps(rules)), part)
            return df.withColumn("__r", F.get(literal, F.col("rule_key").cast("int")))
        rule = F.get("steps", F.lit(i))
        part = F.struct(rule["kind"].alias("kind"), *[rule[f].alias(f) for f in wanted])
        users = self.rules.where(rule.isNotNull()).select("rule_key", part.alias("__r"))
        if self.small:
            return df.join(F.broadcast(users), "rule_key", "left")
        return lookup(df, users, ["rule_key"], "left", measure=False)


def _translated(rule: dict) -> dict:
    out = dict(rule)
    for f in ("pattern", "pattern2"):
        out[f] = rule[f] and translate(rule[f])
    out["states"] = rule["states"] and [
        {"name": s["name"], "enter": translate(s["enter"]), "keep": [translate(p) for p in s["keep"] or ()],
         "drop": [translate(p) for p in s["drop"] or ()]} for s in rule["states"]]
    return out


def _translated_column(rule: Column) -> Column:
    states = F.transform(rule["states"], lambda s: F.struct(
        s["name"].alias("name"), translate_column(s["enter"]).alias("enter"),
        F.transform(s["keep"], translate_column).alias("keep"), F.transform(s["drop"], translate_column).alias("drop")))
    return rule.withField("pattern", translate_column(rule["pattern"])).withField(
        "pattern2", translate_column(rule["pattern2"])).withField("states", states)


def common_sequence(sequences: list[tuple[str, ...]]) -> list[str]:
    """A short sequence of kinds that contains every given one in order. Among equally short
    ones, steps that look at one line come first, so that they run before the exchange."""

    def cost(s: tuple) -> tuple[int, int]:
        first = next((i for i, k in enumerate(s) if k not in ONE_LINE), len(s))
        return len(s), sum(k in ONE_LINE for k in s[first:])

    def merge(a: tuple, b: tuple) -> tuple:
        best: dict[tuple[int, int], tuple] = {}
        for i in range(len(a), -1, -1):
            for j in range(len(b), -1, -1):
                if i == len(a) or j == len(b):
                    best[i, j] = (*a[i:], *b[j:])
                elif a[i] == b[j]:
                    best[i, j] = (a[i], *best[i + 1, j + 1])
                else:
                    best[i, j] = min((a[i], *best[i + 1, j]), (b[j], *best[i, j + 1]), key=cost)
        return best[0, 0]

    # Longest first; among those, the ones that bring the most one-line steps.
    ordered = sorted(set(sequences), key=lambda s: (-len(s), -sum(k in ONE_LINE for k in s), s))
    return list(fold(merge, ordered, ()))


def _places(sequence: tuple[str, ...], steps: list[str]) -> list[int]:
    out, at = [], 0
    for kind in sequence:
        at = steps.index(kind, at)
        out.append(at)
        at += 1
    return out


def all_patterns(profiles: DataFrame) -> DataFrame:
    """(pattern) of all rules, of the states of all state machines and of all invariants."""
    none = F.array().cast("array<string>")

    def of_rule(r: Column) -> Column:
        states = F.flatten(F.transform(F.coalesce(r["states"], F.array().cast(schema.RULE["states"].dataType)), lambda s: F.concat(
            F.array(s["enter"]), F.coalesce(s["keep"], none), F.coalesce(s["drop"], none))))
        return F.concat(F.array(r["pattern"], r["pattern2"]), states)

    rules = F.flatten(F.transform("rules", of_rule))
    checks = F.coalesce(F.transform("invariants", lambda i: i["pattern"]), none)
    return profiles.select(F.explode(F.array_compact(F.concat(rules, checks))).alias("pattern"))


def compile_rules(profiles: DataFrame) -> RuleTable:
    """Lay rule sets over common steps.

    All patterns are checked first, those of states and invariants too, by one rule for any number of rule sets.
    A few rule sets are read to the driver and become literals. Of many, only distinct kind
    sequences reach the driver: the bundled rule sets have nine, and learned ones add two,
    however many there are.
    """
    spark = ship(profiles.sparkSession)
    first = [r.asDict(recursive=True) for r in profiles.limit(PLAN_RULE_SETS + 1).collect()]
    if len(first) <= PLAN_RULE_SETS:
        steps = common_sequence([tuple(r["kind"] for r in p["rules"]) for p in first])
        known = []
        for key, p in enumerate(first):
            for pattern in filter(None, (i["pattern"] for i in p["invariants"] or ())):
                translate(pattern)  # refuses what is no pattern
            stored = p["provenance"] != "bundled"
            places = _places(tuple(r["kind"] for r in p["rules"]), steps)
            known.append({
                "rule_key": key, "fingerprint": p["fingerprint"], "version": p["version"],
                "profile_id": p["profile_id"] if stored else None, "tier": "learned" if stored else "bundled",
                "steps": [_translated(p["rules"][places.index(k)]) if k in places else None for k in range(len(steps))],
                "invariants": p["invariants"]})
        return RuleTable(steps, local_frame(spark, known, RULES), known, True)

    profiles = checkpoint(profiles)
    bad = refused(all_patterns(profiles)).first()
    if bad is not None:
        raise PatternError(f"{bad.problem}: {bad.pattern}")
    kinds = F.transform("rules", lambda r: r["kind"])
    keyed = profiles.withColumn("kinds", kinds)
    sequences = [tuple(r.kinds) for r in keyed.select("kinds").distinct().limit(MAX_SEQUENCES + 1).collect()]
    if len(sequences) <= MAX_SEQUENCES:
        steps = common_sequence(sequences)
        placed = spark.createDataFrame(
            [(list(s), _places(s, steps)) for s in sequences], "kinds array<string>, places array<int>")
        df = keyed.join(F.broadcast(placed), "kinds")  # at most MAX_SEQUENCES rows
    else:
        # No common order worth looking for: each position offers every kind in use.
        used = sorted(r.k for r in keyed.select(F.explode("kinds").alias("k")).distinct().collect())
        steps = used * keyed.agg(F.max(F.size("kinds"))).first()[0]
        every = F.array(*[F.lit(k) for k in used])
        df = keyed.withColumn("places", F.transform("kinds", lambda k, i: (
            i * len(used) + F.array_position(every, k) - 1).cast("int")))
    slots = F.transform(F.sequence(F.lit(0), F.lit(max(len(steps) - 1, 0))), lambda k: F.get(
        F.transform("rules", _translated_column), (F.array_position(F.col("places"), k) - 1).cast("int")))
    stored = F.col("provenance") != "bundled"
    rules = checkpoint(df.select(
        F.col("profile_id").alias("rule_key"), "fingerprint", "version",
        F.when(stored, F.col("profile_id")).alias("profile_id"),
        F.when(stored, "learned").otherwise("bundled").alias("tier"), slots.alias("steps"), "invariants"))
    return RuleTable(steps, rules, None, fits_broadcast(rules))


def choose_profiles(bundled: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One profile per fingerprint: the newest active stored one, else the bundled one."""
    if stored is None:
        return bundled
    active = active_profile(stored)
    return active.unionByName(bundled.join(active.select("fingerprint"), "fingerprint", "left_anti"))


def dispatch_profile(sessions: DataFrame, table: RuleTable) -> DataFrame:
    """Sessions with rule_key, profile_id, version and tier; exactly one tier each."""
    df = table.attach(sessions, ["rule_key", "profile_id", "version", "tier"], "fingerprint")
    return df.withColumn("tier", F.coalesce("tier", F.lit("format")))


def apply_step(df: DataFrame, kind: str, order=WINDOW) -> DataFrame:
    """One step on lines that carry their rule as ``__r``."""
    r, when = (lambda f: F.col(f"__r.{f}")), F.col("__r").isNotNull()
    if kind == "strip_ansi":
        return S.strip_ansi(df, when)
    if kind == "keep_lines":
        return S.keep_lines(df, r("pattern"), when)
    if kind == "drop_lines":
        return S.drop_lines(df, r("pattern"), when)
    if kind == "ndjson_filter":
        return S.ndjson_filter(df, r("field"), r("keep_values"), when)
    if kind == "dedup":
        return O.dedup_adjacent(df, order, when)
    if kind == "collapse_repeated":
        return O.collapse_repeated(df, r("pattern"), r("placeholder"), F.coalesce(r("min"), F.lit(3)), order, when)
    if kind == "collapse_between":
        return O.collapse_between(df, r("pattern"), r("pattern2"), r("placeholder"), order, when)
    if kind in ("head", "tail"):
        return getattr(O, kind)(df, r("n"), order, when)
    if kind in ("head_after", "tail_before"):
        return getattr(O, kind)(df, r("n"), r("pattern"), order, when)
    if kind == "state_machine":
        return O.state_machine(df, r("states"), order, when)
    if kind == "truncate_to":
        return O.truncate_to(df, r("bytes"), order, when)
    return _json_step(df, kind, order)


def _json_step(df: DataFrame, kind: str, order) -> DataFrame:
    """JSON steps work on the whole text of the sessions that use them; a text that is no
    JSON keeps its lines.

    One aggregation: lines of other sessions are groups of their own, and the paths come with the lines
    as values, so neither the number of rule sets nor that of their path lists changes the plan. A document fits a
    row, as its reduced form is one line. Under a plan for long sessions, those that are no documents are told
    apart first, piece by piece, and never put together.
    """
    names = [c for c in df.columns if not c.startswith("__")]
    extra = [c for c in names if c not in ("session_id", "line_no", "sub_no", "text", "is_placeholder")]
    df = df.withColumn("__paths", F.col("__r.paths"))
    if order is not WINDOW:
        df = checkpoint(df)
        found = stored(json_documents(df.where("__paths is not null"), scalars=True).select(F.col("session_id").alias("__id")))
        found = F.broadcast(found) if fits_broadcast(found) else found
        df = df.join(found.withColumn("__is", F.lit(True)), F.col("session_id").eqNullSafe(F.col("__id")), "left")
        df = df.withColumn("__paths", F.when(F.col("__is"), F.col("__paths")))
    own = F.when(F.col("__paths").isNull(), F.struct("line_no", "sub_no"))
    line = F.struct("line_no", "sub_no", "text", "is_placeholder")
    groups = df.withColumn("__own", own).groupBy("session_id", "__own").agg(
        *[F.first(c).alias(c) for c in extra], F.first("__paths").alias("__paths"), F.array_sort(F.collect_list(line)).alias("__lines"))
    text = F.when(F.col("__paths").isNotNull(), F.array_join("__lines.text", "\n"))
    change = J.json_path_keep if kind == "json_path_keep" else J.json_path_drop
    done = change(groups.withColumns({"__text": text, "__new": text}), "__new", F.col("__paths"))
    zero = {c: F.lit(0).cast(df.schema[c].dataType).alias(c) for c in ("line_no", "sub_no")}
    single = F.array(F.struct(*zero.values(), F.col("__new").alias("text"), F.lit(False).alias("is_placeholder")))
    lines = F.when(F.col("__paths").isNotNull() & J.json_valid(F.col("__text")), single).otherwise(F.col("__lines"))
    return done.select("session_id", *extra, F.explode_outer(lines).alias("__x")).where("__x is not null").select(
        *[F.col(c) if c == "session_id" or c in extra else F.col(f"__x.{c}").alias(c) for c in names])


def apply_rules(lines: DataFrame, table: RuleTable, order=WINDOW) -> DataFrame:
    """All steps over lines that carry ``rule_key``; lines without one are unchanged."""
    for i, kind in enumerate(table.steps):
        lines = apply_step(table.at_step(lines, i), kind, order).drop("__r")
    return lines


def clean_and_dispatch(sessions: DataFrame, table: RuleTable, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned line arrays with rule_key, and the format class where no rule set applies."""
    dispatched = dispatch_profile(sessions.select("session_id", "fingerprint", "text", *keep), table)
    arrays = clean_arrays(dispatched, ("fingerprint", "rule_key", "profile_id", "version", "tier", *keep))
    unmatched = arrays.withColumn("_out", F.when(F.col("tier") == "format", clean_output()))
    return with_format(unmatched, "_out").drop("_out")


def _reduce(lines: DataFrame, table: RuleTable, order) -> DataFrame:
    noise = (F.col("format") == "log") & matches(F.col("text"), DEBUG_WORD)
    return apply_rules(lines.where(~F.coalesce(noise, F.lit(False))).drop("format"), table, order)


def reduce_sessions(sessions: DataFrame, table: RuleTable, order=WINDOW) -> DataFrame:
    """Reduced lines of every session, with rule_key."""
    cleaned = clean_and_dispatch(sessions, table)
    return _reduce(clean_lines(cleaned, ("rule_key", "profile_id", "format")), table, order)


def session_sizes(sessions: DataFrame, table: RuleTable, order=WINDOW) -> DataFrame:
    """Raw and reduced bytes of every session, also of those no line is left of.

    Joining the reduced lines back to the sessions would read, redact and clean all texts
    twice. Instead each session sends one extra row along with its lines, under a key of its
    own and without a rule, so that no step touches it; it carries the raw size to the sums.
    """
    raw = sessions.withColumn("raw_bytes", F.octet_length("text").cast("bigint"))
    cleaned = clean_and_dispatch(raw, table, ("raw_bytes",))
    extra = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("t"),
                             F.lit(True).alias("fresh")))
    rows = cleaned.select("session_id", "fingerprint", "rule_key", "format", "raw_bytes",
                          F.explode(F.concat("clean", extra)).alias("_x"))
    mark = F.col("_x.t").isNull()
    lines = rows.select(
        F.when(mark, F.concat(F.lit(EXTRA), "session_id")).otherwise(F.col("session_id")).alias("session_id"),
        F.coalesce("_x.i", F.lit(0)).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("sub_no"),
        F.col("_x.t").alias("text"), mark.alias("is_placeholder"),
        *[F.when(~mark, F.col(c)).alias(c) for c in ("rule_key", "format")],
        *[F.when(mark, F.col(c)).alias(c) for c in ("fingerprint", "raw_bytes")])
    out = _reduce(lines, table, order)
    is_extra = F.col("session_id").startswith(EXTRA)
    own = F.when(is_extra, F.substring("session_id", 2, 2_147_483_647)).otherwise(F.col("session_id"))
    return out.groupBy(own.alias("session_id")).agg(
        F.max("fingerprint").alias("fingerprint"), F.max("raw_bytes").alias("raw_bytes"),
        F.sum(F.when(is_extra, F.lit(0)).otherwise(line_bytes(F.col("text")))).alias("compressed_bytes"))


def reduce_lines(lines: DataFrame, table: RuleTable, max_lines: int = MAX_TASK_LINES,
                 parts: int | None = None) -> DataFrame:
    """Reduce sessions that come as line tables, of any length. Lines carry a fingerprint.

    The same passes as for texts; here the repeats need the order of lines, so they run
    under the plan the length of a session allows.
    """
    keyed = dispatch_profile(lines, table).drop("fingerprint", "version", "profile_id")
    cleaned = S.strip_ansi(S.strip_cr(keyed))

    def chain(df: DataFrame, order) -> DataFrame:
        df = checkpoint(O.dedup_adjacent(df, order))  # read for the classes and for the rules
        formats = stored(detect_format_lines(df.where("tier = 'format'"), order).where("format = 'log'"))
        # Sessions too long for one task are few, so theirs is a small table.
        tagged = df.join(F.broadcast(formats) if fits_broadcast(formats) else formats, "session_id", "left")
        kept = S.drop_debug_lines(tagged.withColumn("format", F.coalesce("format", F.lit("")))).drop("format", "tier")
        return apply_rules(kept, table, order)

    return run_ordered(cleaned, chain, max_lines, parts)


def rule_cost(lines: DataFrame, table: RuleTable, order=WINDOW) -> DataFrame:
    """Per session: lines visited by all rules, and most bytes held before or after a rule.

    Steps that look at one line are costed together in one aggregation, by marking lines
    instead of removing them; each later step adds one aggregation.
    """
    parts, i = [], 0
    size = F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    while i < len(table.steps) and table.steps[i] in ONE_LINE:
        i += 1
    marked = lines.withColumn("__alive", F.lit(True)).withColumns({"__visits": zero, "__b0": size})
    sums = ["__b0"]
    for k in range(i):
        kind = table.steps[k]
        df = table.at_step(marked, k)
        used = F.col("__r").isNotNull() & F.col("__alive")
        ticks = used if kind != "ndjson_filter" else F.lit(False)
        marked = df.withColumn("__visits", F.col("__visits") + ticks.cast("bigint"))
        if kind == "strip_ansi":
            marked = S.strip_ansi(marked, used)
        else:
            stays = _stays(kind)
            marked = marked.withColumn("__alive", F.col("__alive") & (~used | F.col("is_placeholder") | stays))
        marked = marked.withColumn(f"__b{k + 1}", F.when(F.col("__alive"), size).otherwise(zero)).drop("__r")
        sums.append(f"__b{k + 1}")
    peak = F.greatest(*[F.sum(c) for c in sums], zero)
    parts.append(marked.groupBy("session_id").agg(F.sum("__visits").alias("steps"), peak.alias("peak")))
    alive = marked.where("__alive").drop("__alive", "__visits", *sums)
    for k in range(i, len(table.steps)):
        kind = table.steps[k]
        # Read for the cost of this step and for the step itself.
        alive = checkpoint(alive)
        df = table.at_step(alive, k)
        # What a session holds before this step is what it held after its last one.
        parts.append(_step_cost(df, kind, order))
        alive = apply_step(df, kind, order).drop("__r")
    if i < len(table.steps):
        parts.append(alive.groupBy("session_id").agg(zero.alias("steps"), F.sum(size).alias("peak")))
    every = fold(DataFrame.unionByName, parts)
    return every.groupBy("session_id").agg(F.sum("steps").alias("steps"), F.max("peak").alias("peak_bytes"))


def _stays(kind: str) -> Column:
    text = F.col("text")
    if kind == "keep_lines":
        return F.coalesce(matches(text, F.col("__r.pattern")), F.lit(False))
    if kind == "drop_lines":
        return ~F.coalesce(matches(text, F.col("__r.pattern")), F.lit(False))
    return J.ndjson_keeps(text, F.col("__r.field"), F.col("__r.keep_values"))


def _step_cost(df: DataFrame, kind: str, order) -> DataFrame:
    used = F.col("__r").isNotNull()
    n = F.count(F.lit(1))
    if kind in ("head_after", "tail_before"):
        hit = ~F.col("is_placeholder") & matches(F.col("text"), F.col("__r.pattern"))
        df = O.order_rows(df, order).withColumn("__at", F.when(hit, F.col("__rn")))
        limit, anchor = F.max("__r.n"), F.min("__at")
        if kind == "head_after":
            visits = F.least(n, F.coalesce(anchor + limit + 1, n))
        else:
            visits = F.when(anchor.isNull(), n).otherwise(
                anchor + n - F.greatest(anchor - 1 - limit, F.lit(0)))
    elif kind in ("head", "tail"):
        visits = F.least(n, F.max("__r.n"))
    elif kind in ("truncate_to", "json_path_keep", "json_path_drop"):
        visits = F.lit(0)
    else:
        visits = n
    return df.groupBy("session_id").agg(
        F.when(F.max(used), visits).otherwise(0).cast("bigint").alias("steps"),
        F.sum(F.octet_length("text").cast("bigint")).alias("peak"))


def budget_guard(cost: DataFrame, max_steps: int = MAX_STEPS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Which sessions went over the budget, and the event text of it."""
    over = (F.col("steps") > max_steps) | (F.col("peak_bytes") > max_bytes)
    return cost.select("session_id", "steps", "peak_bytes", over.alias("aborted"), F.when(
        over, "rule budget exceeded; profile quarantined").alias("detail"))


def guarded_output(reduced: DataFrame, cleaned: DataFrame, guard: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reduced lines, or the cleaned ones for a session that went over the budget. Only the
    ids of aborted sessions, a handful, are joined to the lines."""
    aborted = stored(guard.where("aborted").select("session_id"))
    names = ["session_id", "line_no", "sub_no", "text", "is_placeholder", *keep]
    if fits_broadcast(aborted):
        aborted = F.broadcast(aborted)
    return reduced.select(names).join(aborted, "session_id", "left_anti").unionByName(
        cleaned.select(names).join(aborted, "session_id", "left_semi"))
