"""The composed job: captured outputs in; emitted texts, fact rows, events and a new profile snapshot out.

Redact, choose rule sets, reduce, hold the budget, judge, put the footer on, write facts and events,
and quarantine the profiles that went over the budget or lost the trust of their readers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.functions.redaction import redact_text
from gistline.operators import account as A
from gistline.operators import bypass as B
from gistline.operators import judge as G
from gistline.operators.lines import assemble_output, explode_lines, generic_clean
from gistline.operators.versions import set_status
from gistline.plans.judge import judge
from gistline.plans.reduce import (
    MAX_BYTES, MAX_STEPS, budget_guard, choose_profiles, compile_rules, dispatch_profile, guarded_output, reduce_sessions, rule_cost,
)
from gistline.session import stored
from gistline.sources.sessions import attestation_line, raw_facts, session_facts, session_mode


@dataclass(frozen=True)
class Run:
    outputs: DataFrame  # session_id, text: the emitted text with its footer
    facts: DataFrame  # schema.SESSIONS
    events: DataFrame  # schema.FIDELITY_EVENTS
    profiles: DataFrame  # the stored profiles with their new status


def run(sessions: DataFrame, bundled: DataFrame, profiles: DataFrame, at: int, *, past_facts: DataFrame | None = None,
        past_events: DataFrame | None = None, signals: DataFrame | None = None, max_steps: int = MAX_STEPS,
        max_bytes: int = MAX_BYTES) -> Run:
    """``sessions``: session_id, fingerprint, started_at, exit_code, text; ids are unique.

    ``signals`` (session_id, signal, weight) are bypass signals seen for these sessions, as of
    ``bypass_events``; ``past_facts`` and ``past_events`` are the tables so far, which skew and rolling
    scores look at together with this run.
    """
    names = ["session_id", "fingerprint", "started_at", "exit_code", "text"]
    table = compile_rules(choose_profiles(bundled, profiles))
    keyed = stored(dispatch_profile(redact_text(sessions.select(names)), table))  # the input is read and written once
    lines = explode_lines(keyed.where("rule_key is not null"), keep=("rule_key",))
    guard = stored(budget_guard(rule_cost(lines, table), max_steps, max_bytes))
    key = ("rule_key",)
    final = stored(guarded_output(reduce_sessions(keyed, table), generic_clean(keyed, key), guard, key))
    results, subset, fidelity = judge(keyed, final, table, saved=True)
    results = stored(results)

    failed = results.where(~F.col("passed")).groupBy("session_id").agg(F.sort_array(F.collect_list("name")).alias("failed"))
    aborted = guard.where("aborted").select("session_id", F.lit(True).alias("aborted"), "detail")
    # Of a raw text its facts are joined and not the text.
    facts_of_raw = raw_facts(keyed.withColumnRenamed("text", "raw").withColumn("preserve_raw", F.lit(True)))
    texts = assemble_output(final).withColumnRenamed("text", "compressed")
    whole = (
        facts_of_raw.join(texts, "session_id", "left").withColumn("compressed", F.coalesce("compressed", F.lit("")))
        .join(fidelity, "session_id").join(failed, "session_id", "left").join(aborted, "session_id", "left")
    )
    over = F.coalesce("aborted", F.lit(False))
    mode = session_mode(F.col("rule_key").isNotNull(), F.lit(False), over)
    whole = stored(whole.withColumn("mode", mode))
    footer = attestation_line(
        F.when(F.col("rule_key").isNotNull(), F.col("fingerprint")), F.col("version"), F.col("self_fidelity"), F.col("mode"),
        F.col("session_id"), F.coalesce("failed", F.array().cast("array<string>")))
    outputs = whole.select("session_id", F.concat("compressed", footer, F.lit("\n")).alias("text"))
    facts = session_facts(whole)

    def event(df: DataFrame, kind: str, **columns) -> DataFrame:
        fields = {"session_id": "string", "profile_id": "bigint", "signal": "string", "score": "double", "weight": "double", "detail": "string"}
        return df.select(
            *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()), F.lit(kind).alias("kind"),
            F.lit(at).cast("bigint").alias("at"))

    parts = [
        G.fidelity_events(results, subset, keyed, at),
        event(whole.where("aborted"), "dsl_budget_exceeded", session_id=F.col("session_id"), profile_id=F.col("profile_id"), detail=F.col("detail")),
    ]
    if signals is not None:
        seen = signals.join(keyed.select("session_id", "profile_id"), "session_id")
        parts.append(event(seen, "bypass_signal", session_id=F.col("session_id"), profile_id=F.col("profile_id"),
                           signal=F.col("signal"), weight=F.col("weight")))
    every = facts if past_facts is None else facts.unionByName(past_facts.select(facts.columns))
    skew = A.exit_code_skew(A.exit_bucket_aggregates(every)).where("needs_relearning")
    in_use = table.rules.where("profile_id is not null").select("fingerprint", "profile_id")
    parts.append(event(skew.join(in_use, "fingerprint", "left"), "exit_code_skew", profile_id=F.col("profile_id"),
                       signal=F.col("fingerprint"), score=F.col("skew_factor")))
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    events = stored(events)
    known = events if past_events is None else events.unionByName(past_events.select(events.columns))
    distrusted = stored(B.bypass_quarantine(known.where("profile_id is not null")))
    events = events.unionByName(event(distrusted, "bypass_threshold_exceeded", profile_id=F.col("profile_id"),
                                      score=F.col("score"), detail=F.col("detail")))
    bad = whole.where("aborted and profile_id is not null").select("profile_id").unionByName(distrusted.select("profile_id"))
    return Run(outputs, facts, events, set_status(profiles, bad.select("profile_id", F.lit("quarantined").alias("status"))))
