"""Judge a reduced batch: invariants, line subset, fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.operators import judge as G
from gistline.operators.lines import assemble_output, explode_lines
from gistline.plans.reduce import RuleTable
from gistline.session import checkpoint


def judge(sessions: DataFrame, reduced: DataFrame, table: RuleTable,
          documents: bool = True, saved: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invariant results, subset results and self-fidelity.

    ``sessions``: session_id, rule_key, profile_id, text (redacted raw). ``reduced``: lines
    with rule_key. ``documents`` gives the JSON checks the assembled
    texts; ``saved`` says that ``reduced`` is a table already. The invariants of bundled rule sets are checked too; their fidelity
    stays 1 as no stored profile stands behind it.
    """
    if not saved:
        reduced = checkpoint(reduced)  # read by every check below
    checks = table.rules.select(F.col("rule_key").alias("profile_id"), "invariants")
    keyed = sessions.withColumn("profile_id", F.col("rule_key"))
    raw = explode_lines(keyed, True, ("profile_id",))
    cmp = reduced.withColumn("profile_id", F.col("rule_key"))
    texts = None
    if documents:
        # Only sessions with a JSON check are assembled.
        wants = table.rules.where(F.exists("invariants", lambda i: i["check"] == "json_path_exists")).select("rule_key")
        texts = assemble_output(reduced.join(wants, "rule_key", "left_semi"))
    results = G.invariant_results(raw, cmp, keyed, checks, texts)
    subset = G.structural_subset(raw, reduced)
    return results, subset, G.self_fidelity(results, sessions)
