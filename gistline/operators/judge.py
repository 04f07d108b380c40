"""Did the reduced text keep what matters? Invariants, line subset, events.

Raw and compressed sides are line tables made with ``check_lines``. Lines are filtered by
the patterns, and equal lines counted, before anything is shuffled by session; so neither a
long session nor a line repeated without end lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions import text as T
from gistline.functions.jsontext import json_valid
from gistline.functions.regex import matches, translate_column
from gistline.session import fits_broadcast, lookup


def structural_subset(raw: DataFrame, compressed: DataFrame) -> DataFrame:
    """Compressed lines that the raw side lacks. One row per session.

    ``invented`` counts occurrences; blank lines and placeholders are exempt.
    """
    text = T.rtrim(F.col("text"))
    have = raw.select("session_id", text.alias("line")).distinct()
    shown = compressed.select("session_id", text.alias("line")).groupBy("session_id", "line").agg(
        F.count(F.lit(1)).alias("n"))
    tested = ~T.is_placeholder_text(F.col("line")) & ~T.is_blank(F.col("line"))
    # One pass over the union of both sides instead of a join of large with large.
    both = have.select("session_id", "line", F.lit(1).alias("raw"), F.lit(0).cast("bigint").alias("n")).unionByName(
        shown.select("session_id", "line", F.lit(0).alias("raw"), "n"))
    per_line = both.groupBy("session_id", "line").agg(F.max("raw").alias("raw"), F.sum("n").alias("n"))
    out = per_line.groupBy("session_id").agg(
        F.sum("raw").cast("bigint").alias("lines_in_raw"),
        F.sum("n").alias("lines_in_compressed"),
        F.sum(F.when((F.col("raw") == 0) & tested, F.col("n")).otherwise(0)).alias("invented"),
    )
    return out.withColumn("passed", F.col("invented") == 0)


def all_matching_preserved(raw: DataFrame, compressed: DataFrame, pattern: str) -> DataFrame:
    """Raw lines that hit the pattern and are missing on the compressed side, by occurrence."""
    sides = [(raw, 1), (compressed, 0)]
    parts = [
        side.where(matches(F.col("text"), pattern)).groupBy("session_id", "text").agg(
            F.count(F.lit(1)).alias("n")).withColumn("is_raw", F.lit(flag))
        for side, flag in sides
    ]
    per_line = parts[0].unionByName(parts[1]).groupBy("session_id", "text").agg(
        F.sum(F.when(F.col("is_raw") == 1, F.col("n")).otherwise(0)).alias("raw_n"),
        F.min("is_raw").alias("raw_only"))
    return per_line.groupBy("session_id").agg(
        F.sum("raw_n").alias("hits"),
        F.sum(F.when(F.col("raw_only") == 1, F.col("raw_n")).otherwise(0)).alias("missing"))


def first_line(lines: DataFrame, name: str = "first_line") -> DataFrame:
    return lines.groupBy("session_id").agg(F.min_by("text", F.struct("line_no", "sub_no")).alias(name))


def last_line(lines: DataFrame, name: str = "last_line") -> DataFrame:
    return lines.groupBy("session_id").agg(F.max_by("text", F.struct("line_no", "sub_no")).alias(name))


def edge_lines_match(lines: DataFrame, sessions: DataFrame, pattern: str, last: bool = False) -> DataFrame:
    """Test the first or last line of each session; no line at all counts as an empty one."""
    edge = last_line(lines, "edge") if last else first_line(lines, "edge")
    joined = sessions.select("session_id").join(edge, "session_id", "left")
    return joined.select("session_id", matches(F.coalesce("edge", F.lit("")), pattern).alias("passed"))


def count_matches_at_least(lines: DataFrame, sessions: DataFrame, pattern: str, count: int) -> DataFrame:
    hits = lines.where(matches(F.col("text"), pattern)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    joined = sessions.select("session_id").join(hits, "session_id", "left")
    got = F.coalesce(F.col("n"), F.lit(0))
    return joined.select("session_id", got.alias("got"), (got >= count).alias("passed"))


def exit_line_preserved(raw: DataFrame, compressed: DataFrame, sessions: DataFrame) -> DataFrame:
    """True without an exit-like raw line, else whether a compressed line is one."""
    marks = raw.select("session_id", F.lit(1).alias("r"), F.lit(0).alias("c"), "text").unionByName(
        compressed.select("session_id", F.lit(0).alias("r"), F.lit(1).alias("c"), "text"))
    hits = marks.where(matches(F.col("text"), T.EXIT_LINE)).groupBy("session_id").agg(
        F.max("r").alias("r"), F.max("c").alias("c"))
    joined = sessions.select("session_id").join(hits, "session_id", "left")
    r, c = F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0))
    return joined.select("session_id", (r == 1).alias("raw_has"), ((r == 0) | (c == 1)).alias("passed"))


def invariant_results(raw: DataFrame, compressed: DataFrame, sessions: DataFrame,
                      profiles: DataFrame, compressed_texts: DataFrame | None = None) -> DataFrame:
    """One row per (session, invariant): name, passed, detail.

    ``sessions`` maps session_id to profile_id, both line tables carry profile_id, and
    ``profiles`` carries the invariants. The checks reach each line by a size-checked
    lookup, so only lines that some check asks about are shuffled, equal ones folded first.
    """
    per_profile = profiles.where(F.size("invariants") > 0).select("profile_id", F.transform(
        "invariants", lambda i: F.struct(
            i["name"].alias("name"), i["check"].alias("check"), translate_column(i["pattern"]).alias("pattern"),
            i["count"].alias("count"), i["path"].alias("path"))).alias("checks"))
    small = fits_broadcast(per_profile)

    def with_checks(df: DataFrame) -> DataFrame:
        if small:
            df = df.join(F.broadcast(per_profile), "profile_id")
        else:
            df = lookup(df, per_profile, ["profile_id"], "inner", measure=False)
        return df.withColumn("i", F.explode("checks")).drop("checks")

    check, pattern = F.col("i.check"), F.col("i.pattern")
    columns = ["session_id", "profile_id", "line_no", "sub_no", "text"]
    sided = raw.select(*columns, F.lit(1).alias("is_raw")).unionByName(
        compressed.select(*columns, F.lit(0).alias("is_raw")))
    hit = F.when(check.isin("all_matching_preserved", "count_matches_at_least"),
                 matches(F.col("text"), pattern)).when(
        check == "exit_line_preserved", matches(F.col("text"), T.EXIT_LINE)).otherwise(F.lit(False))
    folded = with_checks(sided).where(hit).groupBy("session_id", F.col("i.name").alias("name"), "text").agg(
        F.sum("is_raw").alias("raw_n"), F.sum(1 - F.col("is_raw")).alias("cmp_n"))
    facts = folded.groupBy("session_id", "name").agg(
        F.sum("raw_n").alias("raw_n"), F.sum("cmp_n").alias("cmp_n"),
        F.sum(F.when(F.col("cmp_n") == 0, F.col("raw_n")).otherwise(0)).alias("missing"))

    position = F.struct("line_no", "sub_no")
    edges = with_checks(compressed.select(*columns)).where(
        check.isin("first_line_matches", "last_line_matches")).groupBy(
        "session_id", F.col("i.name").alias("name")).agg(
        F.min_by("text", position).alias("first_line"), F.max_by("text", position).alias("last_line"))

    wanted = with_checks(sessions.where("profile_id is not null").select("session_id", "profile_id")).select(
        "session_id", "i.*")
    joined = wanted.join(facts, ["session_id", "name"], "left").join(edges, ["session_id", "name"], "left")
    if compressed_texts is None:
        joined = joined.withColumn("doc", F.lit(None).cast("string"))
    else:
        joined = joined.join(
            compressed_texts.select("session_id", F.col("text").alias("doc")), "session_id", "left")
    missing = F.coalesce("missing", F.lit(0))
    raw_n, cmp_n = F.coalesce("raw_n", F.lit(0)), F.coalesce("cmp_n", F.lit(0))
    check = F.col("check")
    passed = F.coalesce(
        F.when(check == "all_matching_preserved", missing == 0)
        .when(check == "count_matches_at_least", cmp_n >= F.col("count"))
        .when(check == "exit_line_preserved", (raw_n == 0) | (cmp_n > 0))
        .when(check == "first_line_matches", matches(F.coalesce("first_line", F.lit("")), F.col("pattern")))
        .when(check == "last_line_matches", matches(F.coalesce("last_line", F.lit("")), F.col("pattern")))
        .when(check == "json_path_exists", _path_exists(F.col("doc"), F.col("path"))), F.lit(False))
    detail = (
        F.when(passed, F.lit(None).cast("string"))
        .when(check == "all_matching_preserved", F.concat(
            missing.cast("string"), F.lit(" matching lines missing from compressed")))
        .when(check == "count_matches_at_least", F.concat(
            F.lit("expected >= "), F.col("count").cast("string"), F.lit(", got "), cmp_n.cast("string")))
        .when(check == "exit_line_preserved", F.lit("exit line missing")))
    return joined.select("session_id", "name", "check", passed.alias("passed"), detail.alias("detail"))


def _path_exists(doc: Column, path: Column) -> Column:
    """Dotted keys held in a column, walked level by level through member maps."""
    keys = F.filter(F.split(F.regexp_replace(path, r"^\$", ""), r"\."), lambda k: k != "")
    found = F.aggregate(keys, doc, lambda acc, k: F.to_json(F.get(F.map_values(F.map_filter(
        F.from_json(acc, "map<string,variant>"), lambda m, v: m == k)), F.lit(0))))
    return F.coalesce(json_valid(doc), F.lit(False)) & found.isNotNull()


def self_fidelity(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Share of invariants passed. Without a stored profile nothing is checked and the
    score is 1; with one that has no invariants it is 0."""
    agg = results.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("ok"))
    joined = sessions.select("session_id", "profile_id").join(agg, "session_id", "left")
    score = F.coalesce("ok", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    return joined.select("session_id", F.when(
        F.col("profile_id").isNull(), F.lit(1.0)).otherwise(score).alias("self_fidelity"))


def fidelity_events(results: DataFrame, subset: DataFrame, sessions: DataFrame, at: int) -> DataFrame:
    """Append-only event rows for a judged batch."""
    none = F.lit(None)
    inv = results.select(
        "session_id", F.when(F.col("passed"), "invariant_pass").otherwise("invariant_fail").alias("kind"),
        F.col("name").alias("signal"), "detail")
    sub = subset.select(
        "session_id", F.when(F.col("passed"), "structural_pass").otherwise("structural_fail").alias("kind"),
        none.cast("string").alias("signal"),
        F.when(~F.col("passed"), F.concat(F.col("invented").cast("string"), F.lit(" invented line(s)"))).alias("detail"))
    stored = sessions.where("profile_id is not null").select("session_id", "profile_id")
    return inv.unionByName(sub).join(stored, "session_id").select(
        "session_id", "profile_id", "kind", "signal", none.cast("double").alias("score"),
        none.cast("double").alias("weight"), "detail", F.lit(at).cast("bigint").alias("at"))
