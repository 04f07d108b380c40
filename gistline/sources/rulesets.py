"""The bundled rule sets: one per well-known command.

These are fixed values: fingerprints, line patterns and invariants, stated plainly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistline import schema
from gistline.session import local_frame


def keep(p):
    return {"kind": "keep_lines", "pattern": p}


def drop(p):
    return {"kind": "drop_lines", "pattern": p}


STRIP = {"kind": "strip_ansi"}
DEDUP = {"kind": "dedup"}
BLANK = drop(r"^\s*$")


def preserved(name, p):
    return {"name": name, "check": "all_matching_preserved", "pattern": p}


def at_least_one(name, p):
    return {"name": name, "check": "count_matches_at_least", "pattern": p, "count": 1}


# (fingerprint, version, format, rules, invariants)
RULESETS = [
    ("aws s3 ls", "1.1.0", "tabular",
     [STRIP, drop(r"^(A newer version|Upgrade to|aws:.*warning|\s*$)"), DEDUP], []),
    ("az webapp log tail", "1.1.0", "log",
     [STRIP, drop(r"\s(DEBUG|TRACE|VERBOSE)\s"), DEDUP], []),
    ("cargo build", "1.0.0", "plain",
     [STRIP,
      keep(r"^(error|warning|note|help|\s+Compiling|\s*-->|(\s*|\d+\s*)\||\s*=|\s+Finished |error\[)"),
      drop(r"^\s+Compiling\b")],
     [preserved("ErrorLinesPreserved", "^error"), preserved("WarningLinesPreserved", "^warning")]),
    ("cargo test", "1.0.0", "plain",
     [STRIP,
      keep(r"^(test |running |test result|\s+Running|\s+Finished|\s+Compiling .* failed|error|warning|"
           r"failures:|---- )"),
      drop(r"^\s+Compiling\b")],
     [at_least_one("TestResultPreserved", "^test result")]),
    ("docker ps", "1.1.0", "tabular",
     [STRIP, drop(r'^(WARNING: |WARN\[|DEPRECATED: |time=".*" level=(warning|info))'), BLANK, DEDUP],
     [at_least_one("HeaderPreserved", "^CONTAINER ID")]),
    ("eslint", "1.0.0", "plain",
     [STRIP,
      keep(r"^(/|\./|\.\./|[A-Za-z]:[/\\]|  [0-9]+:[0-9]+\s+(error|warning)|"
           r"\xE2\x9C\x96 [0-9]+ problems?|[✖] [0-9]+ problems?)")],
     [preserved("ErrorLinesPreserved", r"^  [0-9]+:[0-9]+\s+error")]),
    ("gh pr list", "1.1.0", "tabular",
     [STRIP, drop(r"^(gh auth|Hint: |Tip: |\! )"), BLANK, DEDUP], []),
    ("git branch -a", "1.1.0", "plain",
     [STRIP, drop(r"^\s+remotes/\S+/HEAD\s+->\s"), keep(r"^(\*?\s+\S|\s+remotes/)"), DEDUP], []),
    ("git diff", "1.0.0", "diff",
     [STRIP, keep(r"^(diff --git |index [0-9a-fA-F]+|--- |\+\+\+ |@@ |\+|-|Binary files)")],
     [preserved("HunkHeaderPreserved", "^@@ "), preserved("FileHeaderPreserved", "^diff --git ")]),
    ("git log", "1.0.0", "plain",
     [STRIP, keep(r"^(commit [0-9a-fA-F]{7,40}|Author:|Date:|Merge:|    )"), DEDUP],
     [preserved("CommitLinesPreserved", "^commit [0-9a-fA-F]{7,40}")]),
    ("git status", "1.0.0", "plain",
     [STRIP,
      keep(r"^(On branch |Your branch|HEAD detached|Changes |Untracked |nothing to |no changes |"
           r"\s+(new file|modified|deleted|renamed|typechange):|\s+[A-Za-z0-9_.-]+\s*$)"),
      drop(r"^\s*\(.*\)\s*$"), DEDUP],
     [{"name": "BranchLinePreserved", "check": "first_line_matches",
       "pattern": "^(On branch |HEAD detached|Your branch)"},
      at_least_one("NothingOrChangesLinePreserved", "^(nothing to |Changes )")]),
    ("go test", "1.0.0", "plain",
     [STRIP, keep(r"^(=== (RUN|PAUSE|CONT)|--- (PASS|FAIL|SKIP)|PASS|FAIL|ok\s|FAIL\s)")],
     [at_least_one("ResultLinePreserved", r"^(PASS|FAIL|ok\s|FAIL\s)")]),
    ("jq .", "1.0.0", "json",
     [STRIP, DEDUP],
     [{"name": "JsonWellFormed", "check": "json_path_exists", "path": "$"}]),
    ("kubectl get pods", "1.1.0", "tabular",
     [STRIP, drop(r"^(W[0-9]+|Error from server|\[.*deprecated)"),
      {"kind": "collapse_repeated", "pattern": r"^\S+\s+1/1\s+Running\s+[0-9]+\s+\S+$",
       "placeholder": "[... {count} healthy Running pods elided ...]", "min": 3},
      DEDUP],
     [at_least_one("HeaderPreserved", "^NAME")]),
    ("make", "1.0.0", "plain",
     [STRIP,
      keep(r"^(make(\[[0-9]+\])?: |gcc |cc |ld |Error |\S+:[0-9]+:[0-9]+: (error|warning|note))")],
     [preserved("ErrorLinesPreserved", "(?i)error")]),
    ("mypy <path>", "1.0.0", "plain",
     [STRIP, keep(r"^(\S+\.py:[0-9]+:\s+(error|note|warning)|Found [0-9]+ error|Success: )")],
     [preserved("ErrorLinesPreserved", r"^\S+\.py:[0-9]+:\s+error")]),
    ("npm install", "1.0.0", "plain",
     [STRIP,
      keep(r"^(npm (warn|WARN|ERR!|err!|notice)|added [0-9]+|changed [0-9]+|removed [0-9]+|"
           r"[0-9]+ (high|critical|moderate|low) severity|found [0-9]+ vulnerabilit)")],
     [preserved("ErrorLinesPreserved", "(?i)ERR!|npm err")]),
    ("psql", "1.1.0", "tabular",
     [STRIP,
      drop(r'^(Time: [0-9.]+ ms|Timing is on|You are connected|psql \(|Type "help"|SET$|BEGIN$|COMMIT$|\s*$)'),
      DEDUP],
     [preserved("RowCountPreserved", r"^\([0-9]+ rows?\)")]),
    ("pytest", "1.0.0", "plain",
     [STRIP,
      keep(r"^(=+|platform |collected |rootdir:|PASSED |FAILED |ERROR |SKIPPED |XFAIL |XPASS |"
           r"test session starts|short test summary|\S+\.py::\S+|E |_+ )")],
     [at_least_one("SummaryLinePreserved", "^=+ [0-9]+ ")]),
    ("ruff check <path>", "1.0.0", "plain",
     [STRIP, keep(r"^(\S+\.py:[0-9]+:[0-9]+:\s+[A-Z][0-9]+|Found [0-9]+ error)")],
     [preserved("LintLinesPreserved", r"^\S+\.py:[0-9]+:[0-9]+:")]),
    ("terraform plan", "1.0.0", "plain",
     [STRIP,
      keep(r"^(\s*# |Plan: [0-9]+ to add|Error:|Warning:|Terraform will perform|No changes|"
           r"\s*[+~-] resource|\s*<= data)")],
     [at_least_one("PlanSummaryPreserved", "^Plan: [0-9]+")]),
    ("tsc", "1.0.0", "plain",
     [STRIP,
      keep(r"^(\S+\([0-9]+,[0-9]+\): (error|warning) TS[0-9]+|Found [0-9]+ error|error TS[0-9]+)")],
     [preserved("ErrorsPreserved", "error TS[0-9]+")]),
]


def load_profiles(spark: SparkSession) -> DataFrame:
    """The bundled rule sets as profile rows; ids are negative so that none is a stored id."""
    rows = [
        {"profile_id": -i, "fingerprint": fp, "version": version, "schema": "1.0", "provenance": "bundled",
         "status": "active", "created_at": 0, "format_claim": claim, "rules": rules, "invariants": invariants}
        for i, (fp, version, claim, rules, invariants) in enumerate(RULESETS, 1)
    ]
    return local_frame(spark, rows, schema.PROFILES)
