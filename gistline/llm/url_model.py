"""URL filter: host and path rules, then a logistic regression on hashed character n-grams.

Everything is DataFrame and SQL functions. The model is trained by Spark's own logistic regression on a
small labelled table of URLs (``labelled``, made from word lists by a rule, or any table of url and
label). Features are the n-grams of the host and of the path between marks, with a letter in
front that tells the two apart, hashed into ``features`` places.

A rule has a host and a path: it fits its host and all subdomains where the url's path starts with
its path. The longest rule that fits decides, of equal ones that with the longer host, then the first
in the alphabet; without one the model decides.

Edge cases: a null url or one without ``://`` has an empty host and path, which no rule fits and the
model judges by its intercept; URLs of any length are read whole; repeated rows get a row each; an
empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistline.llm import common

SIZES = (3, 4, 5)
#: Words of hosts and paths for the labelled table.
BLOCKED_WORDS = [
    "spam", "cheap", "pills", "casino", "poker", "viagra", "xxx", "porn", "adult", "bet", "win-prize", "lottery", "free-money",
    "replica", "payday", "loan-now", "hot-deals", "clickbait", "link-farm", "malware", "phish", "crack", "warez", "torrent",
]
ALLOWED_WORDS = [
    "news", "docs", "wiki", "school", "library", "museum", "health", "science", "garden", "weather", "history", "travel", "kitchen",
    "forum", "radio", "theatre", "council", "paper", "river", "mountain", "thesis", "archive", "lecture", "journal",
]
FORMS = ["{w}", "best-{w}", "{w}-{o}", "{w}-online", "my{w}", "{w}{n}"]
LEADS = ["", "www.", "blog.", "m.", ""]
ENDS = ["com", "org", "net", "example.com", "example.org", "example.net", "co"]
PATHS = ["/", "/en/12", "/about.html", "/fr/345?page=2", "/de/78/", "/es/901#top", "/2020/05/post", "/en/46", "/a/b", "/en/790/", "/de/3.html"]


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label): each word in each form once, other parts in turn; label 1 is to be blocked.

    Names of plain syllables stand for the many hosts that say nothing; they are allowed.
    """
    names = [a + b + c for a in ("ba", "di", "ko", "lu", "me") for b in ("ran", "ther", "lis", "ton") for c in ("", "so")]
    rows = []
    for label, words, forms in ((1, BLOCKED_WORDS, FORMS), (0, ALLOWED_WORDS, FORMS), (0, names, FORMS[:1] + FORMS[3:4])):
        for i, word in enumerate(words):
            for j, form in enumerate(forms):
                k = i * len(forms) + j
                host = LEADS[k % len(LEADS)] + form.format(w=word, o=words[(i + 7) % len(words)], n=k % 10) + "." + ENDS[k % len(ENDS)]
                rows.append(f"('http{'s' * (k % 2)}://{host}{PATHS[k % len(PATHS)]}', {label}.0D)")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label)")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return (
        urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def _grams(text: Column, lead: str) -> Column:
    """n-grams of a text between marks; single characters are joined, so that a long text costs its length."""
    chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
    grams = []
    for n in SIZES:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(starts, lambda i, n=n: F.concat(F.lit(lead), F.array_join(F.slice(chars, i, n), ""))))
    return F.flatten(F.array(*grams))


def with_grams(parts: DataFrame) -> DataFrame:
    return parts.withColumn("grams", F.array_distinct(F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p"))))


def train(table: DataFrame, features: int = 1 << 16, ridge: float = 0.0005) -> PipelineModel:
    """Fit on (url, label)."""
    rows = with_grams(with_parts(table.select("url", F.col("label").cast("double").alias("label")).na.drop()))
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True),
        LogisticRegression(regParam=ridge, maxIter=60, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.coalesce(1))


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """The struct (verdict, host, path) of the rule that decides on columns host and path, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    data = json.dumps([dict(zip(("verdict", "host", "path"), r, strict=True)) for r in ordered])
    table = F.from_json(F.lit(data), "array<struct<verdict string, host string, path string>>")

    def fits(r: Column) -> Column:
        own = (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return own & F.startswith(F.col("path"), r["path"])

    return F.get(F.filter(table, fits), 0)


def judge(urls: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]], id_col: str, url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score), one row per input row."""
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    scored = model.transform(with_grams(with_parts(rows)))
    decided = scored.withColumn("_rule", rule_of(rules)).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return decided.select(
        F.col("id").alias(id_col), "host", "path", F.concat(F.col("_rule.host"), F.col("_rule.path")).alias("rule"),
        F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"), "score",
    )


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled(spark))
    return judge(common.table(spark, sf_dir, "pages"), model, RULES, "page_id")
