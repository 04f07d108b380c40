"""Quality rules by cross-document line frequency.

A text is split at line feeds, each line is normalised (lower case, digits as 0, white space
folded) and hashed. Per host, the documents of different text that hold a line are counted. A
line in more than ``min_docs`` of them and more than ``min_share`` of the host's documents is
boilerplate, and so is one in more than ``many_docs`` (if given) whatever its share, so that the
limit does not rise on with the host. It is taken out of every document of the host but the first (smallest id) that has
it. A document left with less than ``min_left`` of its words is depleted and rejected. ``judge``
counts, ``keep`` gives the passing rows as they are, ``clean`` gives them without their boilerplate.

Edge cases: a null text has no words and fails the base rule; a null host is a host of its own;
rows that repeat a document get the same verdict each; copies of one text count as one document,
so a group of exact copies does not make its own lines frequent. An empty table gives no rows.
Other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents of different text that make a line boilerplate in a host of any size.
MANY_DOCS = 1000
BASE = "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(docs: list[list[str]], width: int = 5) -> np.ndarray:
    """Per document, its words inside ``width``-word windows that are found twice or more in it."""
    counts = np.array([len(d) for d in docs], np.int64)
    n = int(counts.sum())
    if not n:
        return np.zeros(len(docs), np.int64)
    ids = common.WordIds()([w for d in docs for w in d]).astype(np.uint64)
    owner = np.repeat(np.arange(len(docs), dtype=np.int64), counts)
    covered = np.zeros(n + 1, np.int64)
    starts = np.arange(max(0, n - width + 1))
    starts = starts[owner[starts] == owner[starts + width - 1]] if len(starts) else starts
    if len(starts):
        code = common.mix(owner[starts].astype(np.uint64), 7)
        for k in range(width):
            code = common.mix(code + ids[starts + k], k)
        order = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[order][1:] == code[order][:-1])
        first, second = starts[order[same]], starts[order[same + 1]]
        alike = owner[first] == owner[second]
        for k in range(width):
            alike &= ids[first + k] == ids[second + k]
        if not alike.all():  # two different windows with one 64-bit code: count without codes
            return np.array([_repeat_words_exact(d, width) for d in docs], np.int64)
        hit = np.unique(np.concatenate([first, second]))
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + width, -1)
    inside = np.cumsum(covered)[:n] > 0
    return np.bincount(owner[inside], minlength=len(docs))


def _repeat_words_exact(words: list[str], width: int) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]  # bytes split at the six ASCII separators only


def base_measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row key..., text) to (row key..., n_words and the base counts)."""
    for batch in batches:
        keys = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        rows = []
        texts = common.texts(batch, "text")
        docs = [t.encode().split() for t in texts]
        repeats = repeat_words(docs)
        for text, words, repeated in zip(texts, docs, repeats.tolist(), strict=True):
            seen: set[str] = set()
            dup = 0
            if "\n" in text:
                for line in text.split("\n"):
                    if line in seen:
                        dup += bool(line.strip(SEPARATORS))
                    else:
                        seen.add(line)
            rows.append((len(words), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), dup, repeated))
        counts = np.array(rows, np.int64).reshape(len(rows), 5)
        yield pa.RecordBatch.from_arrays(
            [*keys, *(pa.array(counts[:, i]) for i in range(5))],
            names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return base_measures(common.slices(batches, "text"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_key, line_key, words, places): one row per document and different line."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "))
    lines = docs.select("doc_id", "host", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "line")).select(
        "doc_id", "host", "text_key", "place", line.alias("line")
    )
    return (
        lines.where(F.col("line") != "")
        .select("doc_id", "host", "text_key", "place", F.xxhash64("line").alias("line_key"), F.size(F.split("line", " ")).alias("words"))
        .groupBy("doc_id", "host", "text_key", "line_key")
        .agg(F.sum("words").alias("words"), F.collect_list("place").alias("places"))
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_docs: int, min_share: float, many_docs: int | None = None) -> DataFrame:
    """(host, line_key, first_doc) of the lines above the limits."""
    counted = (
        lines.groupBy("host", "line_key", "text_key").agg(F.min("doc_id").alias("first_doc"))
        .groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n"), F.min("first_doc").alias("first_doc"))
        .where(F.col("n") > min_docs)
    )
    limit = hosts.withColumnRenamed("host", "_host")
    often = F.col("n") > min_share * F.col("n_host")
    if many_docs is not None:
        often = often | (F.col("n") > many_docs)
    return counted.join(limit, F.col("host").eqNullSafe(F.col("_host"))).where(often).select("host", "line_key", "first_doc")


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", *,
          min_docs: int = 10, min_share: float = 0.005, min_left: float = 0.3, many_docs: int | None = None) -> DataFrame:
    """One row per input row: doc_id, host, the base counts, removed_words, removed_places, depleted and kept."""
    common.ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    key = ["doc_id", "host", "text_key"]
    fields = [docs.schema[c] for c in key]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", n_words long, {BASE}"
    measured = docs.mapInArrow(_sliced, schema)
    lines = line_rows(docs)
    hosts = docs.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    frequent = frequent_lines(lines, hosts, min_docs, min_share, many_docs).select(
        F.col("host").alias("_host"), F.col("line_key").alias("_line"), "first_doc"
    )
    hit = (F.col("line_key") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))
    removed = (
        lines.join(frequent, hit).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(*key).agg(F.sum("words").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"),
                            F.flatten(F.collect_list("places")).alias("removed_places"))
        .select(*(F.col(c).alias("_" + c) for c in key), "removed_words", "removed_lines", "removed_places")
    )
    on = (F.col("text_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("host").eqNullSafe(F.col("_host"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    return measured.join(removed, on, "left").select(
        *key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("removed_words"), F.coalesce("removed_lines", F.lit(0).cast("bigint")).alias("removed_lines"),
        F.coalesce("removed_places", F.array().cast("array<int>")).alias("removed_places"), failed.alias("base_failed"),
        ((gone > 0) & (F.col("n_words") - gone < min_left * F.col("n_words"))).alias("depleted"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents that pass, with their own columns."""
    own_id, own_host, own_key = common.fresh(docs, "kept_id", "kept_host", "kept_key")
    judged = judge(docs, **options).where("kept").select(
        F.col("doc_id").alias(own_id), F.col("host").alias(own_host), F.col("text_key").alias(own_key)
    ).distinct()
    name = {"id_col": "doc_id", "host_col": "source", "text_col": "text"} | options
    on = (
        F.col(name["id_col"]).eqNullSafe(F.col(own_id)) & F.col(name["host_col"]).cast("string").eqNullSafe(F.col(own_host))
        & (F.xxhash64(F.coalesce(F.col(name["text_col"]), F.lit(""))) == F.col(own_key))
    )
    return docs.join(judged, on, "left_semi")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents that pass, with their own columns and without their boilerplate lines."""
    own_id, own_host, own_key, places, split = common.fresh(docs, "clean_id", "clean_host", "clean_key", "clean_places", "clean_lines")
    judged = judge(docs, **options).where("kept").select(
        F.col("doc_id").alias(own_id), F.col("host").alias(own_host), F.col("text_key").alias(own_key), F.col("removed_places").alias(places),
    ).dropDuplicates([own_id, own_host, own_key])
    name = {"id_col": "doc_id", "host_col": "source", "text_col": "text"} | options
    text = F.col(name["text_col"])
    on = (
        F.col(name["id_col"]).eqNullSafe(F.col(own_id)) & F.col(name["host_col"]).cast("string").eqNullSafe(F.col(own_host))
        & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_key))
    )
    # array_except hashes, so a text of many removed lines costs no more than its length.
    rows = docs.join(judged, on).withColumn(split, F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), places)
    rest = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return rows.withColumn(name["text_col"], F.when(F.size(places) > 0, rest).otherwise(text)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), many_docs=MANY_DOCS).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words", "removed_lines",
    )
