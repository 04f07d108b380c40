"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of a document's words, each word between two marks:
whether one is there, and whether it is in two different words, as a stem in two inflections is. Training reads at most ``max_rows`` labelled documents (those first in the order of
a hash of the id). Log-count ratios of the two classes are summed from them in the cluster; the
``keep`` features that tell the classes apart best are kept, scaled by their ratio, and a logistic
regression is fitted to them. Every whole document is then scored in Arrow batches; a worker remembers
the features of words.

Edge cases: a null or empty text has no features and gets the score of the intercept; rows of an id
that has several labels train with each; without rows of both classes the score is the smoothed
share of toxic rows; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

WORD = regex.compile(r"[^\s\p{P}\p{S}]+")
SIZES = (3, 4, 5, 6)
#: Buckets of n-grams; that of an n-gram found in two words lies so far behind its own.
TWICE = 1 << 20
REMEMBERED = 400_000


def grams(word: str) -> set[int]:
    """Hash buckets of the n-grams of one word, however long."""
    w = f"\x02{word}\x03"
    return {xxhash.xxh32_intdigest(w[i : i + n]) & (TWICE - 1) for n in SIZES for i in range(len(w) - n + 1)}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (toxic, features as little-endian uint32)."""
    known: dict[str, set[int]] = {}
    for batch in common.slices(batches, "text"):
        rows = []
        for text in common.texts(batch, "text"):
            once: set[int] = set()
            twice: set[int] = set()
            for w in words_of(text):
                f = known.get(w)
                if f is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    f = known[w] = grams(w)
                twice |= once & f
                once |= f
            rows.append(np.array([*sorted(once), *(f + TWICE for f in sorted(twice))], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], names=["toxic", "features"])


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and class of one task, as arrays: a bounded row."""
    counts, rows = np.zeros((2, 2 * TWICE), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for toxic, f in zip(batch.column("toxic").to_pylist(), batch.column("features").to_pylist(), strict=True):
            counts[toxic, np.frombuffer(f, "<u4")] += 1
            rows[toxic] += 1
    at = [np.flatnonzero(c) for c in counts]
    yield pa.RecordBatch.from_pydict({
        "toxic": pa.array([0, 1], pa.int32()), "n": pa.array(rows), "feature": [a.tolist() for a in at],
        "docs": [c[a].tolist() for c, a in zip(counts, at, strict=True)],
    })


class Model:
    """Weights of the kept features, with the ratios multiplied in."""

    def __init__(self, bias: float, features: np.ndarray, weights: np.ndarray):
        self.bias = bias
        self.weights = dict(zip(features.tolist(), weights.tolist(), strict=True))

    def word(self, word: str) -> tuple[int, ...]:
        """Of the n-grams of a word those that any weight asks for."""
        return tuple(sorted(f for f in grams(word) if f in self.weights or f + TWICE in self.weights))

    def score(self, words: list[tuple[int, ...]]) -> float:
        once: set[int] = set()
        twice: set[int] = set()
        for f in words:
            twice.update(once.intersection(f))
            once.update(f)
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in sorted(once)) + sum(get(f + TWICE, 0.0) for f in sorted(twice))


def fit(labelled: DataFrame, *, keep: int = 4096, alpha: float = 1.0, ridge: float = 1e-3, steps: int = 400, rate: float = 0.05) -> Model:
    """Train on (toxic, text). Toxic rows weigh more, by the root of how rare they are."""
    labelled = common.stored(labelled.mapInArrow(featured, "toxic int, features binary"))
    tally = common.stored(labelled.mapInArrow(tallied, "toxic int, n long, feature array<long>, docs array<long>"))
    sizes = {r["toxic"]: r["n"] for r in tally.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n = [sizes.get(0, 0), sizes.get(1, 0)]
    bias = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if not all(n):
        return Model(bias, np.zeros(0, np.int64), np.zeros(0))
    counts = common.stored(tally.select("toxic", F.explode(F.arrays_zip("feature", "docs")).alias("x")).groupBy("x.feature").agg(
        *(F.sum(F.when(F.col("toxic") == c, F.col("x.docs")).otherwise(0)).alias(f"c{c}") for c in (0, 1))
    ))
    whole = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    share = [(F.col(f"c{c}") + alpha) / (whole[f"c{c}"] + alpha * whole["v"]) for c in (0, 1)]
    # how far the shares of documents differ, in standard errors
    both = (F.col("c0") + F.col("c1")) / sum(n)
    apart = F.abs(F.col("c1") / n[1] - F.col("c0") / n[0]) / F.sqrt((both * (1 - both) + 1e-9) * (1 / n[0] + 1 / n[1]))
    best = counts.select("feature", F.log(share[1] / share[0]).alias("ratio"), apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(keep).collect()
    chosen, ratio = np.array([r["feature"] for r in best], np.int64), np.array([r["ratio"] for r in best])
    place = np.full(2 * TWICE, -1, np.int16)
    place[chosen] = np.arange(len(chosen))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[np.frombuffer(f, "<u4")] for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([f[f >= 0].astype("<u2").tobytes() for f in found], pa.binary())], names=["toxic", "features"]
            )

    data = labelled.mapInArrow(kept, "toxic int, features binary").collect()  # bounded by max_rows * keep
    data.sort(key=lambda r: (r["toxic"], r["features"]))  # sums do not depend on the order of tasks
    common.discard(labelled, tally, counts)
    y = np.array([r["toxic"] for r in data], np.float64)
    parts = [np.frombuffer(r["features"], "<u2") for r in data]
    flat, owner = np.concatenate(parts).astype(np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    weight = np.where(y > 0, np.sqrt(n[0] / n[1]), 1.0) / len(y)
    w, b, value = np.zeros(len(chosen)), bias, ratio
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the whole data
        z = b + np.bincount(owner, (w * value)[flat], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw, gb = np.bincount(flat, g[owner], len(w)) * value + ridge * w, g.sum()
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        pace = rate * min(1.0, 2 - 2 * step / steps)
        w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        b -= pace * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    return Model(float(b), chosen, w * value)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, ...]] = {}
    for batch in common.slices(batches, "text"):
        scores = []
        for text in common.texts(batch, "text"):
            found = []
            for w in words_of(text):
                f = known.get(w)
                if f is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    f = known[w] = model.word(w)
                if f:
                    found.append(f)
            scores.append(model.score(found))
        score = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", *, max_rows: int = 8_000, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; learns from rows that are not held out."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    marks = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
        .distinct().withColumn("_order", F.xxhash64("_id"))
    )
    ids = docs.where("not held_out").select(F.col("doc_id").alias("_id")).distinct()
    sample = marks.join(ids, "_id", "left_semi").orderBy("_order", "_id", "toxic").limit(max_rows).select("_id", "toxic", "_order")
    # an id may stand before many texts: each counts once, and ``max_rows`` bounds them as well
    text_key = F.xxhash64("text").alias("_text_key")
    keys = docs.where("not held_out").select("doc_id", text_key).join(common.stored(sample), F.col("doc_id") == F.col("_id")).select(
        "_id", "_text_key", "toxic", "_order"
    ).distinct().orderBy("_order", "_id", "toxic", "_text_key").limit(max_rows).select("_id", F.col("_text_key").alias("_key"), "toxic")
    rows = docs.where("not held_out").withColumn("_text_key", F.xxhash64("text")).join(
        common.stored(keys), (F.col("doc_id") == F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    ).dropDuplicates(["_id", "_key", "toxic"]).repartition(docs.sparkSession.sparkContext.defaultParallelism, "_key")
    model = fit(rows.select("toxic", "text"), **options)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda b: _scored(b, model), f"doc_id {key}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels")
    return score(docs, labels, common.crc_mod("doc_id", 5) == 0)
