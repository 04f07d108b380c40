"""Language model: hashed maximum entropy with a class-factored softmax.

Tokens are lower-cased words and one end per text. A word falls into one of ``buckets`` hash
buckets, the end has bucket 0, and ``per_class`` buckets in a row form a class. The model is

    P(token | history) = P(class | history) P(bucket | class, history) P(token | bucket)

Both softmaxes sum the weights of four features: a bias, the previous bucket (bigram), the one
before it (skip), and both hashed together (trigram). P(token | bucket) is the add-one estimate
from the counts of the training corpus, with one place for all words never seen.

Work on the corpus:

1. Each task numbers the words of its documents by a dictionary of its own (a block), writes the
   documents as number arrays, the dictionary with its training counts, and the counts of bucket
   triples as arrays. Words are shuffled once per block, not once per occurrence.
2. Counts of words are summed and joined back to the dictionaries; triples are summed in rounds
   that take at most ``FAN`` arrays into a task.
3. Weights are trained by full gradients: tasks hold slices of the triples and return partial
   gradients, the driver steps the weights, whose size is a parameter and not the corpus.
4. Blocks meet their dictionaries again and are scored in numpy.

Edge cases: null and empty texts have one token, the end; with an empty table, or no training
document, there are no counts and every token is unknown; repeated rows count each time; texts of
any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

#: Arrays of triple counts that one task adds up.
FAN = 32
#: Words in a block's dictionary before the next block begins.
BLOCK_WORDS = 1 << 20
BLOCK = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("word", pa.binary()), ("number", pa.int32()), ("bucket", pa.int32()),
    ("count", pa.int64()), ("chunk", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()),
    ("key", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()),
])
BLOCK_SQL = (
    "kind string, block long, word binary, number int, bucket int, count long, chunk int, cells binary, counts binary, "
    "key long, held_out boolean, tokens binary"
)


def bucket_of(word: bytes, buckets: int) -> int:
    return 1 + xxhash.xxh3_64_intdigest(word) % (buckets - 1)


class Block:
    """Documents of one block: their words by number, counts of words and of bucket triples."""

    def __init__(self, number: int, buckets: int, key: pa.DataType):
        self.number, self.buckets = number, buckets
        self.schema = BLOCK.set(BLOCK.get_field_index("key"), pa.field("key", key))
        self.names = common.WordIds(BLOCK_WORDS)
        self.bucket = np.zeros(1, np.int32)
        self.count = np.zeros(1, np.int64)
        self.triples = np.zeros(buckets**3, np.int32)
        self.ends = 0

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Count a batch; its documents as rows of kind doc."""
        held = np.array(batch.column("held_out").to_pylist(), bool)
        docs = [t.lower().split() for t in common.raw_texts(batch, "text")]
        had = len(self.names.words)
        # number 0 is the end, words follow
        numbers = self.names([w for d in docs for w in d]) + 1
        self.bucket = np.concatenate([self.bucket, np.array([bucket_of(w, self.buckets) for w in self.names.words[had:]], np.int32)])
        self.count = np.concatenate([self.count, np.zeros(len(self.names.words) - had, np.int64)])
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        ends = np.cumsum(lengths)
        flat = np.zeros(int(ends[-1]), np.int32)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        flat[inner] = numbers
        learn = np.repeat(~held, lengths)
        self.count += np.bincount(flat[learn], minlength=len(self.count))
        context = contexts(self.bucket[flat], ends, self.buckets)
        cells = context[learn] * self.buckets + self.bucket[flat[learn]]
        self.triples += np.bincount(cells, minlength=len(self.triples)).astype(np.int32)
        parts = np.split(flat.astype("<i4"), ends[:-1])
        n = len(docs)
        return _rows(
            n, self.schema, kind="doc", block=self.number, key=batch.column("key"), held_out=batch.column("held_out"),
            tokens=pa.array([p.tobytes() for p in parts], pa.binary()),
        )

    def rest(self) -> Iterator[pa.RecordBatch]:
        n = len(self.names.words)
        yield _rows(
            n + 1, self.schema, kind="word", block=self.number, word=pa.array([b"", *self.names.words], pa.binary()),
            number=pa.array(np.arange(n + 1, dtype=np.int32)), bucket=pa.array(self.bucket), count=pa.array(self.count),
        )
        table = self.triples.reshape(self.buckets, -1)
        for chunk in np.flatnonzero(table.any(axis=1)).tolist():
            cells = np.flatnonzero(table[chunk])
            yield _rows(
                1, self.schema, kind="triples", block=self.number, chunk=pa.array([chunk], pa.int32()),
                cells=pa.array([cells.astype("<u4").tobytes()]), counts=pa.array([table[chunk][cells].astype("<i8").tobytes()]),
            )


def contexts(buckets: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Per token, (bucket two before) * n + (bucket before); before a text stands the end's bucket 0."""
    before = np.zeros(len(buckets), np.int64)
    before[1:] = buckets[:-1]
    skip = np.zeros(len(buckets), np.int64)
    skip[2:] = buckets[:-2]
    starts = np.concatenate([[0], ends[:-1]])
    before[starts] = 0
    skip[starts] = 0
    second = starts + 1
    skip[second[second < np.minimum(ends, len(buckets))]] = 0
    return skip * n + before


def _rows(n: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(n, field.type))
        elif isinstance(value, pa.Array):
            arrays.append(value.cast(field.type))
        else:
            arrays.append(pa.array([value], field.type).take(pa.array(np.zeros(n, np.int64))))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    part, turn = TaskContext.get().partitionId(), 0
    block = None
    for batch in common.slices(batches, "text"):
        if block is not None and block.names.full():
            yield from block.rest()
            block = None
        if block is None:
            block = Block(part << 24 | turn, buckets, batch.schema.field("key").type)
            turn += 1
        yield block.add(batch)
    if block is not None:
        yield from block.rest()


def _summed(group: pa.Table, n: int) -> pa.Table:
    total = np.zeros(n, np.int64)
    for cells, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(cells, "<u4")] += np.frombuffer(counts, "<i8")
    cells = np.flatnonzero(total)
    return pa.table({
        "chunk": group.column("chunk").slice(0, 1).cast(pa.int32()), "turn": group.column("turn").slice(0, 1).cast(pa.int64()),
        "cells": pa.array([cells.astype("<u4").tobytes()]), "counts": pa.array([total[cells].astype("<i8").tobytes()]),
    })


def sum_triples(stored: DataFrame, buckets: int) -> DataFrame:
    """(chunk, cells, counts): one row for each bucket two before."""
    n = buckets * buckets
    schema = "chunk int, turn long, cells binary, counts binary"
    rows = stored.where("kind = 'triples'").select("chunk", F.xxhash64("block").alias("turn"), "cells", "counts")
    most = rows.groupBy("chunk").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = max(1, math.ceil(most / FAN)) if most > FAN else 1
        old, rows = rows, common.stored(
            rows.withColumn("turn", F.pmod(F.xxhash64("turn", F.lit(groups)), F.lit(groups).cast("bigint")))
            .groupBy("chunk", "turn").applyInArrow(lambda g: _summed(g, n), schema)
        )
        if hasattr(old, "scratch_path"):
            common.discard(old)
        most = groups
    return rows.select("chunk", "cells", "counts")


class Weights:
    """Weights of both softmaxes, and the features of every context."""

    def __init__(self, buckets: int, per_class: int, hashed: int):
        self.buckets, self.per_class, self.hashed = buckets, per_class, hashed
        features = 1 + 2 * buckets + hashed
        self.inside = np.zeros((features, buckets), np.float32)
        self.classes = np.zeros((features, buckets // per_class), np.float32)

    def features(self, skip: int) -> np.ndarray:
        """Feature numbers of the contexts (skip, 0), (skip, 1), ...: one row each."""
        n = self.buckets
        before = np.arange(n, dtype=np.uint64)
        both = (common.mix(before + np.uint64(skip * n), 3) % np.uint64(self.hashed)).astype(np.int64)
        before = before.astype(np.int64)
        return np.stack([np.zeros(n, np.int64), 1 + before, np.full(n, 1 + n + skip), 1 + 2 * n + both], axis=1)

    def log_probabilities(self, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, log P(class), log P(bucket | class)) of the contexts with one bucket two before."""
        f = self.features(skip)
        outer = self.classes[f].sum(axis=1)
        inner = self.inside[f].sum(axis=1).reshape(self.buckets, -1, self.per_class)
        return f, _log_softmax(outer), _log_softmax(inner)

    def gradient(self, skip: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Features, gradients of the log likelihood by class and by bucket for each context, and the likelihood."""
        f, outer, inner = self.log_probabilities(skip)
        seen = counts.reshape(self.buckets, -1, self.per_class).astype(np.float64)
        of_class = seen.sum(axis=2)
        g_outer = of_class - of_class.sum(axis=1, keepdims=True) * np.exp(outer)
        g_inner = seen - of_class[:, :, None] * np.exp(inner)
        return f, g_outer, g_inner.reshape(self.buckets, -1), float((of_class * outer).sum() + (seen * inner).sum())


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _gradients(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    inside, classes, total = np.zeros(weights.inside.shape), np.zeros(weights.classes.shape), 0.0
    any_rows = False
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros(weights.buckets**2, np.int64)
            counts[np.frombuffer(row["cells"], "<u4")] = np.frombuffer(row["counts"], "<i8")
            f, outer, inner, value = weights.gradient(row["chunk"], counts.reshape(weights.buckets, -1))
            for k in range(f.shape[1]):
                np.add.at(classes, f[:, k], outer)
                np.add.at(inside, f[:, k], inner)
            total += value
            any_rows = True
    if any_rows:
        yield pa.RecordBatch.from_pydict({
            "inside": pa.array([inside.astype("<f4").tobytes()]), "classes": pa.array([classes.astype("<f4").tobytes()]), "value": [total],
        })


def train(triples: DataFrame, weights: Weights, steps: int, rate: float = 1.0, prior: float = 3.0, damp: float = 30.0,
          tasks: int = 6) -> list[float]:
    """Damped Adagrad steps over full gradients with a Gaussian prior; the log likelihood per step.

    At most ``tasks`` gradients, of the size of the weights, reach the driver.
    """
    triples = common.stored(triples.repartition(tasks, "chunk"))
    squares = [np.full_like(weights.inside, damp), np.full_like(weights.classes, damp)]
    values = []
    for _ in range(steps):
        rows = triples.coalesce(tasks).mapInArrow(lambda b: _gradients(b, weights), "inside binary, classes binary, value double").collect()
        if not rows:
            break
        values.append(sum(r["value"] for r in rows))
        for w, square, name in ((weights.inside, squares[0], "inside"), (weights.classes, squares[1], "classes")):
            g = sum(np.frombuffer(r[name], "<f4").reshape(w.shape) for r in rows) - prior * w
            square += g * g
            w += rate * g / np.sqrt(square)
    common.discard(triples)
    return values


def _scored(docs: pa.Table, words: pa.Table, weights: Weights, base_log: float, bucket_log: np.ndarray) -> pa.Table:
    """Score the documents of a block with its dictionary."""
    number = words.column("number").to_numpy()
    count = np.zeros(int(number.max()) + 1 if len(number) else 1, np.int64)
    bucket = np.zeros(len(count), np.int64)
    count[number] = words.column("count").to_numpy()
    bucket[number] = words.column("bucket").to_numpy()
    log_count, known = np.log10(count + 1.0), count > 0
    tokens = [np.frombuffer(t, "<i4") for t in docs.column("tokens").to_pylist()]
    lengths = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(lengths)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    own = bucket[flat]
    context = contexts(own, ends, weights.buckets) if len(flat) else np.zeros(0, np.int64)
    model = np.zeros(len(flat))
    order = np.argsort(context // weights.buckets, kind="stable")
    cuts = np.searchsorted(context[order] // weights.buckets, np.arange(weights.buckets + 1))
    for skip in range(weights.buckets):
        at = order[cuts[skip] : cuts[skip + 1]]
        if len(at):
            _, outer, inner = weights.log_probabilities(skip)
            table = (np.repeat(outer, weights.per_class, axis=1) + inner.reshape(weights.buckets, -1)) / math.log(10)
            model[at] = table[context[at] % weights.buckets, own[at]]
    starts = ends - lengths
    total = lambda x: np.add.reduceat(x, starts) if len(flat) else np.zeros(0)
    counts = total(log_count[flat])
    return pa.table({
        "key": docs.column("key"), "held_out": docs.column("held_out"), "n_tokens": pa.array(lengths),
        "n_known": pa.array(total(known[flat].astype(np.int64)).astype(np.int64)),
        "base_score": pa.array(counts - lengths * base_log), "score": pa.array(total(model) + counts - total(bucket_log[own])),
    })


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 128,
          per_class: int = 8, hashed: int = 4096, steps: int = 12) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from the rows that are not held out. Scores are log10 probabilities.
    """
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    key = docs.schema["key"].dataType.simpleString()
    stored = common.stored(docs.mapInArrow(lambda b: blocks(b, buckets), BLOCK_SQL.replace("key long", f"key {key}")), "kind")
    words = stored.where("kind = 'word'").select("block", "word", "number", "bucket", "count")
    counts = common.stored(words.groupBy("word").agg(F.sum("count").alias("c"), F.first("bucket").alias("b")))
    seen = counts.where("c > 0").groupBy("b").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = sum(r["n"] for r in seen), sum(r["v"] for r in seen)
    base_log = math.log10(n + v + 1)
    bucket_log = np.zeros(buckets)  # an empty bucket holds unknown words only, at probability one
    for r in seen:
        bucket_log[r["b"]] = math.log10(r["n"] + r["v"] + 1)
    weights = Weights(buckets, per_class, hashed)
    train(sum_triples(stored, buckets), weights, steps)
    totals = counts.select(F.col("word").alias("_word"), "c")
    numbered = words.join(totals, F.col("word") == F.col("_word")).select(
        F.col("block").alias("_block"), "number", "bucket", F.col("c").alias("count")
    )
    rows = stored.where("kind = 'doc'").select("block", "key", "held_out", "tokens")
    scored = rows.groupBy("block").cogroup(numbered.groupBy("_block")).applyInArrow(
        lambda d, w: _scored(d, w, weights, base_log, bucket_log),
        f"key {key}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, common.crc_mod("doc_id", 7) == 2)
