"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, A-Z in lower case, each with its number of occurrences. For sample
k and term x the numbers r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from a hash of (x, k). A weight w gives
t = floor(ln w / r + b), ln y = r (t - b) and ln a = ln c - ln y - r; the sample is (x, t) of the term with the
least a. Two texts draw the same sample with a probability equal to their generalised Jaccard similarity, the
sum of lesser weights over the sum of greater ones. A fingerprint is ``SAMPLES`` samples of 16 bits in hex, and the
likeness of two is the share of equal samples: its standard error is 0.044 at most.

``fingerprints`` is local to a row. ``neighbours`` also compares each document with the next one and with an
edited text made of both. Rows are dealt into ranges of ids, whose first rows are sent once more to the range
before as guards, so that texts are shuffled once and the end of a range needs nothing from another task.

Edge cases: null texts count as empty; texts without words have the fingerprint of zeros, which is like itself (1)
and like no other (0); texts are cut into bounded sets of terms, so a text of any length works; equal texts have
equal fingerprints, ties going to the lesser hash; a null id sorts first, rows of one id are ordered by a hash of
the text; a lone document is its own next; an empty table gives an empty result. Ids keep their type, other
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gistline.llm import common

SAMPLES = 128
#: Weighted terms whose samples are held at once.
TERMS = 1 << 16
#: Ranges of ids for each shuffle partition, so that partitions come out even.
RANGES = 4
SLICE = 2 << 20


def _uniforms(terms: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, ...]:
    """Five numbers in (0, 1) for each term and sample, of 21 bits each."""
    low, scale = np.uint64((1 << 21) - 1), 2.0**-21
    first = common.mix(terms ^ common.mix(samples, 1))
    second = common.mix(first, 2)
    for word, shift in ((first, 0), (first, 21), (first, 42), (second, 0), (second, 21)):
        yield (((word >> np.uint64(shift)) & low).astype(np.float64) + 0.5) * scale


def _draws(terms: np.ndarray, weights: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) for each term and sample."""
    u1, u2, u3, u4, b = _uniforms(terms, samples)
    r, c = -np.log(u1 * u2), -np.log(u3 * u4)
    t = np.floor(np.log(weights) / r + b)
    return np.log(c) - r * (t - b) - r, t.astype(np.int64)


class Sampler:
    """Samples of many texts at once: what texts share, a word with a weight, is drawn once."""

    def __init__(self, samples: int = SAMPLES, terms: int = TERMS):
        self.samples, self.terms = np.arange(samples, dtype=np.uint64), terms

    def _weighted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, weight) of each different weighted term in order, and the terms of text i at [ends[i-1], ends[i])."""
        numbers: dict[bytes, int] = {}
        found = []
        for text in texts:
            words = text.lower().split()
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            found.append(np.unique(ids, return_counts=True))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = np.cumsum([len(ids) for ids, _ in found])
        at = np.concatenate([rank[ids] for ids, _ in found])
        weight = np.concatenate([n for _, n in found])
        # Terms of a text in the order of their hashes, whatever texts came with it.
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        sorting = np.lexsort((at, text_of))
        at, weight = at[sorting], weight[sorting]
        widest = int(weight.max(initial=0)) + 1
        pairs, place = np.unique(at * widest + weight, return_inverse=True)
        return hashes[order][pairs // widest], (pairs % widest).astype(np.float64), place, ends

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """One row of 16-bit samples per text."""
        k, n = len(self.samples), len(texts)
        hashes, weights, place, ends = self._weighted(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        least, best = np.full((n, k), np.inf, np.float32), np.zeros((n, k), np.int64)
        columns = np.arange(k)
        for low in range(0, len(hashes), self.terms):
            rows = np.empty((min(self.terms, len(hashes) - low), k), np.float32)
            for i in range(0, len(rows), 2048):
                part = slice(low + i, min(low + i + 2048, low + len(rows)))
                rows[i : i + 2048] = _draws(hashes[part, None], weights[part, None], self.samples)[0]
            for text in range(n):
                own = place[starts[text] : ends[text]]
                if len(hashes) > self.terms:
                    own = own[slice(*np.searchsorted(own, [low, low + self.terms]))] - low
                for i in range(0, len(own), 4096):
                    some = rows[own[i : i + 4096]]
                    first = some.argmin(axis=0)
                    value = some[first, columns]
                    better = value < least[text]
                    least[text][better] = value[better]
                    best[text][better] = own[i + first[better]] + low
        out = np.zeros((n, k), np.uint16)
        filled = np.flatnonzero(ends > starts)
        if len(filled):
            winners = best[filled]
            t = _draws(hashes[winners], weights[winners], self.samples)[1]
            code = common.mix(hashes[winners] ^ common.mix(t.view(np.uint64), 3) ^ common.mix(self.samples, 4), 5)
            out[filled] = 1 + code % np.uint64(65535)
        return out


def text_form(samples: np.ndarray) -> list[str]:
    return [row.astype("<u2").tobytes().hex() for row in samples]


def likeness(a: str, b: str) -> float:
    """The share of equal samples of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), "<u2") for s in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame, *, text_col: str = "text", name: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """The rows of ``docs`` with their fingerprint in a column ``name``, which must be new."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in common.slices(batches, text_col, SLICE):
            made = pa.array(text_form(sampler(common.raw_texts(batch, text_col))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by as many of the following text, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def guarded(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (key, tie, text) with ``range`` and ``guard``: ranges follow the order of (key, tie), and the first row
    of each comes once more as the guard of the range before it, that of the first as guard of the last."""
    light = docs.select("key", "tie").repartitionByRange(ranges, F.col("key").asc_nulls_first()).withColumn("range", F.spark_partition_id())
    boxed = F.struct(F.col("key").isNotNull().alias("known"), "key", "tie")
    # One row per range; Spark's own cut of the keys is read off it.
    heads = sorted((r.range, r.head.key, r.head.tie) for r in light.groupBy("range").agg(F.min(boxed).alias("head")).collect())
    keys, ties = [h[1] for h in heads], [h[2] for h in heads]
    nulls = int(bool(keys) and keys[0] is None)
    cuts = keys[nulls + (not nulls) :]  # the key each range but the first starts at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_pylist()
            at = np.array([0 if x is None else bisect_right(cuts, x) for x in own], np.int32)
            head = np.array([x == keys[r] and t == ties[r] for x, t, r in zip(own, batch.column("tie").to_pylist(), at, strict=True)], bool)
            extra = np.flatnonzero(head)
            yield _ranged(batch, at, False)
            if len(extra):
                yield _ranged(batch.take(pa.array(extra)), (at[extra] - 1) % len(keys), True)

    schema = T.StructType([*docs.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("guard", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def _ranged(batch: pa.RecordBatch, at: np.ndarray, guard: bool) -> pa.RecordBatch:
    columns = [*batch.columns, pa.array(at.astype(np.int32)), pa.array(np.full(len(at), guard))]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "range", "guard"])


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
               ranges: int | None = None) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = common.ship(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = guarded(docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text")), ranges or RANGES * parts)
    dealt = rows.repartition(parts, "range").sortWithinPartitions("range", "guard", F.col("key").asc_nulls_first(), "tie")
    out = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held: list = []  # the last row so far: (key, text, guard, samples)
        for batch in common.slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            keys = [r[0] for r in held] + batch.column("key").to_pylist()
            guards = [r[2] for r in held] + batch.column("guard").to_pylist()
            whole = [r[1] for r in held] + texts
            pairs = [i for i in range(len(whole) - 1) if not guards[i]]
            changed = [edited(whole[i], whole[i + 1]).encode() for i in pairs]
            made = sampler([*(t.encode() for t in texts), *changed])
            own = np.concatenate([*(r[3][None, :] for r in held), made[: len(texts)]])
            other = made[len(texts) :]
            held = [(keys[-1], whole[-1], guards[-1], own[-1])]
            at = np.array(pairs, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in pairs], arrow.field(0).type), pa.array([len(whole[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array(text_form(own[at]), pa.string()), pa.array(text_form(other), pa.string()),
                pa.array((own[at] == other).mean(axis=1), pa.float64()), pa.array((own[at] == own[at + 1]).mean(axis=1), pa.float64()),
            ], schema=arrow)

    return dealt.select("key", "text", "guard").mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(common.documents(spark, sf_dir))
