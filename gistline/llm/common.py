"""What the operators share: tables, shared scratch tables, shipping code, Arrow slices."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistline.session import shared_folder, spread

#: Bytes of text that an Arrow function works on at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, a scan of few tasks spread over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of lineage that any executor can read again."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # The driver serves this file to executors as long as the application runs.
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gistline-code-")), "gistline")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), "gistline"))
        _SHIPPED.add(context.applicationId)
    return spark


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n``; null counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n).cast("bigint"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of one column, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: uint64 in, uint64 out, every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[start:start + length]`` of all pairs without a loop."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
    return values[index]


class WordIds:
    """Numbers for words in order of first sight; at most ``limit`` words are remembered."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.ids, self.words = limit, {}, []

    def __call__(self, words: list) -> np.ndarray:
        get, found = self.ids.get, np.empty(len(words), np.int64)
        found[:] = [get(w, -1) for w in words]
        for i in np.flatnonzero(found < 0).tolist():
            word = words[i]
            n = get(word)
            if n is None:
                n = self.ids[word] = len(self.words)
                self.words.append(word)
            found[i] = n
        return found

    def full(self) -> bool:
        return len(self.words) >= self.limit


#: Base of the hash of a word, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes up to which a word is hashed with all others; there are long words that this hash confuses.
LONG_WORD = 256


class WordStore:
    """Ids of the words of texts that are cut at each space, remembered under 64-bit hashes of the words.

    All words of a slice are hashed and looked up at once, so only words that are new become Python strings. With n words
    remembered, a new word is taken for another with a probability of n / 2^64. When there are more than
    ``limit`` words, those that came again stay.
    """

    def __init__(self, limit: int, first_differs: bool):
        self.limit, self.first_differs = limit, first_differs
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, places in ``starts``
        self.flat, self.starts, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.power = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power[0]) < n:
            self.power = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (BASE, INVERSE))
        return self.power

    def sweep(self) -> None:
        """Keep at most half of ``limit`` words, the most used ones."""
        n = len(self.keys)
        order = np.argsort(-self.used[:n], kind="stable")[: self.limit // 2]
        keep = np.sort(order[self.used[order] > 1])
        lengths = self.starts[keep + 1] - self.starts[keep]
        flat = ragged(self.flat, self.starts[keep], lengths)
        place = np.full(n, -1, np.int64)
        place[keep] = np.arange(len(keep))
        left = place[self.at] >= 0
        self.keys, self.at = self.keys[left], place[self.at[left]]
        used = self.used[keep] // 2
        self.flat[: len(flat)] = flat
        self.starts[1 : len(keep) + 1] = np.cumsum(lengths)
        self.used[:] = 0
        self.used[: len(keep)] = used

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, m = len(self.keys), len(keys)
        ends = self.starts[n] + np.cumsum(lengths)
        self.starts, self.flat, self.used = _room(self.starts, n + m + 1), _room(self.flat, int(ends[-1])), _room(self.used, n + m)
        self.flat[self.starts[n] : ends[-1]] = ids
        self.starts[n + 1 : n + m + 1] = ends
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, where, keys), np.insert(self.at, where, np.arange(n, n + m))
        return np.arange(n, n + m)

    def encode(self, texts: list[bytes], learn) -> list[np.ndarray]:
        """Ids of each text. ``learn(words, first)`` gives the ids of new words, in one array, and how many each has;
        ``first`` marks words at the head of a text, where the store tells them apart."""
        if not texts:
            return []
        if len(self.keys) > self.limit:
            self.sweep()
        whole = b" ".join(texts)
        data = np.frombuffer(whole + b" ", np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        power, inverse = self._powers(len(data))
        heads = np.cumsum([0] + [len(t) + 1 for t in texts])
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
            key = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64), 7)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            key[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]])
        head = np.searchsorted(starts, heads[:-1])
        first = np.zeros(len(starts), bool)
        if self.first_differs:
            first[head] = True
            key[head] = mix(key[head], 8)
        unique, inverse_of = np.unique(key, return_inverse=True)
        where = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[where] == unique if len(self.keys) else np.zeros(len(unique), bool)
        at = np.empty(len(unique), np.int64)
        at[known] = self.at[where[known]]
        if not known.all():
            some = np.empty(len(unique), np.int64)
            some[inverse_of] = np.arange(len(key))
            new = some[~known]
            words = [whole[i:j].decode() for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            at[~known] = self._add(unique[~known], *learn(words, first[new]))
        at = at[inverse_of]
        self.used[: len(self.keys)] += np.bincount(at, minlength=len(self.keys))
        lengths = self.starts[at + 1] - self.starts[at]
        ids = ragged(self.flat, self.starts[at], lengths)
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.append(head, len(starts))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
