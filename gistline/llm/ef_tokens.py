"""Token ids in one concatenated array with Elias-Fano encoded document boundaries.

The table is dealt into ranges of document ids, each range is sorted, and a range is written as
segments of bounded size, rows of a Parquet table in the shared folder:

    part, segment   place of the segment in the order of ids
    doc_ids         the ids of its documents, as 64-bit integers; an array if ids are no integers
    ids             all token ids, ``<u2`` if the vocabulary allows, else ``<u4``
    n_docs, n_ids, low_bits, low, high, samples
                    Elias-Fano code of the n_docs + 1 boundaries: ``low`` packs the ``low_bits``
                    lowest bits of each boundary, ``high`` holds a one at place (boundary >>
                    low_bits) + i for boundary i, and ``samples`` holds the place of every
                    64th one, so that select reads a few bytes.

Boundaries before a segment are sums over segments, so no table of 64-bit offsets exists.

Edge cases: null and empty texts hold the end id only; a null document id sorts first; repeated
rows are documents each; a document longer than a segment has one of its own; an empty table
makes an empty file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistline.llm import common

#: Ids in a segment, unless one document holds more.
SEGMENT_IDS = 1 << 20
#: Boundaries between two samples of the select structure.
SAMPLE = 64
SEGMENTS = (
    "part int, segment long, n_docs long, n_ids long, doc_ids {ids}, null_ids binary, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)
#: White space other than the space itself.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
#: Words that a worker remembers, and new ones that are encoded as one text.
REMEMBERED, JOINED = 1_000_000, 1000
#: A word without white space.
PLAIN = re.compile(r"\S+").fullmatch
#: A text that shows whether a model cuts before single spaces.
PROBE = "ab cd, x1 y\n z\t w"


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1, np.uint8)
        ones[places] = 1
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, low, np.packbits(ones, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def place(self, i: int) -> int:
        """select: the place of the i-th one, found from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        start = i * self.low_bits
        first, end = start >> 3, (start + self.low_bits + 7) >> 3
        low = int.from_bytes(self.low[first:end], "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        return (self.place(i) - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value, without a loop."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ weights
        return ((ones - np.arange(self.n)) << self.low_bits) | low


class PartTokenizer:
    """The tokenizers library, asked once for each part of a text that it treats by itself.

    A byte-level tokenizer cuts a text before a space that has a character of another kind on
    one side at least. Texts are split at spaces; texts with white space on both sides of one,
    and texts that spell a special token, are given to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        # Spark runs a task on each core; threads of the library would only wait for one another.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        parts = [PROBE.split(" ")[0], *(" " + p for p in PROBE.split(" ")[1:])]
        self.splits = self._whole([PROBE])[0] == [i for x in self._whole(parts) for i in x]
        self.store = common.WordStore(remembered, first_differs=True)
        self.sizes = self._sizes()

    def _sizes(self) -> np.ndarray | None:
        """Bytes of each token, if a token is spelled with one letter a byte."""
        sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            sizes[i] = len(token)
        text = PROBE + "é中😀"
        return sizes if self.splits and sizes[self._whole([text])[0]].sum() == len(text.encode()) else None

    def _learn(self, words: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with the space before them. A word without white space of other kinds ends where the next one starts, in
        any company; such words are encoded as one text, and told apart by the bytes of their tokens."""
        if self.sizes is None:
            return common.flat_ids(self._whole([w if f else " " + w for w, f in zip(words, first.tolist(), strict=True)]))
        plain = np.fromiter((PLAIN(w) is not None for w in words), bool, len(words)) & ~first
        easy, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = [words[i] for i in easy.tolist()]
        ids, _ = common.flat_ids(self._whole([" " + " ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]))
        lengths = np.zeros(len(words), np.int64)
        if len(easy):
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in texts), np.int64, len(texts)))
            reached = np.cumsum(self.sizes[ids])
            cuts = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
            if not np.array_equal(reached[cuts], ends):  # the model changes some letters
                return common.flat_ids(self._whole([w if f else " " + w for w, f in zip(words, first.tolist(), strict=True)]))
            lengths[easy] = np.diff(cuts + 1, prepend=0)
        more, lengths[other] = common.flat_ids(self._whole([words[i] if first[i] else " " + words[i] for i in other.tolist()]))
        order = np.concatenate([easy, other])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return common.ragged(np.concatenate([ids, more]), starts, lengths), lengths

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def divisible(self, text: str) -> bool:
        if not self.splits or any(s in text for s in self.special):
            return False
        return "  " not in text and not any(
            text[i - 1].isspace() and text[i + 1 : i + 2].isspace() for i in _after_space(text)
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        raw = [t.encode() for t in texts]
        split = [i for i, t in enumerate(texts) if self.divisible(t)]
        out: list = [None] * len(texts)
        for i, ids in zip(split, self.store.encode([raw[i] for i in split], self._learn), strict=True):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


def _after_space(text: str) -> Iterator[int]:
    """Places of spaces that have white space of another kind before them."""
    for other in SPACES:
        if other in text:
            at = text.find(other + " ")
            while at >= 0:
                yield at + 1
                at = text.find(other + " ", at + 1)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PartTokenizer:
    return PartTokenizer(path)


def _segment(part: int, number: int, doc_ids: list, docs: list[np.ndarray], width: int, integers: bool) -> dict:
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ef = EliasFano.encode(bounds)
    ids = np.concatenate(docs).astype(f"<u{width}")
    missing = np.array([d is None for d in doc_ids])
    return {
        "part": part, "segment": number, "n_docs": len(docs), "n_ids": int(bounds[-1]),
        "doc_ids": np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() if integers else doc_ids,
        "null_ids": np.packbits(missing, bitorder="little").tobytes() if integers and missing.any() else b"",
        "width": width, "ids": ids.tobytes(), "low_bits": ef.low_bits, "low": ef.low, "high": ef.high,
        "samples": ef.samples.astype("<u4").tobytes(),
    }


def segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Documents of one range, in order, to segments."""
    from pyspark import TaskContext

    model, part = tokenizer(path), TaskContext.get().partitionId()
    width = 2 if max(model.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    names: list = []
    docs: list[np.ndarray] = []
    number = held = 0
    kind = None

    def out() -> pa.RecordBatch:
        at, integers = SEGMENT_ARROW.get_field_index("doc_ids"), pa.types.is_int64(kind)
        schema = SEGMENT_ARROW if integers else SEGMENT_ARROW.set(at, pa.field("doc_ids", pa.list_(kind)))
        return pa.RecordBatch.from_pylist([_segment(part, number, names, docs, width, integers)], schema=schema)

    for batch in common.slices(batches, "text", 2 << 20):
        kind = batch.schema.field("doc_id").type
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), model.encode(common.texts(batch, "text")), strict=True):
            if docs and held + len(ids) + 1 > size:
                yield out()
                names, docs, held, number = [], [], 0, number + 1
            names.append(doc_id)
            docs.append(np.append(ids, np.uint32(end_id)))
            held += len(ids) + 1
    if docs:
        yield out()


SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
     ("null_ids", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()),
     ("high", pa.binary()), ("samples", pa.binary())]
)


def write(docs: DataFrame, path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
          parts: int | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Tokenise and write; the table of segments as read back."""
    spark = common.ship(docs.sparkSession)
    key = F.col(id_col)
    integers = isinstance(docs.select(key).schema[0].dataType, T.IntegralType)
    docs = docs.select((key.cast("bigint") if integers else key).alias("doc_id"), F.col(text_col).alias("text"))
    ids = "binary" if integers else f"array<{docs.schema['doc_id'].dataType.simpleString()}>"
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return common.stored(ordered.mapInArrow(lambda b: segments(b, path, end_id, segment_ids), SEGMENTS.format(ids=ids)))


def open_segment(row: dict) -> tuple[list, EliasFano, np.ndarray]:
    """(document ids, boundaries, token ids) of one segment."""
    if isinstance(row["doc_ids"], list):
        doc_ids = row["doc_ids"]
    else:
        doc_ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
    if row["null_ids"]:
        missing = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), bitorder="little")
        doc_ids = [None if m else d for d, m in zip(doc_ids, missing, strict=False)]
    ef = EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])
    return doc_ids, ef, np.frombuffer(row["ids"], f"<u{row['width']}")


def ids_type(batch: pa.RecordBatch) -> pa.DataType:
    kind = batch.schema.field("doc_ids").type
    return kind.value_type if pa.types.is_list(kind) else pa.int64()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, ef, ids = open_segment(row)
            bounds = ef.all()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, ids_type(batch)), pa.array(bounds[:-1] + row["before"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def offsets(files: DataFrame) -> DataFrame:
    """Segments with ``before``, the ids of all segments ahead of each.

    Two levels: sums of whole parts run over one row per part, sums inside a part over its segments.
    """
    sizes = files.select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("ahead")
    )
    before = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("here")).join(parts, "part")
    return files.join(before, ["part", "segment"]).withColumn("before", F.col("here") + F.col("ahead")).drop("here", "ahead")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    common.ship(files.sparkSession)
    ids = files.schema["doc_ids"].dataType
    key = ids.elementType.simpleString() if isinstance(ids, T.ArrayType) else "long"
    return offsets(files).mapInArrow(_documents, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(files)
