"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised by the model's own rules, then cut where no piece can reach across: before
a word mark that follows another character. Each cut part is encoded by an agenda: a heap of
adjacent symbol pairs ordered by the score of the piece they make, leftmost first; the best pair
is merged, pairs that it outdates are skipped when they come up, and the two new neighbours are
added. Symbols outside the vocabulary become bytes. Parts are encoded once per worker and
remembered. Every whole text is checked against the sentencepiece library, in one call per slice of
an Arrow batch; a difference is an error.

Edge cases: null and empty texts have the begin and end ids only and decode to an empty text;
texts of any length are taken whole; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

MARK = "▁"
#: Cuts for texts with runs of marks: a run of marks goes with the characters after it.
PARTS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A text that shows whether a model's normaliser does more than to mark spaces.
PROBE = "aB \t\n Z\u00e9 e\u0301\u3000\ufb01\uff21 \u200b\x00\x7f"
#: Words that a worker remembers, and symbols of a part up to which its agenda is a list.
REMEMBERED, SHORT = 1_000_000, 32


class PieceBpe:
    """Agenda encoder over a sentencepiece model of the merge type with byte pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.ids = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        order = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        #: The place of a piece in the order of scores; pieces of one score share it.
        self.place = {p: place[lib.get_score(i)] for p, i in self.ids.items()}
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.marks_only = lib.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
        self.store = common.WordStore(remembered, first_differs=False)

    def agenda(self, part: str) -> list[int]:
        """Ids of one part."""
        symbols = self.merged(part) if len(part) <= SHORT else self.merged_long(part)
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        return [x for s, i in zip(symbols, out, strict=True) for x in ((i,) if i is not None else map(self.bytes.get, s.encode()))]

    def merged(self, part: str) -> list[str]:
        """Symbols of a part, its agenda a list by position: over a few pairs a search for the least is cheaper than a heap."""
        get, none = self.place.get, len(self.place)
        symbols = list(part)
        agenda = list(map(get, map(add, part, part[1:]), repeat(none)))
        agenda.append(none)  # the last symbol has no pair
        while (best := min(agenda)) != none:
            i = agenda.index(best)
            new = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + new, none)
            if i + 1 < len(symbols):
                agenda[i] = get(new + symbols[i + 1], none)
        return symbols

    def merged_long(self, part: str) -> list[str]:
        """The same with a heap, for parts of any length."""
        place, size = self.place, len(part)
        symbols: list[str] = list(part)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        pairs = [part[i : i + 2] for i in range(size - 1)]
        agenda = [(place[p], i, 2) for i, p in enumerate(pairs) if p in place]
        heapify(agenda)
        while agenda:
            _, left, length = heappop(agenda)
            right = after[left]
            if not symbols[left] or right >= size or len(symbols[left]) + len(symbols[right]) != length:
                continue  # outdated: one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = right = after[right]
            if right < size:
                before[right] = left
                p = symbols[left] + symbols[right]
                if p in place:
                    heappush(agenda, (place[p], left, len(p)))
            if (prior := before[left]) >= 0:
                p = symbols[prior] + symbols[left]
                if p in place:
                    heappush(agenda, (place[p], prior, len(p)))
        return [s for s in symbols if s]

    def check(self, texts: list[str], found: list[np.ndarray]) -> list[list[int]]:
        """Compare whole texts with the library; the ids of both as lists."""
        others = self.library.encode(texts, num_threads=1)
        for text, mine, other in zip(texts, found, others, strict=True):
            if len(mine) != len(other) or mine.tolist() != other:
                raise AssertionError(f"the agenda and the library differ on {text[:200]!r}")
        return others

    def parts(self, text: str) -> list[str]:
        """Parts of a text that no piece reaches across."""
        normal = self.library.normalize(text)
        return [normal] if self.crossing and normal else PARTS.findall(normal)

    def regular(self, text: str) -> bool:
        """Whether the parts are the words between single spaces, each with a mark."""
        return bool(text) and self.marks_only and not self.crossing and not (
            "  " in text or text[0] == " " or MARK in text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32, without begin and end."""
        regular = [i for i, t in enumerate(texts) if self.regular(t)]
        out: list = [None] * len(texts)
        learn = lambda words, _: common.flat_ids([self.agenda(MARK + w) for w in words])
        for i, ids in zip(regular, self.store.encode([texts[i].encode() for i in regular], learn), strict=True):
            out[i] = ids
        own: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            if out[i] is None:
                parts = self.parts(text)
                for p in parts:
                    if p not in own:
                        own[p] = self.agenda(p)
                out[i] = np.array([x for p in parts for x in own[p]], np.uint32)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceBpe:
    return PieceBpe(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(key columns..., text) to (key columns..., ids as little-endian uint32 with begin and end, decoded)."""
    model = encoder(path)
    edge = np.array([model.begin], "<u4"), np.array([model.end], "<u4")
    for batch in common.slices(batches, "text", 4 << 20):
        names = [c for c in batch.schema.names if c != "text"]
        texts = common.texts(batch, "text")
        found = model.encode(texts)
        listed = model.check(texts, found)
        ids = [np.concatenate([edge[0], x, edge[1]]).astype("<u4") for x in found]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array([x.tobytes() for x in ids], pa.binary()),
             pa.array([model.decode([model.begin, *x, model.end]) for x in listed], pa.string())],
            names=[*names, "ids", "decoded"],
        )


def digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The same with digests in place of ids and text, so that neither crosses to the JVM."""
    for batch in encoded(batches, path):
        ids = batch.column("ids").to_pylist()
        text = batch.column("decoded").cast(pa.binary()).to_pylist()
        names = [c for c in batch.schema.names if c not in ("ids", "decoded")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array([len(x) // 4 for x in ids], pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in text])],
            names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _input(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids are binary, little-endian unsigned 32-bit integers."""
    docs, key = _input(docs, id_col, text_col)
    return docs.mapInArrow(lambda b: encoded(b, path), f"{key}, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs, key = _input(docs, id_col, text_col)
    return docs.mapInArrow(
        lambda b: digests(b, path), f"{key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
