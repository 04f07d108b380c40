"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its distinct word shingles. Its sketch has t coordinates. Round i of
the sketch throws every shingle into a hashed bin; a bin takes the smallest hash of the first
round that reaches it, and from round t on the bin is fixed to i - t, so every coordinate is
filled after 2 t rounds at the latest (and after about one for long texts). Two sketches agree in a
coordinate with the probability of the sets' similarity, concentrated as independent samples
would be. Coordinates are cut into bands of ``rows``; documents that share a band are candidates.

Documents of one set are one class, so copies are never compared. Candidates of a band are not
expanded into pairs. Bands are joined with a hub: first its member that shares most bands with
others, then members drawn anew by a hash, so that near copies fall into one component in a
few rounds that are linear in the table. Members of one band that are still in different
components are compared in blocks, all of them, so that no link is lost; of sets up to ``SHORT``
shingles by 16-bit codes, which refuse no link and leave hardly a pair that is none. Links are
confirmed on full shingle sets; the sketch only refuses pairs far below the threshold.

``near_duplicates`` derives bands and ``refuse`` from the threshold (``plan``). At 80 (48 bands of 6) a pair of similarity 0.8 shares no band with probability 5e-7, a
pair of 0.85 with 7e-11; a sketch of such a pair falls below ``refuse`` with about 2e-9.

Edge cases: a null or wordless text has an empty set and links with nothing; a text shorter than a
shingle is one shingle of all its words; equal rows are in one class; a null id takes part by its
set, and its component is the smallest id reached, null if there is none; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common
from gistline.llm.graph import components

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles of a set that is compared by 16-bit codes in blocks; larger ones are by their sketches.
SHORT = 1024
#: Members of a band that one task compares with as many others.
BLOCK = 1024


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text, the sorted 64-bit codes of its distinct shingles. Only A-Z are lower-cased."""
    docs = [t.lower().split() for t in texts]
    names = common.WordIds()
    ids = names([w for d in docs for w in d])
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in names.words], np.uint64)
    words, out, at = codes[ids], [], 0
    for d in docs:
        n = min(len(d), width)
        own = words[at : at + len(d)]
        at += len(d)
        code = np.full(len(d) - n + 1 if n else 0, n, np.uint64)
        for k in range(n):
            code = common.mix(code + own[k : len(own) - n + k + 1], k)
        out.append(np.unique(code))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: one row of t coordinates per set; rows of empty sets are ``EMPTY``."""
    table = np.full((len(sets), t), EMPTY, np.uint64)
    flat = table.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    for i in range(2 * t):
        if not len(codes):
            break
        h = common.mix(codes, 1000 + i)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = np.uint64(i) << np.uint64(44) | (common.mix(h, 5) >> np.uint64(20))
        np.minimum.at(flat, owner * t + bins, value)
        live = np.unique(owner) if i > 8 else np.arange(len(sets))
        open_rows = np.zeros(len(sets), bool)
        open_rows[live] = (table[live] == EMPTY).any(axis=1)
        stay = open_rows[owner]
        codes, owner = codes[stay], owner[stay]
    return table


def described(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to (doc_id, text_key, n_shingles, code, bands, sketch)."""
    t = bands * rows
    for batch in common.slices(batches, "text"):
        sets = shingles(common.raw_texts(batch, "text"), width)
        table = common.mix(sketch(sets, t), 11)
        keys = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
        for k in range(rows):
            keys = common.mix(keys + table[:, k::rows], k)
        code = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(code, pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.astype(np.int64).ravel())),
             pa.array([r.tobytes() for r in (table & np.uint64(0xFF)).astype(np.uint8)], pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "code", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        sets = shingles(common.raw_texts(batch, "text"), width)
        code = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
        keep = [i for i, (c, want) in enumerate(zip(code, batch.column("code").to_pylist(), strict=True)) if c == want]
        short = [(sets[i] & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(sets[i]) <= SHORT else None for i in keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([code[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()),
             pa.array(short, pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
            names=["code", "n", "short", "codes"],
        )


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree in a share of ``least`` coordinates."""
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("sketch_u", "sketch_v"))
        left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) if x else np.zeros((0, 1)) for x in (a, b))
        near = (left == right).mean(axis=1) >= least
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(near)), batch.column("v").filter(pa.array(near))], names=["u", "v"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    for whole in batches:
        for batch in common.slices(iter([whole]), "codes_u"):
            keep = []
            for a, b in zip(batch.column("codes_u").to_pylist(), batch.column("codes_v").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])


def _block_pairs(group: pa.Table, least: float, percent: int) -> pa.Table:
    """Of one pair of blocks of a band: pairs of different components that may be linked.

    Of sets with short codes, those whose short codes meet often enough: a short code is shared at least
    as often as the code, so no link is refused, and hardly anything else passes. Else by the sketches.
    """
    side, n = group.column("side").to_numpy(), group.column("n").to_numpy()
    code, label = group.column("code").to_numpy(), group.column("label").to_numpy()
    sketches = [None if x is None else np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()]
    short = [np.zeros(0, np.uint16) if x is None else np.frombuffer(x, "<u2") for x in group.column("short").to_pylist()]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    us, vs = [], []
    marked = np.zeros(1 << 16, bool)
    for i in left:
        sizes = (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i])) & (label[right] != label[i])
        others = right[sizes]
        by_code = [j for j in others if len(short[i]) and len(short[j])]
        near = [j for j in others if not (len(short[i]) and len(short[j])) and (sketches[i] == sketches[j]).mean() >= least]
        if by_code:
            marked[short[i]] = True
            ends = np.cumsum([len(short[j]) for j in by_code])
            met = np.add.reduceat(marked[np.concatenate([short[j] for j in by_code])].astype(np.int64), np.concatenate([[0], ends[:-1]]))
            marked[short[i]] = False
            near += [j for j, m in zip(by_code, met.tolist(), strict=True) if 100 * m >= percent * (n[i] + n[j] - m)]
        us.append(np.full(len(near), code[i]))
        vs.append(code[near] if near else code[:0])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})


class Links:
    """The work of one call: stored tables and the links found so far."""

    def __init__(self, docs: DataFrame, width: int, percent: int, bands: int, rows: int, refuse: float):
        self.percent, self.refuse = percent, refuse
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, code long, bands array<long>, sketch binary"
        self.rows = common.stored(docs.mapInArrow(lambda b: described(b, width, bands, rows), schema))
        self.classes = common.stored(
            self.rows.where("n_shingles > 0").groupBy("code")
            .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        )
        members = self.classes.select("code", F.explode("bands").alias("band"))
        shared = common.stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        #: Members of bands that hold more than one class.
        self.members = common.stored(members.join(shared, "band"))
        common.discard(shared)
        wanted = self.members.select("code").distinct()
        self.candidates = common.stored(self.classes.join(wanted, "code").select("code", "doc_id", "sketch"))
        named = self.candidates.select(F.col("doc_id").alias("_id"), "code")
        texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "code")
        self.sets = common.stored(texts.mapInArrow(lambda b: _sets(b, width), "code long, n long, short binary, codes binary").dropDuplicates(["code"]))
        self.labels = None

    def confirm(self, pairs: DataFrame) -> None:
        """Verify pairs (u, v) and join the components of the true ones."""
        def sides(table: DataFrame, column: str) -> DataFrame:
            out = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct() if table is None else table
            for end in "uv":
                source = self.candidates if column == "sketch" else self.sets
                out = out.join(source.select(F.col("code").alias(end), F.col(column).alias(f"{column}_{end}")), end)
            return out

        refuse, percent = self.refuse, self.percent
        near = common.stored(sides(None, "sketch").mapInArrow(lambda b: _alike(b, refuse), "u long, v long"))
        found = common.stored(sides(near, "codes").mapInArrow(lambda b: _confirmed(b, percent), "u long, v long"))
        common.discard(near)
        self.contract(found)
        common.discard(found)

    def contract(self, links: DataFrame) -> None:
        """Bring new links into the labels: they join components, so only what they join is looked at again."""
        if self.labels is None:
            self.labels = components(links)
            return
        if links.isEmpty():
            return
        roots = self.labels.select(F.col("node").alias("n"), "root")
        edges = links.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left")
        moved = components(edges.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        after = self.labels.join(moved.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = moved.join(self.labels.select("node"), "node", "left_anti")
        old, self.labels = self.labels, common.stored(after.unionByName(fresh.select("node", "root")))
        common.discard(old, moved)

    def open_members(self) -> DataFrame:
        """Members, with their component, of the bands that hold several components."""
        labelled = common.stored(
            self.members.join(self.label_of(), "code", "left").select("band", "code", F.coalesce("label", "code").alias("label"))
        )
        mixed = common.stored(
            labelled.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
            .where("a <> b").select("band", "n")
        )
        members = common.stored(labelled.join(mixed, "band"))
        common.discard(labelled, mixed)
        return members

    def label_of(self) -> DataFrame:
        return self.labels.select(F.col("node").alias("code"), F.col("root").alias("label"))

    def close(self) -> None:
        """Delete all tables but the rows."""
        common.discard(self.classes, self.members, self.candidates, self.sets, self.labels)

    def by_popular_hub(self) -> None:
        shares = self.members.groupBy("code").agg(F.sum("n").alias("shares"))
        hubs = common.stored(
            self.members.join(shares, "code").groupBy("band").agg(F.max(F.struct("shares", "code"))["code"].alias("hub"))
        )
        self.confirm(self.members.join(hubs, "band").where("code <> hub").select(F.col("code").alias("u"), F.col("hub").alias("v")))
        common.discard(hubs)

    def by_drawn_hub(self, turn: int) -> bool:
        """Join the open members of each band with one of them; False if none is open."""
        members = self.open_members()
        if members.isEmpty():
            return False
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "band", "code").alias("h"), "code", "label"))
        hubs = common.stored(members.groupBy("band").agg(drawn.alias("hub")).select("band", "hub.code", "hub.label").toDF("band", "v", "hub_label"))
        self.confirm(members.join(hubs, "band").where("label <> hub_label").select(F.col("code").alias("u"), "v"))
        common.discard(members, hubs)
        return True

    def by_blocks(self) -> None:
        """Compare all members of a band that are still in different components, in pairs of blocks."""
        members = self.open_members()
        if members.isEmpty():
            return
        refuse, percent = self.refuse, self.percent
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = members.select(
            "band", "code", "label", F.pmod(F.xxhash64("code"), blocks).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        )
        # A member is the left side of its block's pairs with blocks from its own on, and the right side of the others.
        as_left = rows.where("block <= other").select("band", "code", "label", F.lit(0).alias("side"), F.col("block").alias("a"), F.col("other").alias("b"))
        as_right = rows.where("block >= other").select("band", "code", "label", F.lit(1).alias("side"), F.col("other").alias("a"), F.col("block").alias("b"))
        described = self.sets.select("code", "n", "short").join(self.candidates.select("code", "sketch"), "code").select(
            "code", "n", "short", F.when(F.col("short").isNull() | (F.length("short") > SHORT) | F.lit(percent < 50), F.col("sketch")).alias("sketch")
        )
        pairs = as_left.unionByName(as_right).join(described, "code").groupBy("band", "a", "b").applyInArrow(
            lambda g: _block_pairs(g, refuse, percent), "u long, v long"
        )
        self.confirm(pairs)
        common.discard(members)


def plan(percent: int) -> tuple[int, int, float]:
    """Bands, rows and ``refuse`` for a threshold: a pair at it is missed with 5e-7 at most, as at 80."""
    if percent >= 80:
        return 48, 6, 0.66
    s = percent / 100
    rows = next((r for r in (6, 4, 3, 2) if (1 - s**r) ** (288 // r) <= 5e-7), 1)
    return 288 // rows, rows, max(0.0, s - 6 * (s * (1 - s) / 288) ** 0.5)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80,
                    bands: int | None = None, rows: int | None = None, refuse: float | None = None, draws: int = 3) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept), one row per input row; text_key is the hash of the text."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    own = plan(percent)
    bands, rows, refuse = (b if a is None else a for a, b in zip((bands, rows, refuse), own, strict=True))
    work = Links(docs, width, percent, bands, rows, refuse)
    found = work.classes.select("code", "doc_id", F.col("code").alias("label"))
    if not work.members.isEmpty():
        work.by_popular_hub()
        if all(work.by_drawn_hub(turn) for turn in range(draws)):
            work.by_blocks()
        found = work.classes.join(work.label_of(), "code", "left").select("code", "doc_id", F.coalesce("label", "code").alias("label"))
    smallest = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = common.stored(found.join(smallest, "label").select("code", "component_id"))
    work.close()
    full = work.rows.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "code").join(of_class, "code")
    empty = work.rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "text_key", "n_shingles", "component_id").unionByName(empty).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with its own columns; a row that repeats it is kept with it."""
    own_id, own_key = common.fresh(docs, "kept_id", "kept_key")
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)
    ).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key))
    return docs.join(kept, same, "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), width=4).drop("text_key")
