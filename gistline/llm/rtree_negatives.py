"""Hard negatives by inner product, from STR-packed R-trees.

Vectors are whole numbers, floor(256 x). A table is packed by sort-tile-recursive: Spark cuts it into slabs along
the coordinate of widest spread and slabs into tiles along the next, by ranges that end on an id, so that equal
coordinates do not unbalance them. Inside a tile, which one task holds, the recursion goes on over further coordinates
down to leaves of ``LEAF`` rows. Leaves, and nodes of ``FAN`` leaves, keep minimum bounding boxes.

A box gives each query an interval of inner products, the sum of one interval per coordinate. Boxes leave a
best-first queue by falling upper end. A box is not read if its interval lies outside all score windows of the query,
or if its upper end is strictly below the k-th score found so far in each of them. Queries stream past the tree of a
tile, in groups against every tile, and the k best of each tile are ranked over all tiles. In the first search the
window is everything and candidates have the query's label; in the second each positive opens a window of its own.

Scores are exact: sums are taken in doubles where Cauchy-Schwarz keeps them below 2^53, else in Python's
integers. Those beyond 64 bits are held to the ends of the range.

Edge cases: rows with a null id, label or vector or with a null, NaN or infinite component (after scaling) take no
part; vectors are compared with those of their own length only; of rows that share an id the least (label, vector)
stands for it, so repeated rows count once; equal scores go to the smaller id, and a box whose upper end equals the
k-th score is read; a query with fewer candidates than asked gets all; an empty table gives an empty result. Ids
are whole numbers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline.llm import common

LEAF, FAN = 128, 16
#: Most and fewest rows of a tile; queries of a group; queries that are searched at once.
TILE, LEAST_TILE = 1 << 16, 1 << 10
GROUP, BATCH = 1 << 16, 1 << 10
#: Coordinates that pack a tile.
PACKED = 4
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Score and id of a place that no row holds: below every score, behind every id.
NO_SCORE, NO_ID = -LONG - 1, LONG


def pack(vectors: np.ndarray, leaf: int = LEAF, coordinates: int = PACKED) -> list[np.ndarray]:
    """Row numbers of each leaf: sorted and cut along the widest coordinates in turn."""
    with np.errstate(all="ignore"):
        widest = np.argsort(-vectors.std(axis=0), kind="stable")[:coordinates]

    def cut(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not len(axes):
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        size = -(-leaves // int(np.ceil(leaves ** (1 / len(axes))))) * leaf
        return [part for i in range(0, len(rows), size) for part in cut(rows[i : i + size], axes[1:])]

    return cut(np.arange(len(vectors)), widest)


def _whole(a: np.ndarray) -> np.ndarray:
    """Doubles as Python's integers."""
    out = np.empty(a.size, object)
    out[:] = [int(x) for x in a.ravel()]
    return out.reshape(a.shape)


def _held(a: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers."""
    return np.minimum(np.maximum(a, -LONG), LONG).astype(np.int64) if a.dtype == object else a.astype(np.int64)


class Tree:
    """Leaves of rows, sorted by id inside, with boxes, and nodes of leaves with boxes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaves = []
        for rows in pack(vectors, leaf):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            self.leaves.append((ids[rows], labels[rows], vectors[rows]))
        self.low = np.array([v.min(axis=0) for *_, v in self.leaves])
        self.high = np.array([v.max(axis=0) for *_, v in self.leaves])
        at = np.arange(0, len(self.leaves), FAN)
        self.node_low, self.node_high = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)
        self.norm = _norm(vectors)
        self.read = 0  # pairs of a query and a leaf read

    def search(self, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
               k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows in each window of each query.

        Windows reach from ``low`` to ``high``, of shape (queries, windows), both included; low > high is empty.
        """
        whole = not self.norm * _norm(queries) * 2 < EXACT
        if whole:
            queries = _whole(queries)
        scores = np.full((*low.shape, k), NO_SCORE, np.int64)
        found = np.full((*low.shape, k), NO_ID, np.int64)
        upper, inside = self._bounds(queries, low, high, whole)
        # No bound changes, so the queue of a query is its leaves by falling bound.
        order = np.argsort(np.where(inside, ~upper, LONG), axis=1, kind="stable")
        active = np.arange(len(queries))
        for step in range(order.shape[1]):
            box = order[active, step]
            floor = np.maximum(scores[active, :, -1], low[active])
            open_ = (upper[active, box][:, None] >= floor) & (low[active] <= high[active])
            alive = open_.any(axis=1) & inside[active, box]
            active, box = active[alive], box[alive]
            for leaf in np.unique(box):
                self._read(leaf, active[box == leaf], queries, ids, labels, low, high, same, whole, scores, found)
        return scores, found

    def _bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Upper end of each leaf for each query, and whether it and its node reach into a window."""
        shape = len(queries), len(self.leaves)
        upper, inside = np.full(shape, NO_SCORE, np.int64), np.zeros(shape, bool)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)

        def ends(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if whole:
                least, most = _whole(least), _whole(most)
            return _held(plus @ least.T + minus @ most.T), _held(plus @ most.T + minus @ least.T)

        def reach(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            out = np.zeros(least.shape, bool)
            for a, b in zip(low.T[:, :, None], high.T[:, :, None], strict=True):
                out |= (a <= b) & (most >= a) & (least <= b)
            return out

        nodes = reach(*ends(self.node_low, self.node_high))
        for node in np.flatnonzero(nodes.any(axis=0)):
            part = slice(node * FAN, (node + 1) * FAN)
            least, upper[:, part] = ends(self.low[part], self.high[part])
            inside[:, part] = reach(least, upper[:, part]) & nodes[:, [node]]
        return upper, inside

    def _read(self, leaf, mine, queries, ids, labels, low, high, same, whole, scores, found) -> None:
        """Rows of one leaf into the results of the queries ``mine``."""
        own, own_labels, vectors = self.leaves[leaf]
        self.read += len(mine)
        product = _held(queries[mine] @ (_whole(vectors) if whole else vectors).T)
        fits = ((own_labels == labels[mine][:, None]) == same) & (own != ids[mine][:, None])
        for j in range(low.shape[1]):
            floor = np.maximum(scores[mine, j, -1], low[mine, j])[:, None]
            ok = fits & (product >= floor) & (product <= high[mine, j][:, None])
            some = np.flatnonzero(ok.any(axis=1))
            rows, k = mine[some], scores.shape[2]
            value = np.concatenate([scores[rows, j], np.where(ok[some], product[some], NO_SCORE)], axis=1)
            name = np.concatenate([found[rows, j], np.where(ok[some], own, NO_ID)], axis=1)
            best = np.lexsort((name, ~value), axis=1)[:, :k]  # ~x falls as x rises, without overflow
            scores[rows, j], found[rows, j] = np.take_along_axis(value, best, 1), np.take_along_axis(name, best, 1)


def _norm(vectors: np.ndarray) -> float:
    with np.errstate(all="ignore"):
        return float(np.sqrt(np.square(vectors).sum(axis=1)).max(initial=0.0))


def prepared(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, q) of the rows that take part, one per id."""
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * 256)
    # From 2^53 on every double is whole; floor would leave the range of a long.
    whole = F.transform("q", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    fit = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), scaled.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    one = rows.groupBy("id").agg(F.min(F.struct("label", whole.alias("q"))).alias("r"))
    return common.stored(one.select("id", "r.label", "r.q"))


def widest(rows: DataFrame, n: int = 2) -> list[int]:
    """The ``n`` coordinates of greatest spread, from sums of each batch."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, q in by_length(batch.column("q")):
                values = q[1]
                with np.errstate(all="ignore"):
                    squares = np.square(values).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(size)), pa.array(np.full(size, float(len(values)))), pa.array(values.sum(axis=0)), pa.array(squares)],
                    names=["at", "n", "s", "ss"])

    table = rows.select("q").mapInArrow(sums, "at long, n double, s double, ss double").groupBy("at").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    spread = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return [r.at for r in table.orderBy(spread.desc_nulls_last(), "at").limit(n).collect()]


def by_length(column: pa.ListArray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(length, (row numbers, matrix)) of the vectors of each length in a column."""
    lengths = np.diff(column.offsets.to_numpy())
    starts, values = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), (rows, values[starts[rows][:, None] + np.arange(size)])


def tiles(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """Rows with ``tile``, and the number of tiles: slabs along one coordinate, tiles along the next."""
    n = max(1, -(-rows.count() // tile_rows))
    first, second = [*widest(rows), 0, 0][:2]
    slabs = int(np.ceil(np.sqrt(n)))
    cut = rows.repartitionByRange(slabs, F.size("q"), F.get("q", F.lit(first)), "id").withColumn("slab", F.spark_partition_id())
    cut = common.stored(cut)
    dealt = cut.repartitionByRange(n, "slab", F.get("q", F.lit(second)), "id").withColumn("tile", F.spark_partition_id())
    return common.stored(dealt.select("tile", "id", "label", "q")), n


FOUND = "query long, window int, id long, score long"


def search(table: DataFrame, n_tiles: int, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, rank, id, score): the k best rows of ``table`` in each window of each query.

    ``queries`` are (id, label, q, low, high) with arrays of window ends.
    """
    common.ship(table.sparkSession)
    groups = max(1, -(-queries.count() // GROUP))
    none = F.lit(None).cast("array<bigint>")
    rows = table.select("tile", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("asks"),
                        "id", "label", "q", none.alias("low"), none.alias("high"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    asks = queries.select(every.alias("tile"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("asks"),
                          "id", "label", "q", "low", "high")
    dealt = rows.unionByName(asks).repartition(n_tiles * groups, "tile", "group").sortWithinPartitions("tile", "group", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, trees = None, [], {}
        codes: dict[str, int] = {}
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("tile", "group", "asks")), strict=True))
            at = 0
            for (tile, group, asks), run_of in groupby(marks):
                part = batch.slice(at, size := len(list(run_of)))
                at += size
                if (tile, group) != key:
                    key, held, trees = (tile, group), [], None
                if not asks:
                    held.append(part)
                    continue
                if trees is None:
                    trees = {size: Tree(*_columns(held, own, codes), q) for size, own, q in _matrices(held)}
                    held = []
                for i in range(0, part.num_rows, BATCH):
                    yield from _answers(trees, part.slice(i, BATCH), codes, k, same)

    found = dealt.mapInArrow(run, FOUND)
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrices(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length in some batches."""
    if parts:
        column = pa.concat_arrays([p.column("q") for p in parts])
        for size, (rows, q) in by_length(column):
            yield size, rows, q


def _columns(parts: list[pa.RecordBatch], rows: np.ndarray, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of the labels."""
    ids = np.concatenate([p.column("id").to_numpy() for p in parts])
    labels = [codes.setdefault(x, len(codes)) for p in parts for x in p.column("label").to_pylist()]
    return ids[rows], np.array(labels, np.int64)[rows]


def _answers(trees: dict, part: pa.RecordBatch, codes: dict, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    for size, rows, q in _matrices([part]):
        if size not in trees:
            continue
        ids, labels = _columns([part], rows, codes)
        ends = [part.column(c).to_pylist() for c in ("low", "high")]
        most = max(len(ends[0][i]) for i in rows)
        low, high = (np.array([[*e[i], *[fill] * (most - len(e[i]))] for i in rows], np.int64).reshape(len(rows), most)
                     for e, fill in zip(ends, (1, 0), strict=True))
        scores, found = trees[size].search(q, ids, labels, low, high, k, same)
        at, window, place = np.nonzero(scores != NO_SCORE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[at]), pa.array(window.astype(np.int32)), pa.array(found[at, window, place]), pa.array(scores[at, window, place])],
            names=["query", "window", "id", "score"])


def _share(score: Column, share: tuple[int, int], up: bool) -> Column:
    """score * numerator / denominator, rounded down or up, without overflow."""
    score = -score if up else score
    rest = F.pmod(score, F.lit(share[1]))
    whole = F.floor((score - rest).cast("decimal(20,0)") / share[1]).cast("bigint") * share[0] + F.floor(rest * share[0] / share[1])
    return (-whole if up else whole).cast("bigint")


def mine(rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 3, least: tuple[int, int] = (1, 2), most: tuple[int, int] = (19, 20),
         tile_rows: int | None = None) -> DataFrame:
    """Hard negatives of each positive of each anchor.

    ``anchor`` is a condition on ``id``. A negative has another label and a score between the shares ``least`` and
    ``most`` of the positive's score. One row per anchor, positive and rank.
    """
    spark = common.ship(rows.sparkSession)
    table = prepared(rows, id_col, F.col(label) if isinstance(label, str) else label, vector_col)
    if tile_rows is None:
        even = -(-table.count() // (2 * spark.sparkContext.defaultParallelism))
        tile_rows = min(max(even, LEAST_TILE), TILE)
    packed, n = tiles(table, tile_rows)
    anchors = common.stored(table.where(anchor))
    everything = anchors.select("*", F.array(F.lit(-LONG)).alias("low"), F.array(F.lit(LONG)).alias("high"))
    best = search(packed, n, everything, positives, True)
    own = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asked = common.stored(anchors.join(own.withColumnRenamed("query", "id"), "id").select(
        "id", "label", "q", "p", F.transform("p", lambda x: _share(x["score"], least, True)).alias("low"),
        F.transform("p", lambda x: _share(x["score"], most, False)).alias("high")))
    found = search(packed, n, asked, negatives, False)
    pairs = asked.select(F.col("id").alias("query"), F.posexplode("p").alias("window", "p"))
    return found.join(pairs, ["query", "window"]).select(
        F.col("query").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


#: DuckDB SQL of the query: every anchor against every row.
ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.id) qualify row_number() over w <= 3"""
