"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

A conversation is legal if it is an optional system turn, then user and assistant turns in
alternation, where tool turns may stand between two assistant turns, and the end follows an
assistant turn. For each turn the repair keeps or changes its role, lets it follow the turn before,
merges it into that turn, or puts empty turns between them; it chooses the cheapest sequence. A
turn acts on costs by a small matrix over the states of the automaton, and matrices multiply in
the (min, +) algebra. So a conversation of any length is cut into blocks:

1. Turns are range-partitioned by (conversation, turn); a run of one conversation in a partition, at
   most ``BLOCK_TURNS`` long, is a block, and gives its matrix.
2. The matrices of a conversation are combined in order; only they meet in one task. That fixes the
   state at which each block begins and ends.
3. Each block is solved again between its two states, and its turns are rendered.

Of equal costs, keeping a role goes before changing it, following before merging before inserting, and
the order of ``ROLES`` decides the rest.

Edge cases: an unknown or null role has every role at the price of a change; a null text is an empty
turn, and is merged at no price where a merge is legal; turns are ordered by number, then role, then
text, nulls first, and repeated rows are turns each; rows with a null conversation are one
conversation; an empty table gives no rows. Very long texts are passed through whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

ROLES = ["system", "user", "assistant", "tool"]
#: State 0 is the start, state 1 + i stands after a turn of role i.
STATES = 1 + len(ROLES)
LEGAL = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user", "tool"), 4: ("assistant", "tool")}
FINAL = (3,)
KEEP, CHANGE, MERGE, INSERT = 0, 30, 10, 25
BLOCK_TURNS = 10_000
INFINITE = 1 << 40


class Automaton:
    """Costs and moves between states, for one set of prices."""

    def __init__(self, change: int = CHANGE, merge: int = MERGE, insert: int = INSERT):
        self.step = np.full((STATES, STATES), INFINITE, np.int64)  # to follow, with empty turns put between
        self.path: dict[tuple[int, int], list[str]] = {}
        steps = {(p, 1 + ROLES.index(r)) for p, roles in LEGAL.items() for r in roles}
        for p, q in itertools.product(range(STATES), range(1, STATES)):
            ways = [list(w) for k in range(STATES) for w in itertools.permutations(range(1, STATES), k)]
            ways = [w for w in ways if all(x in steps for x in itertools.pairwise([p, *w, q]))]
            if ways:
                best = min(ways, key=lambda w: (len(w), w))
                self.path[p, q] = [ROLES[s - 1] for s in best]
                self.step[p, q] = insert * len(best)
        self.end = np.full(STATES, INFINITE, np.int64)
        self.tail: dict[int, list[str]] = {}
        for p in range(STATES):
            options = [(0, [])] if p in FINAL or p == 0 else []
            options += [(int(self.step[p, f]) + insert, [*self.path[p, f], ROLES[f - 1]]) for f in FINAL if (p, f) in self.path]
            self.end[p], self.tail[p] = min(options, key=lambda o: (o[0], len(o[1]), o[1]))
        self.change, self.merge = change, merge
        self.moves = {(r, e): self._moves(r, e) for r in (*ROLES, None) for e in (False, True)}

    def _moves(self, role: str | None, empty: bool) -> tuple[np.ndarray, np.ndarray]:
        """(costs, merged) from state to state for one turn."""
        price = np.array([KEEP if ROLES[q] == role else self.change for q in range(len(ROLES))])
        cost = self.step.copy()
        cost[:, 1:] += price[None, :]
        merged = np.zeros((STATES, STATES), bool)
        for q in range(1, STATES):
            joint = (0 if empty else self.merge) + (0 if empty else price[q - 1])
            if joint < cost[q, q]:
                cost[q, q], merged[q, q] = joint, True
        return np.minimum(cost, INFINITE), merged

    def turn(self, role: str | None, empty: bool) -> tuple[np.ndarray, np.ndarray]:
        return self.moves[role if role in ROLES else None, empty]

    def matrix(self, turns: list[tuple]) -> np.ndarray:
        """Cheapest costs from each state before a block to each state after it."""
        total = np.where(np.eye(STATES, dtype=bool), 0, INFINITE).astype(np.int64)
        for role, empty in turns:
            total = times(total, self.turn(role, empty)[0])
        return total

    def solve(self, turns: list[tuple], begin: int, end: int) -> list[tuple[int, int, bool]]:
        """Per turn (state before, state after, merged) of a cheapest way between two states."""
        cost = np.full(STATES, INFINITE, np.int64)
        cost[begin] = 0
        back = []
        for role, empty in turns:
            step, _ = self.turn(role, empty)
            ways = cost[:, None] + step
            back.append(ways.argmin(axis=0))
            cost = np.minimum(ways.min(axis=0), INFINITE)
        out, state = [], end
        for (role, empty), best in zip(reversed(turns), reversed(back), strict=True):
            before = int(best[state])
            out.append((before, state, bool(self.turn(role, empty)[1][before, state])))
            state = before
        return out[::-1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INFINITE)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the block and the place in it to sorted turns."""
    part = TaskContext.get().partitionId()
    block, place, last, begun = -1, 0, None, False
    for batch in batches:
        blocks, places = [], []
        for conv in batch.column("conv_id").to_pylist():
            if not begun or conv != last or place >= BLOCK_TURNS:
                block, place, last, begun = block + 1, 0, conv, True
            blocks.append(part << 32 | block)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "block", "place"]
        )


def _ordered(group: pa.Table) -> tuple[pa.Table, list[tuple]]:
    group = group.sort_by("place")
    empty = [not t for t in group.column("text").to_pylist()]
    return group, list(zip(group.column("role").to_pylist(), empty, strict=True))


def _matrix(group: pa.Table, model: Automaton) -> pa.Table:
    _, turns = _ordered(group)
    costs = model.matrix(turns).ravel().tolist()
    return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "block": group.column("block").slice(0, 1), "costs": pa.array([costs], pa.list_(pa.int64()))})


def _chain(group: pa.Table, model: Automaton) -> pa.Table:
    """The states at the ends of each block of a conversation, on a cheapest way through all of them."""
    group = group.sort_by("block")
    matrices = [np.array(c, np.int64).reshape(STATES, STATES) for c in group.column("costs").to_pylist()]
    cost = np.full(STATES, INFINITE, np.int64)
    cost[0] = 0
    back = []
    for m in matrices:
        ways = cost[:, None] + m
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    end = int((cost + model.end).argmin())
    total = int((cost + model.end)[end])
    begins, ends = [], []
    for best in reversed(back):
        ends.append(end)
        end = int(best[end])
        begins.append(end)
    n = len(matrices)
    return pa.table({
        "block": group.column("block"), "begin": pa.array(begins[::-1], pa.int32()), "end": pa.array(ends[::-1], pa.int32()),
        "last": pa.array([i == n - 1 for i in range(n)]), "cost": pa.array([total] * n, pa.int64()),
    })


def opened(role: str) -> str:
    return f"<|{role}|>\n"


CLOSED = "<|end|>\n"


def _render(turns: pa.Table, states: pa.Table, model: Automaton) -> pa.Table:
    """One row per turn of a block: the chosen role, what was done, and the turn's piece of the rendered text.

    A piece closes the turn before it unless it is merged into that; so pieces need no look ahead.
    """
    turns, roles = _ordered(turns)
    state = states.to_pylist()[0]
    plan = model.solve(roles, state["begin"], state["end"])
    chosen, actions, pieces, inserted = [], [], [], []
    for (role, _), text, (before, after, merged) in zip(roles, turns.column("text").to_pylist(), plan, strict=True):
        name = ROLES[after - 1]
        between = [] if merged else model.path[before, after]
        if merged:
            piece = "\n" + text if text else ""
        else:
            piece = (CLOSED if before else "") + "".join(opened(r) + CLOSED for r in between) + opened(name) + (text or "")
        chosen.append(name)
        inserted.append(len(between))
        actions.append("merge" if merged else ("keep" if name == role else "relabel"))
        pieces.append(piece)
    if state["last"] and pieces:
        tail = model.tail[state["end"]]
        pieces[-1] += CLOSED + "".join(opened(r) + CLOSED for r in tail)
        inserted[-1] += len(tail)
    return pa.table({
        "conv_id": turns.column("conv_id"), "turn": turns.column("turn"), "block": turns.column("block"), "place": turns.column("place"),
        "role": pa.array(chosen), "action": pa.array(actions), "n_inserted": pa.array(inserted, pa.int32()),
        "piece": pa.array(pieces, pa.string()), "cost": pa.array([state["cost"]] * len(pieces), pa.int64()),
    })


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
           change: int = CHANGE, merge: int = MERGE, insert: int = INSERT, parts: int | None = None) -> DataFrame:
    """One row per input turn: conv_id, turn, block, place, role, action, n_inserted, piece and cost.

    The pieces of a conversation in the order of (block, place) are its rendered text; ``cost`` is that
    of the whole conversation.
    """
    spark = common.ship(turns.sparkSession)
    model = Automaton(change, merge, insert)
    turns = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = f"conv_id {conv}, turn {turn}, role string, text string, block bigint, place bigint"
    blocks = common.stored(turns.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions(*order).mapInArrow(_numbered, schema))
    matrices = blocks.select("conv_id", "block", "place", "role", F.when(F.length("text") > 0, "x").otherwise("").alias("text")).groupBy("block").applyInArrow(
        lambda g: _matrix(g, model), f"conv_id {conv}, block bigint, costs array<bigint>"
    )
    states = common.stored(matrices.groupBy("conv_id").applyInArrow(
        lambda g: _chain(g, model), "block bigint, begin int, end int, last boolean, cost bigint"
    ))
    return blocks.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(
        lambda t, s: _render(t, s, model),
        f"conv_id {conv}, turn {turn}, block bigint, place bigint, role string, action string, n_inserted int, piece string, cost bigint",
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = repair(common.table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", "action", "n_inserted", "cost", F.sha2("piece", 256).alias("piece_sha256"))
