"""Keyed state of the streams: what one key remembers, and until when."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


# Verdicts that one row of lists carries, and rows that a bucket holds before it drops those that cannot count.
LISTED, HELD_ROWS = 100_000, 1_000_000


def set_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer per key, at the latest time asked for."""
    for old in list(handle.listTimers()):
        if old >= at_ms:
            return
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


def unpacked(parts: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    """Record batches of ``jobs._packed``, or of a state, as one table."""
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in parts], schema)


def packed(table: pa.Table) -> bytes:
    (whole,) = table.combine_chunks().to_batches()
    return whole.serialize().to_pybytes()


def coded(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, null among them, and the values by their numbers."""
    found = values.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def starts_of(groups: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours starts."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)


class LockIn(StatefulProcessor):
    """Hashes of the first samples of each fingerprint of a bucket; after the verdict null, that there was one.

    A call to the state costs many times the work on a fingerprint, so a bucket reads its fingerprints at once and appends
    what is new as one record batch of samples in their order. The samples of a fingerprint that locked are outdated; the list
    is written anew before more than half of it is. Input rows are record batches too (``schema``).
    """

    SAMPLES = pa.schema([("fingerprint", pa.string()), ("sha", pa.binary())])

    def __init__(self, n: int, fast: int, cap: int, schema: pa.Schema):
        self.n, self.fast, self.cap, self.schema = n, fast, cap, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "samples binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        most = min(self.n, self.cap)  # the n-th locks at the latest
        old = unpacked((s for (s,) in self.known.get()), self.SAMPLES)
        new = self.first(rows, most).select(["fingerprint", "sha"])
        every = pa.concat_tables([old, new])
        groups, fingerprints = coded(every["fingerprint"])
        shas, _ = coded(every["sha"])
        fresh = np.arange(len(groups)) >= old.num_rows
        locked = np.zeros(len(fingerprints), bool)
        locked[groups[every["sha"].is_null().to_numpy() & ~fresh]] = True

        live = np.flatnonzero(~locked[groups])
        live = live[np.argsort(groups[live], kind="stable")]
        starts = starts_of(groups[live])
        sizes = np.diff(np.r_[starts, len(live)])
        nth = np.arange(1, len(live) + 1) - np.repeat(starts, sizes)
        other = np.cumsum(shas[live] != shas[live[np.repeat(starts, sizes)]])  # a first one is never other
        equal = other == np.repeat(other[starts], sizes)
        room = fresh[live] & (nth <= most)
        verdicts = np.flatnonzero(room & ((nth >= self.n) | (nth >= self.fast) & equal))
        verdicts = verdicts[starts_of(groups[live[verdicts]])]
        now = groups[live[verdicts]]
        for k in range(0, len(now), LISTED):
            some = verdicts[k : k + LISTED]
            yield Row(fingerprint=fingerprints.take(groups[live[some]]).to_pylist(), n_samples=nth[some].tolist(),
                      reason=np.where(nth[some] >= self.n, "reached_n", "zero_variance_fast_path").tolist())

        flags = pa.table([fingerprints.take(now), pa.nulls(len(now), pa.binary())], schema=self.SAMPLES)
        locked[now] = True
        open_ = ~locked[groups[live]]
        added = pa.concat_tables([every.take(live[room & open_]), flags])
        flagged = np.flatnonzero(~fresh & every["sha"].is_null().to_numpy())
        kept = live[open_ & (room | ~fresh[live])]
        if old.num_rows + added.num_rows > 2 * (len(kept) + len(flagged) + len(now)):
            self.known.put([(packed(pa.concat_tables([every.take(np.r_[flagged, kept]), flags])),)])
        elif added.num_rows:
            self.known.appendValue((packed(added),))

    def first(self, rows: Iterator[Row], most: int) -> pa.Table:
        """The first ``most`` samples of each fingerprint, those of a fingerprint in their order."""
        held, n = [self.schema.empty_table()], 0
        for r in rows:
            held.append(unpacked([r.rows], self.schema))
            n += held[-1].num_rows
            if n >= HELD_ROWS:
                held = [self.cut(held, most)]
                n = min(held[0].num_rows, HELD_ROWS // 2)
        return self.cut(held, most)

    def cut(self, held: list[pa.Table], most: int) -> pa.Table:
        table = pa.concat_tables(held)
        # A text that is null counts as one of its own; null stands for the verdict in the state.
        table = table.set_column(table.column_names.index("sha"), "sha", pc.fill_null(table["sha"], b""))
        groups, _ = coded(table["fingerprint"])
        order = pc.sort_indices(
            table, [(c, "ascending") for c in ("captured_at", "sample_id", "sha")], null_placement="at_start").to_numpy()
        order = order[np.argsort(groups[order], kind="stable")]
        starts = starts_of(groups[order])
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return table.take(order[nth < most])

    def close(self) -> None:
        pass


class NearDuplicates(StatefulProcessor):
    """Chains of runs of one agent, fingerprint and slot of time: each run within ``seconds`` of the one before.

    Of a chain only the first run may yet become a near duplicate, and a run that comes late between its first and last
    is one, so a chain is known by its ends. Runs that are not the slot's own only stand before those that are. Slots share
    a bucket, whose chains are one record batch; input rows are record batches too (``schema``).
    """

    KEYS = ("agent", "fingerprint", "slot")

    def __init__(self, seconds: int, width: int, schema: pa.Schema):
        self.seconds, self.width, self.schema = seconds, width, schema
        self.stored = schema.append(pa.field("last_at", pa.int64()))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chains = handle.getValueState("chains", "chains binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        # A run to come is not older than the watermark, so chains that end before this are out of its reach.
        horizon = watermark // 1000 - self.seconds
        old = unpacked([self.chains.get()[0]] if self.chains.exists() else [], self.stored)
        old = old.filter(pc.greater_equal(old["last_at"], horizon))
        new = unpacked((r.rows for r in rows), self.schema)
        # Spark drops batches that are late as a whole.
        new = new.filter(pc.greater(pc.multiply(new["started_at"], 1000), watermark))
        every = pa.concat_tables([old, new.append_column("last_at", new["started_at"])])
        groups = [coded(every[c])[0] for c in self.KEYS]
        at = every["started_at"].to_numpy()
        order = pc.sort_indices(every, [("started_at", "ascending"), ("run_id", "ascending")], null_placement="at_start").to_numpy()
        order = order[np.lexsort([g[order] for g in groups])]
        fresh, own, at = order >= old.num_rows, every["own"].to_numpy()[order], at[order]
        first = np.ones(len(order), bool)  # of its slot
        first[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
        # The latest end so far in a slot; a slot's times lie within its reach, so each slot gets a range above the one before.
        base = every["slot"].to_numpy()[order] * self.width - self.seconds
        above = np.cumsum(first) * (self.width + 2 * self.seconds + 1)
        reached = np.maximum.accumulate(every["last_at"].to_numpy()[order] - base + above) + base - above
        near = np.zeros(len(order), bool)
        near[1:] = ~first[1:] & (at[1:] - reached[:-1] <= self.seconds)
        said = order[own & (fresh | near)]
        hits = near[own & (fresh | near)]
        for k in range(0, len(said), LISTED):
            yield Row(run_id=every["run_id"].take(said[k : k + LISTED]).to_pylist(), near_duplicate=hits[k : k + LISTED].tolist())

        starts = np.flatnonzero(~near)
        ends = reached[np.r_[starts[1:], len(order)] - 1] if len(order) else reached
        kept = ends >= horizon
        if kept.any():
            left = every.take(order[starts[kept]]).drop_columns(["last_at"]).append_column("last_at", pa.array(ends[kept]))
            self.chains.update((packed(left),))
            set_timer(self.handle, int(ends[kept].max() + self.seconds + 1) * 1000)
        else:
            self.chains.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.chains.clear()
        yield from ()

    def close(self) -> None:
        pass


class BypassScores(StatefulProcessor):
    """The newest sessions of a profile with their weights, and others that had events of late."""

    def __init__(self, window: int, warmup: int, keep: int):
        self.window, self.warmup, self.keep = window, warmup, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "session_id string, latest long, weight double")
        self.others = handle.getMapState("others", "session_id string", "latest long, weight double")
        self.observed = handle.getValueState("observed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now: dict[str, list] = {}
        for r in rows:
            at = now.setdefault(r.session_id, [r.at, 0.0])
            at[0] = max(at[0], r.at)
            at[1] += r.weight or 0.0
        top = {r[0]: [r[1], r[2]] for r in self.newest.get()}
        observed = self.observed.get()[0] if self.observed.exists() else 0
        for session, (latest, weight) in now.items():
            before = top.get(session)
            if before is None and self.others.containsKey((session,)):
                before = list(self.others.getValue((session,)))
                self.others.removeKey((session,))
            observed += before is None
            old = before or [latest, 0.0]
            top[session] = [max(old[0], latest), old[1] + weight]
        # The latest time of a session only grows, so none but these can be among the newest.
        order = sorted(top, key=lambda s: (-top[s][0], s))
        horizon = timerValues.getCurrentWatermarkInMs() // 1000 - self.keep
        for session in order[self.window :]:
            if top[session][0] >= horizon:
                self.others.updateValue((session,), tuple(top[session]))
                set_timer(self.handle, (top[session][0] + self.keep + 1) * 1000)
        order = order[: self.window]
        self.newest.put([(s, *top[s]) for s in order])
        self.observed.update((observed,))
        if observed > self.warmup:
            scores = [min(top[s][1], 1.0) for s in sorted(order)]
            yield Row(profile_id=key[0], score=sum(scores) / len(scores), n_sessions=len(scores), observed=observed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        horizon = timerValues.getCurrentWatermarkInMs() // 1000 - self.keep
        left = []
        for (session,), (latest, _) in list(self.others.iterator()):
            if latest < horizon:
                self.others.removeKey((session,))
            else:
                left.append(latest)
        if left:
            set_timer(self.handle, (max(left) + self.keep + 1) * 1000)
        yield from ()

    def close(self) -> None:
        pass


class DedupAdjacent(StatefulProcessor):
    """The last line of a session."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lines = sorted(rows, key=lambda r: (r.line_no, r.sub_no))
        before = self.last.get()[0] if self.last.exists() else None
        for r in lines:
            if before is None or (r.text is not None and r.text != before):
                yield Row(session_id=r.session_id, line_no=r.line_no, sub_no=r.sub_no, text=r.text, is_placeholder=r.is_placeholder)
            before = r.text
        self.last.update((before,))
        set_timer(self.handle, int(max(r.ts for r in lines).timestamp() * 1000) + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass
