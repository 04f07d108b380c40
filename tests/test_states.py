"""Keyed states driven without a stream: what reaches them, what they keep, what they say."""

import random

import pyarrow as pa
from pyspark.sql import Row

from gistline.streaming import state as S


class Values:
    """A value or list of a state, and how often it was written."""

    def __init__(self):
        self.rows, self.writes = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows) if self.many else self.rows[0]

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    def appendValue(self, row):
        self.rows, self.writes = [*self.rows, row], self.writes + 1

    def update(self, row):
        self.rows, self.writes = [row], self.writes + 1

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.values, self.timers = Values(), []

    def getListState(self, name, schema):
        self.values.many = True
        return self.values

    def getValueState(self, name, schema):
        self.values.many = False
        return self.values

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def parts(schema, rows, size):
    """Rows as they come: record batches of ``size`` rows."""
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    return [Row(bucket=1, rows=b.serialize().to_pybytes()) for b in table.to_batches(max_chunksize=size)]


def test_lock_in_state_takes_and_says_whole_batches(monkeypatch):
    schema = pa.schema([("fingerprint", pa.string()), ("captured_at", pa.int64()), ("sample_id", pa.int64()), ("sha", pa.binary())])
    draw = random.Random(3)
    for n, fast, cap, held in ((5, 3, 64, 10**6), (5, 3, 64, 50), (2, 3, 64, 10**6), (4, 4, 3, 50), (1, 1, 1, 10**6)):
        monkeypatch.setattr(S, "HELD_ROWS", held)
        state, handle = started(S.LockIn(n, fast, cap, schema))
        known, said, want = {}, [], []
        for batch in range(6):
            new = [(draw.choice([None, "", *map(str, range(300))]), draw.choice([None, *range(4)]), draw.choice([None, *range(9)]),
                    draw.choice([None, b"a", b"a", b"a\x00"])) for _ in range(400)]
            before = handle.values.writes
            got = list(state.handleInputRows((1,), iter(parts(schema, new, 70)), None))
            assert len(got) <= 1 and handle.values.writes - before <= 1  # before: a row for each verdict
            said += [v for r in got for v in zip(r.fingerprint, r.n_samples, r.reason, strict=True)]
            # Nulls come first; a text that is null has a hash of its own.
            for f, _, _, sha in sorted(new, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0, r[3] or b"")):
                own = known.setdefault(f, [])
                if own is None or len(own) >= min(n, cap):
                    continue
                own.append(sha or b"")
                if len(own) >= n or len(own) >= fast and len(set(own)) == 1:
                    want.append((f, len(own), "reached_n" if len(own) >= n else "zero_variance_fast_path"))
                    known[f] = None
            assert sorted(said, key=str) == sorted(want, key=str)
            stored = S.unpacked([s for (s,) in handle.values.rows], S.LockIn.SAMPLES)
            live = sum(1 if own is None else len(own) for own in known.values())
            assert live <= stored.num_rows <= 2 * live
        assert want or cap < n


def test_near_duplicate_state_shares_buckets():
    """Chains of many slots in one value of the state, against a look at all runs; late runs are dropped, dead chains leave."""
    seconds, width = 20, 160
    schema = pa.schema([("agent", pa.string()), ("fingerprint", pa.string()), ("slot", pa.int64()), ("started_at", pa.int64()),
                        ("run_id", pa.int64()), ("own", pa.bool_())])
    draw = random.Random(5)
    state, handle = started(S.NearDuplicates(seconds, width, schema))
    runs, verdicts, rows_out, watermark = [], {}, 0, 0
    for batch in range(8):
        new = []
        for _ in range(150):
            at = 1000 + draw.randrange(batch * 100, batch * 100 + 300)
            new.append((draw.choice([None, "a", "b"]), draw.choice([None, "f", "g", ""]), at, draw.randrange(10**9)))
        rows = [(a, f, s, at, run, s == at // width) for a, f, at, run in new for s in range(at // width, (at + seconds) // width + 1)]
        got = list(state.handleInputRows((1,), iter(parts(schema, rows, 64)), Now(watermark * 1000)))
        rows_out += len(got)
        for r in got:
            for run, near in zip(r.run_id, r.near_duplicate, strict=True):
                verdicts[run] = verdicts.get(run, False) or near
        runs += [r for r in new if r[2] > watermark]
        assert handle.values.rows and len(handle.timers) == 1
        left = S.unpacked([handle.values.rows[0][0]], state.stored)
        assert min(left["last_at"].to_pylist()) >= watermark - seconds
        watermark = max(r[2] for r in runs) - 150
    want = {run: any(r[:2] == (a, f) and (r[2], r[3]) < (at, run) and at - r[2] <= seconds for r in runs) for a, f, at, run in runs}
    assert verdicts == want and True in want.values() and False in want.values()
    assert rows_out <= 8  # before: a row for each verdict
    assert list(state.handleInputRows((1,), iter([]), Now(10**9))) == [] and not handle.values.rows
