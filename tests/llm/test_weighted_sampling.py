"""Fingerprints against a plain version, term by term, and their likeness against exact similarity."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_plain import EDGE, edge_docs, key
from pyspark.sql import functions as F

from gistline.llm import weighted_sampling as ws

M = (1 << 64) - 1


def mix(x, seed):
    x ^= (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * factor & M
    return x ^ (x >> 33)


def fingerprint(text, samples):
    """The least ln a over all terms, one sample after another."""
    terms = Counter((text or "").encode().lower().split())
    out = []
    for k in range(samples):
        best = None
        for term, weight in terms.items():
            x = xxhash.xxh3_64_intdigest(term)
            first = mix(x ^ mix(k, 1), 0)
            second = mix(first, 2)
            u1, u2, u3, u4, b = (((w >> s & 0x1FFFFF) + 0.5) / 2**21 for w, s in ((first, 0), (first, 21), (first, 42), (second, 0), (second, 21)))
            r, c = -math.log(u1 * u2), -math.log(u3 * u4)
            t = math.floor(math.log(weight) / r + b)
            value = (float(np.float32(math.log(c) - r * (t - b) - r)), x, t)
            best = value if best is None else min(best, value)
        out.append(0 if best is None else 1 + mix(best[1] ^ mix(best[2] & M, 3) ^ mix(k, 4), 5) % 65535)
    return np.array(out, "<u2").tobytes().hex()


def exact(a, b):
    x, y = (Counter(t.encode().lower().split()) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def plain(rows, samples):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        own, other, follow = (fingerprint(x, samples) for x in (t, changed, after))
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other, ws.likeness(own, other), ws.likeness(own, follow)))
    return sorted(out, key=key)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edge_rows(spark, ranges):
    docs = edge_docs(spark, [*EDGE, (-3, "before all others"), (2, "another text of the same id"), (99, A := "a b a b c"), (98, A)])
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = sorted(map(tuple, ws.neighbours(docs, samples=16, ranges=ranges).collect()), key=key)
    assert got == plain(rows, 16)


def test_whole_table(spark, documents, sf_dir):
    got = {r.doc_id: r for r in ws.query(spark, sf_dir).collect()}
    order = sorted(documents)
    assert len(got) == len(order)
    errors = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        changed = ws.edited(t, after)
        row = got[d]
        assert (row.n_chars, row.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        errors += [row.near_edited - exact(t, changed), row.near_next - exact(t, after)]
    assert np.abs(errors).max() < 0.2 and np.sqrt(np.mean(np.square(errors))) < 0.044
    for d, t in order[:3]:
        assert got[d].fingerprint == fingerprint(t, ws.SAMPLES)


def test_collisions_equal_weighted_similarity():
    """Over many sets of fresh terms the share of equal samples has no bias."""
    errors = []
    for i in range(200):
        x = Counter({f"{i}-{j}".encode(): 1 + j % 4 for j in range(12)})
        y = Counter({f"{i}-{j}".encode(): 1 + j * 7 % 5 for j in range(4, 16)})
        made = ws.Sampler()([b" ".join(c.elements()) for c in (x, y)])
        errors.append((made[0] == made[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.01


def test_bounded_sets_of_terms_change_nothing():
    texts = [b" ".join(b"%d" % (i * k % 997) for i in range(3000)) for k in (1, 2, 3)] + [b"", b"one"]
    assert (ws.Sampler(32, terms=64)(texts) == ws.Sampler(32)(texts)).all()
    assert (ws.Sampler(32)(texts)[1] == ws.Sampler(32)(texts[1:2])[0]).all()


def test_text_ids_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{i}", "some words here", "x") for i in range(5)] + [(None, None, "x")], "doc_id string, text string, range string")
    got = {r.doc_id: r for r in ws.neighbours(docs).collect()}
    assert set(got) == {None, *(f"d{i}" for i in range(5))}
    assert got["d0"].near_next == 1 and got["d4"].near_next == 0 and got[None].fingerprint == "0" * 512
    assert ws.neighbours(docs.limit(0)).collect() == []
    assert {r.fingerprint for r in ws.fingerprints(docs).collect()} == {r.fingerprint for r in got.values()}
    alone = ws.neighbours(docs.where("doc_id = 'd1'")).collect()
    assert [r.near_next for r in alone] == [1.0]
