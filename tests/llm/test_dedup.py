import random

import llm_plain as brute
import numpy as np

from gistline.llm import fss_dedup
from gistline.llm.graph import components


def _rows(found):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]


def _expected(rows, width):
    return brute.components(rows, width)


def test_components_of_documents(spark, sf_dir, documents):
    found = fss_dedup.query(spark, sf_dir)
    want = _expected(documents, 4)
    assert len({r[2] for r in want}) < len(want)
    brute.same(_rows(found), want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_edge_cases(spark):
    brute.same(_rows(fss_dedup.near_duplicates(brute.edge_docs(spark), width=4)), _expected(brute.EDGE, 4))
    assert fss_dedup.near_duplicates(brute.edge_docs(spark, [])).count() == 0
    alone = fss_dedup.near_duplicates(brute.edge_docs(spark, [(1, brute.A), (2, brute.B)])).collect()
    assert all(r.kept for r in alone)


def test_keep_returns_whole_rows(spark):
    docs = brute.edge_docs(spark)
    kept = fss_dedup.keep(docs, width=4)
    assert kept.columns == docs.columns
    want = [d for d, _, c in _expected(brute.EDGE, 4) if d == c]
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted((d is not None, d) for d in want)


def variants(n, edits, seed):
    """Near copies of one text, each edited at random: some pairs are linked, many are not."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 99999)}"
        out.append(" ".join(words))
    return out


def test_groups_of_edited_copies(spark):
    texts = variants(150, 6, 1) + variants(60, 9, 2) + variants(40, 12, 3)
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = _expected(rows, 4)
    assert 4 < len({r[2] for r in want}) < 140
    brute.same(_rows(fss_dedup.near_duplicates(docs, width=4)), want)
    # without any drawn hub, all that the first hub leaves open is compared in blocks
    brute.same(_rows(fss_dedup.near_duplicates(docs, width=4, draws=0)), want)


def test_a_lower_threshold_finds_its_own_links(spark):
    texts = [" ".join(f"{c}w{k}" if k < 60 else f"{c}{side}{k}" for k in range(end))
             for c in "abcdefghijklmnopqrst" for side, end in (("x", 70), ("y", 78))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 45):
        want = brute.components(rows, 4, percent)
        assert len({r[2] for r in want}) == 20
        brute.same(_rows(fss_dedup.near_duplicates(docs, width=4, percent=percent)), want)
    assert fss_dedup.plan(80) == (48, 6, 0.66)


def test_blocks_of_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(fss_dedup, "BLOCK", 8)
    rows = list(enumerate(variants(90, 8, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    brute.same(_rows(fss_dedup.near_duplicates(docs, width=4, draws=0)), _expected(rows, 4))


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 60, 3000):
        common = rng.integers(0, 2**63, max(1, size * 8 // 10)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, size - len(common)).astype(np.uint64)])) for _ in range(2))
        s = fss_dedup.sketch([a, np.zeros(0, np.uint64), b], 288)
        assert (s[0] != fss_dedup.EMPTY).all() and (s[2] != fss_dedup.EMPTY).all() and (s[1] == fss_dedup.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[2]).mean() - true) < 0.12
        alone = fss_dedup.sketch([b], 288)
        assert (alone[0] == s[2]).all()


def test_components_of_shapes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (202, 202)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), [200, 201]]
