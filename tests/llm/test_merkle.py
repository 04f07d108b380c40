"""Merkle manifest against plain loops and against its SQL twin."""

import hashlib

import duckdb
import pytest
from llm_plain import EDGE, crc, edge_docs, key, lower
from pyspark.sql import functions as F

from gistline.llm import common, merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root and, per node, its siblings level by level."""
    proofs, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for n, at in enumerate(where):
            run, own = runs[at // 16], at % 16
            proofs[n].append((run[:own], run[own + 1 :]))
        where, level = [at // 16 for at in where], [h(*r) for r in runs]
    return level[0], proofs


def plain(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        bent = None if r.text is None else lower(r.text)
        tampered = leaf(r, bent) if crc(r.doc_id) % 5 == 0 else None
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), tampered, r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        made[s] = tree([x[2] for x in groups[s]])
    root, tops = tree([made[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for x, proof in zip(groups[s], made[s][1], strict=True):
            path, node = proof + tops[i], x[3] or x[2]
            for left, right in path:
                node = h(*left, node, *right)
            flat = "".join("".join(a) + "".join(b) for a, b in path)
            out.append((x[4].doc_id, x[2], made[s][0], root, h(flat), node, node == root))
    return out


@pytest.fixture
def run(spark, monkeypatch):
    def run(docs):
        monkeypatch.setattr(common, "table", lambda *_: docs)
        rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
        return sorted(map(tuple, merkle_manifest.query(spark, "").collect()), key=key), sorted(plain(rows), key=key)

    return run


def test_edge_rows(spark, run):
    got, want = run(edge_docs(spark, [*EDGE, (None, "Upper"), (40, "TAMPERED"), (45, "Tampered"), (50, "as it was")]))
    assert got == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_sizes_of_a_group(spark, run, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(None).cast("string").alias("lang"),
                                 F.lit(3).alias("n_chars"), F.concat(F.lit("Ab"), "id").alias("text"))
    got, want = run(docs)
    assert got == want


def test_three_rounds_and_many_groups(spark, run):
    """70,000 rows of one group take three rounds; 300 groups more, so that the roots take two."""
    one = spark.range(0, 70_000, 1, 8).select("id", F.lit("hot").alias("source"))
    more = spark.range(100_000, 100_300).select("id", F.concat(F.lit("s"), "id").alias("source"))
    docs = one.unionByName(more).select(F.col("id").alias("doc_id"), "source", F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
                                        F.lit("T").alias("text"))
    got, want = run(docs)
    assert got == want


def test_empty_table_and_text_ids(spark, run):
    schema = "doc_id string, source string, lang string, n_chars long, text string, g string, pos long, path string"
    assert run(spark.createDataFrame([], schema)) == ([], [])
    docs = spark.createDataFrame([(f"d{i}", None, "en", 1, "A", "g", 0, "p") for i in range(40)], schema)
    got = merkle_manifest.manifest(docs, merkle_manifest.leaf([F.col("doc_id"), F.col("text")])).collect()
    root, proofs = tree([h(f"{len(d)}:{d}", "1:A") for d in sorted(f"d{i}" for i in range(40))])
    assert {r.root for r in got} == {root} and len(got) == 40
    for r in got:
        assert [(p.left, p.right) for p in r.path] == [("".join(a), "".join(b)) for a, b in proofs[sorted(f"d{i}" for i in range(40)).index(r.doc_id)]]


def test_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(merkle_manifest.ORACLE).fetchall()
    got = merkle_manifest.query(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.where("not verified").count() > 0
