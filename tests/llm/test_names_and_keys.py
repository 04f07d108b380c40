"""Extra columns of any name, keys of any type, and the bound on training rows."""

from collections import Counter

import llm_plain as brute
import numpy as np
import public_tokenizers
import pytest
from gistline.llm import chat_repair, common, ef_tokens, fss_dedup, leak_index, maxent_lm, nb_toxicity, quality_lines
from pyspark.sql import functions as F

NAMES = ["_id", "_host", "_key", "_kept", "_rid", "_clean_id", "_clean_key", "_clean_lines", "kept_id", "_kept_id", "kept_host", "kept_key",
         "hit_rid", "clean_id", "clean_host", "clean_key", "CLEAN_PLACES", "clean_lines", "removed_places", "doc", "label", "found"]


@pytest.mark.parametrize("stage", ["keep_lines", "clean", "dedup", "leaks"])
def test_columns_of_any_name_pass_through(spark, stage):
    own = [F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES]
    docs = brute.edge_docs(spark).select("doc_id", "text", "source", *own)
    items = spark.createDataFrame([("i", brute.B)], "item_id string, text string")
    run = {"keep_lines": lambda d: quality_lines.keep(d, min_docs=0), "clean": lambda d: quality_lines.clean(d, min_docs=0),
           "dedup": fss_dedup.keep, "leaks": lambda d: leak_index.keep(d, items)}[stage]
    got = run(docs)
    assert got.columns == docs.columns
    plain = run(docs.select("doc_id", "text", "source"))
    rows = got.collect()
    brute.same([(r.doc_id, r.text) for r in rows], [(r.doc_id, r.text) for r in plain.collect()])
    assert rows and all(r[n] == (None if r.doc_id is None else f"{n} of {r.doc_id}") for r in rows for n in NAMES)


def test_fresh_names_differ_from_all_columns(spark):
    df = spark.range(1).select(F.lit(1).alias("A"), F.lit(1).alias("_a"), F.lit(1).alias("b"))
    assert common.fresh(df, "a", "b", "c") == ["__a", "_b", "c"]


def _named(spark):
    return brute.edge_docs(spark).withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))


def test_text_keys_of_language_model_and_token_files(spark):
    docs = _named(spark)
    scored = maxent_lm.score(docs, F.lit(False), steps=2).collect()
    numbers = maxent_lm.score(brute.edge_docs(spark), F.lit(False), steps=2).collect()
    text = lambda d: None if d is None else f"doc {d}"
    brute.same([(r.doc_id, r.n_tokens, r.n_known) for r in scored], [(text(r.doc_id), r.n_tokens, r.n_known) for r in numbers])
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = ef_tokens.read(ef_tokens.write(docs, path, 2, parts=3, segment_ids=40)).collect()
    plain = ef_tokens.read(ef_tokens.write(brute.edge_docs(spark), path, 2, parts=3, segment_ids=40)).collect()
    brute.same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in coded], [(text(r.doc_id), r.n_tokens, r.ids_crc32) for r in plain])
    at = 0
    for r in sorted(coded, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in sorted(coded, key=lambda r: r.start)]
    assert names == sorted(names, key=lambda n: (n is not None, n))


def test_text_keys_of_conversations(spark):
    rows = [(f"conv-{i % 3}", f"t{i:03d}", ["user", "bot", "assistant"][i % 3 and i % 2 + 1], f"text {i}") for i in range(60)]
    rows.append((None, None, "user", "hello"))
    table = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")
    found = chat_repair.repair(table, parts=4).collect()
    brute.same([(r.conv_id, r.turn) for r in found], [(c, t) for c, t, _, _ in rows])
    number = spark.createDataFrame([(None if c is None else int(c[5:]), None if t is None else int(t[1:]), r, x) for c, t, r, x in rows],
                                   "conv_id long, turn long, role string, text string")
    want = Counter((r.role, r.action, r.n_inserted, r.piece, r.cost) for r in chat_repair.repair(number, parts=4).collect())
    assert Counter((r.role, r.action, r.n_inserted, r.piece, r.cost) for r in found) == want


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.range(2000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs)
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(nb_toxicity, "fit", lambda rows, **_: seen.append(rows.collect()) or nb_toxicity.Model(0.0, np.zeros(0, np.int64), np.zeros(0)))
    assert nb_toxicity.score(docs, labels, F.lit(False), max_rows=2).count() == 4000
    assert nb_toxicity.score(docs, labels, F.lit(False)).count() == 4000
    assert [len(s) for s in seen] == [2, 2000]
    assert len({r.text for r in seen[1]}) == 2000  # repeated rows train once


def test_toxicity_scores_again_by_plain_counts(spark):
    rows = [(1, f"vile nasty fool number {i}, you nastier thing") for i in range(20)] + [(0, f"kind gentle friend number {i} sends gifts") for i in range(40)]
    model = nb_toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"), keep=200, steps=50)
    assert len(model.weights) == 200
    texts = [*(t for _, t in rows[::7]), "", "nasty", "Nasty nastier NASTY fool", "une phrase étrangère"]
    got = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(True))
    for r in docs.mapInArrow(lambda b: nb_toxicity._scored(b, model), "doc_id long, held_out boolean, score double, predicted int").collect():
        got[r.doc_id] = r.score
    for i, text in enumerate(texts):
        held = Counter(g for w in set(nb_toxicity.WORD.findall(text.lower())) for g in nb_toxicity.grams(w))
        z = model.bias + sum(model.weights.get(g, 0.0) for g in held)
        z += sum(model.weights.get(g + nb_toxicity.TWICE, 0.0) for g, n in held.items() if n > 1)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
