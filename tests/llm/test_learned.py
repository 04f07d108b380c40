import math
from collections import Counter

import llm_plain as brute
import numpy as np

from gistline.llm import chat_repair, common, maxent_lm, nb_toxicity, url_model
from pyspark.sql import functions as F


def _lm(rows):
    """Plain base scores: (doc_id, held_out, n_tokens, n_known, train_tokens, base)."""
    docs = [(d, brute.crc(d) % 7 == 2, [*brute.WORD.findall(brute.lower(t)), None]) for d, t in rows]
    count = Counter(w for _, h, ws in docs if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for d, h, ws in docs]


def _near(got, want):
    got, want = (sorted(map(tuple, x), key=brute.key) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_language_model_of_documents(spark, sf_dir, documents):
    rows = maxent_lm.query(spark, sf_dir).collect()
    _near([r[:6] for r in rows], _lm(documents))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edge_cases(spark):
    docs = brute.edge_docs(spark)
    rows = maxent_lm.score(docs, common.crc_mod("doc_id", 7) == 2, steps=2).collect()
    _near([r[:6] for r in rows], _lm(brute.EDGE))
    assert maxent_lm.score(brute.edge_docs(spark, []), F.lit(False), steps=2).count() == 0
    alone = maxent_lm.score(brute.edge_docs(spark, [(1, "a b"), (2, None)]), F.lit(True), steps=2).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in alone)


def test_language_model_is_a_distribution():
    w = maxent_lm.Weights(32, 8, 64)
    rng = np.random.default_rng(1)
    w.inside[:], w.classes[:] = rng.normal(size=w.inside.shape), rng.normal(size=w.classes.shape)
    _, outer, inner = w.log_probabilities(5)
    whole = np.exp(np.repeat(outer, 8, axis=1) + inner.reshape(32, -1)).sum(axis=1)
    assert np.allclose(whole, 1, atol=1e-5)


def test_gradient_is_that_of_the_likelihood():
    w = maxent_lm.Weights(16, 4, 32)
    w.inside, w.classes = w.inside.astype(float), w.classes.astype(float)
    rng = np.random.default_rng(2)
    w.inside[:], w.classes[:] = rng.normal(size=w.inside.shape), rng.normal(size=w.classes.shape)
    counts = rng.integers(0, 4, (16, 16))
    f, outer, inner, value = w.gradient(3, counts)
    for table, g in ((w.classes, outer), (w.inside, inner)):
        full = np.zeros(table.shape)
        for k in range(4):
            np.add.at(full, f[:, k], g)
        at = np.unravel_index(np.argmax(np.abs(full)), full.shape)
        table[at] += 1e-5
        assert math.isclose((w.gradient(3, counts)[3] - value) / 1e-5, full[at], rel_tol=1e-3)
        table[at] -= 1e-5


def test_triples_are_summed_in_rounds(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(9).select(
        F.col("doc_id").alias("key"), F.lit(False).alias("held_out"), "text"
    )
    common.ship(spark)
    stored = common.stored(docs.mapInArrow(lambda b: maxent_lm.blocks(b, 16), maxent_lm.BLOCK_SQL), "kind")
    def total(rows):
        out = Counter()
        for r in rows.collect():
            out.update({(r.chunk, int(c)): int(n) for c, n in zip(np.frombuffer(r.cells, "<u4"), np.frombuffer(r.counts, "<i8"), strict=True)})
        return out
    once = maxent_lm.sum_triples(stored, 16)
    monkeypatch.setattr(maxent_lm, "FAN", 2)
    many = maxent_lm.sum_triples(stored, 16)
    assert once.groupBy("chunk").count().where("count > 1").isEmpty()
    assert total(once) == total(many) and sum(total(once).values()) > 10_000


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = nb_toxicity.query(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    judged = rows.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in judged)
    assert hit / len(judged) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.collect())
    assert all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) for r in rows.collect())


def test_toxicity_edge_cases(spark):
    toxic = [(100 + i, f"you utter nincompoop number {i}") for i in range(30)]
    clean = [(200 + i, f"a kind and friendly note number {i}") for i in range(60)]
    docs = brute.edge_docs(spark, [*brute.EDGE, *toxic, *clean])
    labels = spark.createDataFrame(
        [(d, 1, "x") for d, _ in toxic] + [(d, 0, "x") for d, _ in clean] + [(None, 1, "x"), (1, None, "x"), (101, 1, "x")], "doc_id long, toxic int, text string"
    )
    rows = nb_toxicity.score(docs, labels, common.crc_mod("doc_id", 5) == 0).collect()
    assert len(rows) == len(brute.EDGE) + 90
    by = {r.doc_id: r for r in rows}
    assert all(by[d].predicted == 1 for d, _ in toxic) and all(by[d].predicted == 0 for d, _ in clean)
    one_class = nb_toxicity.score(docs, labels.where("toxic = 0"), common.crc_mod("doc_id", 5) == 0).collect()
    assert {r.predicted for r in one_class} == {0}
    assert nb_toxicity.score(brute.edge_docs(spark, []), labels, F.lit(False)).count() == 0


def _judge_url(url):
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = brute.lower(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v, h + p) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = url_model.train(url_model.labelled(spark))
    odd = ["HTTP://A.Example.ORG/en/12?x", "http://org", "http://x.org/", "no scheme", None, "", "http://com/de/#", "x://y.com/fr/?", "http://myexample.org/es/",
           "http://a\nb.com/de/\nx", "http://" + "a" * 20_000 + ".net/" + "b" * 20_000, "://", "http://a.com/de"]
    extra = spark.createDataFrame([(1000 + i, u, "h") for i, u in enumerate(odd)], "page_id long, url string, host string")
    for table in (pages, extra, extra.limit(0)):
        rows = {r.page_id: r for r in url_model.judge(table, model, url_model.RULES, "page_id").collect()}
        urls = {r.page_id: r.url for r in table.collect()}
        assert rows.keys() == urls.keys()
        for i, u in urls.items():
            host, path, rule = _judge_url(u)
            assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule[1])
            assert rows[i].verdict == (rule[0] if rule else ("block" if rows[i].score >= 0.5 else "allow"))


def test_url_model_on_new_hosts(spark):
    model = url_model.train(url_model.labelled(spark))
    bad = ["https://spam-farm.example.net/en/728", "http://www.cheap-pills.example.net/en/450", "http://best-casino.net/x", "http://pokerbonus.net/"]
    good = ["http://ththre.example.net/en/825", "https://blog.ththan.example.net/en/960", "http://cityradio.net/about.html", "http://historyforum.net/a"]
    table = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_model.judge(table, model, [], "page_id").collect()}
    assert [found[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_url_query_has_no_python(spark, sf_dir):
    plan = url_model.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# chat ------------------------------------------------------------------------------------------


def _cheapest(turns, model):
    """The least cost of a conversation by plain dynamic programming over states."""
    cost = {0: 0}
    for role, text in turns:
        step, _ = model.turn(role, not text)
        cost = {q: min(c + int(step[p, q]) for p, c in cost.items()) for q in range(chat_repair.STATES)}
    return min(c + int(model.end[p]) for p, c in cost.items())


def _legal(text):
    import re

    state = 0
    for role in re.findall(r"<\|(system|user|assistant|tool)\|>\n", text):
        assert role in chat_repair.LEGAL[state], text
        state = 1 + chat_repair.ROLES.index(role)
    assert state in chat_repair.FINAL


def _conversations(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.block, r.place)):
        out.setdefault(r.conv_id, []).append(r)
    return out


CHATS = [
    [("user", "hi"), ("assistant", "hello")], [("user", "a"), ("user", "b"), ("assistant", "c")], [("assistant", "first")],
    [("system", "s"), ("system", "t"), ("user", "u")], [("user", "a"), ("assistant", "b"), ("tool", "r"), ("assistant", "c"), ("user", "d")],
    [("human", "who"), (None, "what")], [("user", None), ("user", ""), ("assistant", "x")], [("tool", "t")], [("user", "x" * 100_000)],
    [("assistant", "a"), ("assistant", "b"), ("system", "late"), ("user", "c")],
]


def test_chats(spark):
    rows = [(c, t, role, text, "x") for c, turns in enumerate(CHATS) for t, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "x"), (50, 0, "user", "a", "x"), (50, 0, "user", "a", "x"), (50, None, "system", "s", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    found = chat_repair.repair(table).collect()
    assert len(found) == len(rows)
    model, by = chat_repair.Automaton(), _conversations(found)
    for c, turns in enumerate(CHATS):
        _legal("".join(r.piece for r in by[c]))
        assert {r.cost for r in by[c]} == {_cheapest(turns, model)}
        for _, text in turns:
            assert not text or text in "".join(r.piece for r in by[c])
    assert "".join(r.piece for r in by[0]) == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert [r.action for r in by[1]] == ["keep", "merge", "keep"]
    assert [r.role for r in by[50]] == ["system", "user", "assistant"] and None in by
    assert chat_repair.repair(table.limit(0)).count() == 0


def test_a_long_conversation_is_cut_into_blocks(spark, monkeypatch):
    import random

    rng = random.Random(7)
    turns = [(rng.choice([*chat_repair.ROLES, "bot"]), rng.choice(["", "text"])) for _ in range(500)]
    table = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    found = chat_repair.repair(table, parts=6).collect()
    assert len({r.block for r in found}) > 3
    text = "".join(r.piece for r in sorted(found, key=lambda r: (r.block, r.place)))
    _legal(text)
    assert {r.cost for r in found} == {_cheapest(turns, chat_repair.Automaton())}
    paid = sum({"keep": 0, "relabel": chat_repair.CHANGE, "merge": 0}[r.action] + chat_repair.INSERT * r.n_inserted for r in found)
    assert paid <= found[0].cost


def test_chats_of_the_table(spark, sf_dir):
    rows = chat_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    source = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source.setdefault(r.conv_id, []).append((r.role, r.text))
    model = chat_repair.Automaton()
    for conv, own in _conversations(rows).items():
        _legal("".join(r.piece for r in own))
        assert own[0].cost == _cheapest(source[conv], model)
