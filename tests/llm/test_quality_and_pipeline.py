import re

import llm_plain as brute
import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from gistline.llm import fss_dedup, leak_index, pii_boost, quality_lines


def _base(text):
    text = text or ""
    words, seen, dup = brute.WORD.findall(text), set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(brute.WORD.search(line))
        seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def _line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def _judged(rows, min_docs=10, min_share=0.005, min_left=0.3):
    """(doc_id, counts, base_failed, kept) of (doc_id, source, text)."""
    texts, holders = {}, {}
    for d, s, t in rows:
        texts.setdefault(s, set()).add(t or "")
        for x in {_line(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((s, x), []).append((t or "", d))
    frequent = {}
    for (s, x), held in holders.items():
        n = len({t for t, _ in held})
        if n > min_docs and n > min_share * len(texts[s]):
            frequent[s, x] = min((d for _, d in held if d is not None), default=None)
    out = []
    for d, s, t in rows:
        counts = _base(t)
        lines = [_line(x) for x in (t or "").split("\n")]
        gone = sum(len(x.split(" ")) for x in lines if x and (s, x) in frequent and frequent[s, x] != d)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        out.append((d, *counts, failed, not failed and not (gone > 0 and counts[0] - gone < min_left * counts[0])))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    brute.same(quality_lines.query(spark, sf_dir).select(COLUMNS).collect(), _judged(rows))


def test_quality_edge_cases(spark):
    docs = brute.edge_docs(spark)
    rows = [(d, None if d is None else f"src{d % 2}", t) for d, t in brute.EDGE]
    brute.same(quality_lines.judge(docs, min_docs=0).select(COLUMNS).collect(), _judged(rows, min_docs=0))
    assert quality_lines.judge(brute.edge_docs(spark, [])).count() == 0


def test_depleted_documents_go_and_the_first_stays(spark):
    menu = [" ".join(w + c for c in "abcdefgh") for w in ("home", "news", "shop", "help")]
    rows = [(i, "h" + str(i % 2), "\n".join([*menu, f"own words {chr(97 + i % 26)}{chr(97 + i // 26)}"])) for i in range(60)]
    rows += [(100 + i, "h0", " ".join(f"{chr(97 + i)}{k}x" for k in "abcdefghijklmnop")) for i in range(20)]
    rows += [(200 + i, "h0", "\n".join(menu)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    brute.same(quality_lines.judge(docs).select(COLUMNS).collect(), _judged(rows))
    kept = {r.doc_id for r in quality_lines.keep(docs).collect()}
    assert kept == {0, 1, *range(100, 120)}


def _cleaned(rows, frequent, kept):
    """Texts of kept rows, frequent lines out of all but the first document that has them."""
    out = []
    for d, s, t in rows:
        if (d, s) in kept:
            lines = (t or "").split("\n")
            out.append((d, s, "\n".join(x for x in lines if (s, _line(x)) not in frequent or frequent[s, _line(x)] == d)))
    return out


def test_clean_takes_boilerplate_out_of_texts(spark):
    own = lambda i: "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + k)}{c}" for c in "abcdefgh") for k in range(2))
    rows = [(i, "h", f"Page {i}:  ALL rights\treserved\n{own(i)}\n\npage {i}0: all rights reserved\nlog in  \n") for i in range(12)]
    rows += [(20, "other", rows[0][2]), (21, "h", own(21)), (22, "h", "log in\nlog in\nlog in"), (23, "h", None), (None, None, own(23))]
    rows += [(i, "h", f"Log in\n{own(i)}") for i in (24, 25)]
    frequent = {("h", "page 0: all rights reserved"): 0, ("h", "log in"): 0}
    frequent |= {("h", "page 00: all rights reserved"): 0}  # digits of 10 and 11, and of the second mention
    n = {x: len({t for _, s, t in rows if s == "h" and x in map(_line, (t or "").split("\n"))}) for _, x in frequent}
    frequent = {k: v for k, v in frequent.items() if n[k[1]] > 10}
    assert len(frequent) >= 2
    docs = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, source string, text string, n_chars long")
    kept = {(r[0], s) for r, (_, s, _) in zip(_judged(rows), rows, strict=True) if r[-1]}
    got = quality_lines.clean(docs)
    want = _cleaned(rows, frequent, kept)
    assert got.columns == docs.columns and sum(t != dict((r[0], r[2]) for r in rows)[d] for d, _, t in want) >= 10
    brute.same(got.select("doc_id", "source", "text").collect(), want)
    staged = corpus_pipeline.quality(spark, docs, None).collect()
    brute.same([(r.doc_id, r.text, r.n_chars) for r in staged], [(d, t, len(t)) for d, _, t in want])


def test_boilerplate_of_a_hot_host_goes_whatever_its_share(spark):
    letters = F.translate(F.md5(F.col("doc_id").cast("string")), "0123456789", "ghijklmnop")
    own = F.regexp_replace(letters, "(...)", "$1 ")
    lead = F.when(F.col("doc_id") % 200 == 7, "All rights reserved\n").otherwise("")
    n, held = 210_000, 1_050
    docs = spark.range(n).select(F.col("id").alias("doc_id")).select(
        "doc_id", F.lit("hot").alias("source"), F.concat(lead, own).alias("text"), F.lit(0).cast("bigint").alias("n_chars"))
    assert docs.where("text like 'All%'").count() == held and held <= 0.005 * n
    left = corpus_pipeline.quality(spark, docs, None).where("text like 'All%'").select("doc_id").collect()
    assert [r.doc_id for r in left] == [7]
    assert quality_lines.judge(docs, many_docs=quality_lines.MANY_DOCS).where("removed_lines > 0").count() == held - 1
    # Without ``many_docs`` the share decides alone.
    assert quality_lines.judge(docs).where("removed_lines > 0").isEmpty()


def test_repeat_words_with_equal_codes(monkeypatch):
    docs = [brute.WORD.findall(t) for t in ("a b c d e f a b c d e", "x " * 30, "a b", "")]
    want = [_base(" ".join(d))[4] for d in docs]
    assert quality_lines.repeat_words(docs).tolist() == want
    monkeypatch.setattr(quality_lines.common, "mix", lambda x, seed=0: np.zeros_like(x))
    assert quality_lines.repeat_words(docs).tolist() == want


def test_pipeline(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r.doc_id, r.source, r.text) for r in source]
    good = {r[0] for r in _judged(rows) if r[-1]}
    rows = [(d, t) for d, _, t in rows if d in good]
    first = {d for d, _, c in brute.components(rows, 5) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, _, h, _ in brute.leaks(rows, items) if not h}
    rows = [(d, t) for d, t in rows if d in clean]
    assert len(good) < len(source) and len(first) < len(good) and len(clean) < len(first)
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model, want = pii_boost.detector(), []
    for d, t in rows:
        base = pii_boost.base_spans(t)
        t = pii_boost.redact_text(t, sorted(base + model.more_spans([t], [base])[0], key=pii_boost._order))
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), brute.sha(lib.decode(ids))))
    found = corpus_pipeline.run(spark, sf_dir)
    brute.same(found.select("doc_id", "n_tokens", "decoded_sha256").collect(), want)


def test_stages_on_no_rows_and_edge_rows(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    assert fss_dedup and leak_index
    for rows in ([], brute.EDGE):
        docs = brute.edge_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if i < 4:
                assert out.columns == docs.columns
            out.collect()
