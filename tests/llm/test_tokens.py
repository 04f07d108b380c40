import hashlib
import random
import zlib

import llm_plain as brute
import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers

from gistline.llm import ef_tokens, piece_bpe

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = tokenizers.Tokenizer.from_file(BYTES)


def random_texts(n):
    rng = random.Random(4)
    alphabet = "ab the  \n\t▁é😀 Ａ'<s|endoftext|>.,19\xa0　\r\x85"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [
        "a" * 5000, "ab" * 3000 + " " * 3000, "<|endoftext|> x", "x <|endoftext|>", " x", "x ", "\n \n x", "it's  we'll\n\n  x", "", " ", "  ",
    ]


def test_agenda_equals_the_library():
    texts = random_texts(6000)
    found = piece_bpe.encoder(PIECES).encode(texts)
    assert [x.tolist() for x in found] == [LIBRARY.encode(t) for t in texts]


def test_agenda_forgets_and_goes_on():
    model = piece_bpe.PieceBpe(PIECES, remembered=5)
    for t in random_texts(60):
        assert model.encode([t])[0].tolist() == LIBRARY.encode(t)


def test_check_finds_a_difference():
    model = piece_bpe.PieceBpe(PIECES)
    model.place.pop("▁that")
    try:
        model.check(["that"], model.encode(["that"]))
    except AssertionError:
        return
    raise AssertionError("a wrong encoding was not noticed")


def _pieces(rows):
    out = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(LIBRARY.decode(ids))))
    return out


def test_pieces_of_documents(spark, sf_dir, documents):
    brute.same(piece_bpe.query(spark, sf_dir).collect(), _pieces(documents))


def test_pieces_of_edge_cases(spark):
    brute.same(piece_bpe.encode_digests(brute.edge_docs(spark), PIECES).collect(), _pieces(brute.EDGE))
    assert piece_bpe.encode_digests(brute.edge_docs(spark, []), PIECES).count() == 0
    row = piece_bpe.encode(brute.edge_docs(spark, [(1, brute.A)]), PIECES).first()
    assert row.decoded == brute.A and np.frombuffer(row.ids, "<u4").tolist() == LIBRARY.encode(brute.A, add_bos=True, add_eos=True)


def test_parts_equal_the_whole_text():
    texts = random_texts(6000)
    found = ef_tokens.tokenizer(BYTES).encode(texts)
    assert [x.tolist() for x in found] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (
        [0], [0, 0, 0], [5], [0, 2**31], np.sort(rng.integers(0, 10**6, 5000)), np.arange(3000), np.repeat([3, 900], 200), np.sort(rng.integers(0, 9, 1000)),
    ):
        ef = ef_tokens.EliasFano.encode(np.array(values))
        assert ef.all().tolist() == list(values)
        assert [ef[i] for i in range(len(values))] == list(values)
        if len(values) == 5000:
            assert (len(ef.low) + len(ef.high)) * 8 < 5000 * (2 + np.log2(10**6 / 5000) + 1)
    assert ef_tokens.EliasFano.encode(np.array([], int)).all().tolist() == []


def _offsets(rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -len(r[1] or ""))):
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_offsets_of_documents(spark, sf_dir, documents):
    brute.same(ef_tokens.query(spark, sf_dir).collect(), _offsets(documents))


def test_offsets_over_many_segments(spark):
    rows = [r for r in brute.EDGE if r[0] is not None]
    files = ef_tokens.write(brute.edge_docs(spark, rows), BYTES, 2, parts=3, segment_ids=40)
    assert files.count() > 5
    brute.same(ef_tokens.read(files).collect(), _offsets(rows))


def test_offsets_of_null_ids_and_no_rows(spark):
    files = ef_tokens.write(brute.edge_docs(spark, [(None, "a"), (None, None), (3, "b")]), BYTES, 2)
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in ef_tokens.read(files).collect()))
    assert [r[1] for r in rows] == [None, None, 3] and rows[-1] == (3, 3, 2)
    assert ef_tokens.read(ef_tokens.write(brute.edge_docs(spark, []), BYTES, 2)).count() == 0


def test_select_reads_one_document(spark):
    row = ef_tokens.write(brute.edge_docs(spark, [(i, f"text number {i}") for i in range(200)]), BYTES, 2, parts=1).first().asDict()
    doc_ids, ef, ids = ef_tokens.open_segment(row)
    at = doc_ids.index(137)
    assert ids[ef[at] : ef[at + 1]].tolist() == [*TOKENIZER.encode("text number 137").ids, 2]


def test_short_and_long_agendas_agree():
    import random

    import public_tokenizers
    from gistline.llm import piece_bpe

    model, rng = piece_bpe.encoder(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    for _ in range(2000):
        part = "▁" + "".join(rng.choice("aeioustrnlé中x▁7") for _ in range(rng.randint(0, 40)))
        assert model.merged(part) == model.merged_long(part)


def test_few_remembered_parts_change_nothing(documents):
    """Parts leave the memory and come back, some with white space of other kinds."""
    import public_tokenizers
    from gistline.llm import ef_tokens, piece_bpe

    texts = [t or "" for _, t in documents[:120]] + ["a\n b", " lead", "x \ty z", "tail ", "é 中 😀 ﬁ ", "a  b", "   n m o", "", " "]
    bytewise = ef_tokens.PartTokenizer(public_tokenizers.path("byte_bpe_50k.json"), 300)
    pieces = piece_bpe.PieceBpe(public_tokenizers.path("piece_bpe_32k.model"), 300)
    assert bytewise.sizes is not None
    for _ in range(2):
        for i in range(0, len(texts), 10):
            some = texts[i : i + 10]
            assert [x.tolist() for x in bytewise.encode(some)] == [e.ids for e in bytewise.library.encode_batch(some, add_special_tokens=False)]
            assert [x.tolist() for x in pieces.encode(some)] == pieces.library.encode(some)
