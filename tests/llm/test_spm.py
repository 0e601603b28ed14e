import functools
import random

import public_tokenizers
import pytest
import sentencepiece

from newsloom.llm import spm
from tests.llm.conftest import edge_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return spm.PieceModel(PATH)


def states(matrices, start, end):
    """Boundary states by halving at any place: the product is associative."""
    if len(matrices) == 1:
        return [start, end]
    cut = random.Random(len(matrices)).randint(1, len(matrices) - 1)
    left, right = functools.reduce(spm.product, matrices[:cut]), functools.reduce(spm.product, matrices[cut:])
    at = spm.middle(left, right, start, end)
    return states(matrices[:cut], start, at) + states(matrices[cut:], at, end)[1:]


def by_chunks(model, text, size):
    parts = spm.cut(text, size, model.longest)
    matrices = [model.transfer(s, lo, hi, n == len(parts) - 1) for n, (s, lo, hi) in enumerate(parts)]
    state = states(matrices, (0, ""), (0, ""))
    return [i for n, (s, lo, hi) in enumerate(parts) for i in model.backtrace(s, lo, hi, n == len(parts) - 1, state[n], state[n + 1])]


def test_runs_of_spaces(model, library):
    for n in range(120):
        for text in (" " * n, "a" + " " * n + "thé é" + " " * n):
            assert model.encode(text) == library.encode(text)


def test_random_texts_whole_and_in_chunks(model, library):
    rnd = random.Random(3)
    parts = ["the", "ing", "er", " ", "  ", "a", "é", "ß", "\n", "中", "😀", "▁", "<s>", "x", "1", "22", "un", "tion", " of", "\t", "."]
    for k in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))
        if k % 3 == 0:
            text = text.replace(" ", "").replace("▁", "") or "a"
        want = library.encode(text)
        assert model.encode(text) == want
        assert model.decode(want) == library.decode(want)
        for size in (1, 3, 7, 20):
            assert by_chunks(model, text, size) == want


def test_a_long_word_in_chunks(model, library):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["the", "ing", "er", "a", "tion", "un", "é", "x"]) for _ in range(4000))
    assert by_chunks(model, text, 1000) == library.encode(text)


def test_edge_documents_and_round_trip(edge_docs, no_docs, library):
    for size in (spm.CHUNK_CHARS, 100):
        out = spm.decode_documents(spm.encode_documents(edge_docs, PATH, chunk_chars=size), PATH)
        assert out.columns == [*edge_docs.columns, "token_ids", "n_tokens", "decoded"]
        got = sorted(((r["doc_id"] or -1, r["text"] or "", r["token_ids"], r["n_tokens"], r["decoded"]) for r in out.collect()))
        want = sorted((i or -1, t or "", library.encode(t or ""), len(library.encode(t or "")), (t or "").replace("▁", " ")) for i, t in edge_texts())
        assert got == want
        checked = spm.encode_documents(edge_docs, PATH, chunk_chars=size, verify_col="same")
        assert checked.count() == len(want) and checked.where("same").count() == len(want)
    assert spm.encode_documents(no_docs.withColumnRenamed("part", "token_ids"), PATH).count() == 0


def test_pairwise_rounds_over_a_very_long_text(spark, library):
    """Eleven chunks without a space between: four rounds up and four down; and clashing column names."""
    rnd = random.Random(9)
    text = "".join(rnd.choice(["the", "ing", "er", "a", "tion", "un", "é", "x"]) for _ in range(400))
    df = spark.createDataFrame([(1, text, 777, 5), (2, "short one", 778, 6)], "doc_id long, text string, uid long, __uid long")
    out = spm.encode_documents(df, PATH, chunk_chars=len(text) // 10, verify_col="same").collect()
    assert {(r["doc_id"], r["uid"], r["__uid"], r["same"]) for r in out} == {(1, 777, 5, True), (2, 778, 6, True)}
    assert all(r["token_ids"] == library.encode(r["text"]) for r in out)
