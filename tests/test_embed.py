"""Encoders see slices of bounded size, whatever the size of a batch; several models share one pass."""

import numpy as np
import pytest

from newsloom.operators import embed


@pytest.fixture()
def models():
    def bounded():
        def encode(texts):
            assert len(texts) <= 512 and (len(texts) == 1 or sum(map(len, texts)) <= 1 << 18), "a slice is too large"
            return np.array([[len(t), 1.0] for t in texts])
        return encode

    held = dict(embed.ENCODERS)
    embed.register_encoder("bounded", bounded, 2)
    yield
    embed.ENCODERS.clear()
    embed.ENCODERS.update(held)


def test_a_model_sees_bounded_slices(spark, models):
    rows = [(i, None if i % 7 == 0 else "" if i % 11 == 0 else "w " * (200_000 if i == 5 else i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text_for_embedding string").coalesce(1)
    got = {r["doc_id"]: r["v"] for r in embed.embed_text(df, "bounded").select("doc_id", "v").collect()}
    for i, t in rows:
        n = len(t or "")
        assert got[i] == pytest.approx([n / np.hypot(n, 1), 1 / np.hypot(n, 1)])


def test_models_together_equal_models_apart(spark):
    rows = [(1, "Uno dos dos"), (2, None), (3, "..."), (4, "año ÀÉ x1_y 東京"), (4, "Uno dos dos"), (None, "last one")]
    df = spark.createDataFrame(rows, "doc_id long, text_for_embedding string").coalesce(1)
    names = ["md5-64", "hashing", "md5-96"]
    key = lambda r: (str(r["doc_id"]), r["model"], r["v"])
    got = sorted(map(key, embed.embed_models(df, names).collect()))
    one = [key({"doc_id": r["doc_id"], "model": m, "v": r["v"]}) for m in names for r in embed.embed_text(df, m).collect()]
    assert got == sorted(one) and len(got) == 18
