import random
import zlib

import public_tokenizers
import sentencepiece

from newsloom.llm import queries, tokencount
from tests.llm.conftest import DOCS, SF, edge_texts, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_edge_documents(edge_docs, no_docs, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in edge_texts())
    for hot in (3_000_000, 50, 1):          # most, some, none of the pre-tokens broadcast
        monkeypatch.setattr(tokencount, "HOT_PARTS", hot)
        got = sorted((r["id"] or -1, r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(edge_docs, PATH).collect())
        assert got == want
    assert tokencount.token_counts(no_docs, PATH).count() == 0


def test_pre_tokens_add_up():
    count, sp = tokencount.PieceCounter(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("", " ", "  ", " a", "a ", "a  ", "a  b", "  a b  c \n d", "x\n", "▁ ▁▁x", "<s> </s>"):
        assert sum(count(tokencount.pre_tokens(text))) == len(sp.encode(text)), text


def test_query_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(r["text"].encode()), n := len(sp.encode(r["text"])), n > 4096) for r in docs)
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(tuple(r[x] for x in names) for r in queries.op10_token_counts(spark, SF).collect()) == want


def test_texts_of_one_id_and_equal_checksums_are_told_apart(spark, monkeypatch):
    """Two texts with one CRC-32, null ids, long frequent pre-tokens and many copies."""
    first = "plumless"
    assert zlib.crc32(first.encode()) == zlib.crc32(b"buckeroo")
    pairs = [(1, first), (1, "buckeroo"), (None, "a b"), (None, "c"), (1, first)] + [(i, "") for i in range(50)]
    pairs += [(200 + i, "y" * 90 + " tail") for i in range(30)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((i or -1, len(t.encode()), len(library.encode(t))) for i, t in pairs)
    for parts in (1, 20, 10**6):
        monkeypatch.setattr(tokencount, "HOT_PARTS", parts)
        df = spark.createDataFrame(rows(pairs), DOCS).repartition(3)
        assert sorted((r["id"] or -1, r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(df, PATH).collect()) == want


def shuffled_mb(df):
    """MB that the shuffles of the collected ``df`` wrote."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        if kind == "ShuffleExchangeExec":
            total += p.metrics().get("shuffleBytesWritten").get().value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return total / 1e6


def test_rare_pre_tokens_are_shuffled_in_few_bytes(spark, monkeypatch):
    """With many partitions a partition holds about one rare word of a document, so what names the document counts."""
    monkeypatch.setattr(tokencount, "HOT_PARTS", 1)                # all words are rare
    rnd = random.Random(3)
    words = [f"{rnd.randrange(36**5):05d}" for _ in range(5000)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(3000)]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(4)
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = tokencount.token_counts(df, PATH)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    text_mb = sum(len(t) for _, t in texts) / 1e6
    assert 0 < shuffled_mb(found) < 3 * text_mb, (shuffled_mb(found), text_mb)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got == [(i, len(t.encode()), len(library.encode(t))) for i, t in texts]


def test_equal_rows_and_ids_of_other_types(spark):
    """Each of several equal rows is returned; ids may be strings, null or repeated."""
    pairs = [("a", "one two"), ("a", "one two"), ("a", "three  "), (None, "one two"), (None, "one two"), (None, None), ("b", "")]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((i or "", len((t or "").encode()), len(library.encode(t or ""))) for i, t in pairs)
    df = spark.createDataFrame(pairs, "doc_id string, text string").repartition(3)
    assert sorted((r["id"] or "", r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(df, PATH).collect()) == want
