import random

from newsloom.llm import substring
from tests.llm.conftest import DOCS, edge_texts, rows

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]


def brute(pairs, window):
    """Rows of one id are one document; a null id is later than every id."""
    starts = {}
    late = lambda i: (i is None, i or 0)
    docs = [(i, words_of(t)) for i, t in pairs]
    for i, w in docs:
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            starts[g] = min(starts.get(g, (late(i), s)), (late(i), s))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if starts[tuple(w[s:s + window])] < (late(i), s):
                gone[s:s + window] = [True] * window
        out.append((i or -1, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def got(df, window):
    return sorted((r["id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df, window).collect())


def test_edge_documents(edge_docs, no_docs):
    for window in (20, 5, 1):
        assert got(edge_docs, window) == brute(edge_texts(), window)
    assert got(no_docs, 20) == []


def test_many_chunks_and_extended_prefixes(spark, monkeypatch):
    rnd = random.Random(9)
    passages = [[f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(5, 60))] for _ in range(12)]
    pairs = []
    for i in range(200):
        w = []
        while len(w) < rnd.randint(1, 150):
            w += rnd.choice(passages) if rnd.random() < 0.4 else ["the"] * rnd.randint(1, 30) if rnd.random() < 0.2 else [f"v{rnd.randint(0, 50)}"] * 2
        pairs.append((rnd.randint(0, 150), " ".join(w)))
    df = spark.createDataFrame(rows(pairs), DOCS).repartition(4)
    df.write.mode("overwrite").parquet(path := scratch(spark))
    df = spark.read.parquet(path)
    monkeypatch.setattr(substring, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(substring, "PART_WORDS", 500)
    learnt = substring.learn_prefixes(df.selectExpr("doc_id id", "text t"), 10, 8)
    assert len(learnt[0]) and len(learnt[1])
    assert got(df, 10) == brute(pairs, 10)


def scratch(spark):
    from newsloom.session import scratch_path

    return scratch_path(spark, "substring-test")


def test_packed_numbers_come_back():
    import numpy as np

    for top in (0, 255, 256, 70000, 1 << 40):
        x = np.array([0, 1, top], np.int64)
        assert substring._unpack(substring._pack(x)).tolist() == x.tolist()
