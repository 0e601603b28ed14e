import random

import numpy as np
import pytest

from newsloom.llm import minhash, queries
from tests.llm.conftest import DOCS, SF, edge_texts, rows


def brute_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(docs, min_pct=85):
    """(id, set size, component) per row, by comparing all pairs of texts."""
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= min_pct * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= min_pct * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=key)


def key(r):
    return tuple((x is None, x) for x in r)


def got(df):
    return sorted(((r["id"], r["n_shingles"], r["component"]) for r in df.collect()), key=key)


def test_edge_documents(edge_docs, no_docs):
    assert got(minhash.minhash_groups(edge_docs)) == brute(edge_texts())
    assert minhash.minhash_groups(no_docs).count() == 0
    kept = minhash.keep_one_per_class(edge_docs).collect()
    assert all(r["kept"] == (r["id"] == r["component"]) for r in kept)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op12_minhash_neardup(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute(docs)


@pytest.mark.parametrize("per_salt", [3, 2000])
def test_chains_stars_and_near_misses(spark, monkeypatch, per_salt):
    """Copies of one text at all distances around the threshold: chains, unlinked members of one bucket, copies."""
    monkeypatch.setattr(minhash, "PAIRS_PER_SALT", per_salt)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    docs = []
    for size in (60, 200, 700):
        base = [rnd.choice(vocab) for _ in range(size)]
        chain = list(base)
        for _ in range(25):
            for p in rnd.sample(range(size), max(1, size // 100)):
                chain[p] = rnd.choice(vocab)
            docs.append(" ".join(chain))
        for share in (0.01, 0.02, 0.03, 0.05):
            for _ in range(12):
                copy = list(base)
                for p in rnd.sample(range(size), max(1, int(share * size))):
                    copy[p] = rnd.choice(vocab)
                docs.append(" ".join(copy))
                docs.append(" ".join(copy[: int(size * rnd.uniform(0.7, 1))]))
    pairs = list(enumerate(docs)) + [(1000 + i, rnd.choice(docs)) for i in range(60)]
    rnd.shuffle(pairs)
    df = spark.createDataFrame(rows(pairs), DOCS).repartition(4)
    assert got(minhash.minhash_groups(df)) == brute(pairs)


def test_parity_never_exceeds_the_difference():
    rnd = np.random.default_rng(1)
    for n in (5, 300, 5000):
        a = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 1 << 63, n // 2, np.uint64)]))
        unlike = int(np.bitwise_count(minhash.parity(a).view(np.uint64) ^ minhash.parity(b).view(np.uint64)).sum())
        assert unlike <= len(np.setxor1d(a, b))


def test_half_keys_do_not_depend_on_chunks(monkeypatch):
    s = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 900, np.uint64))
    whole = minhash.HalfKeys(4, 3)(s)
    monkeypatch.setattr(minhash, "_CHUNK", 7)
    assert (minhash.HalfKeys(4, 3)(s) == whole).all()
