import hashlib
import random

from newsloom.llm import merkle, queries
from tests.llm.conftest import DOCS, SF, edge_texts, rows


def brute_report(pairs):
    """(id, n_chars, edited_sha256, near_edited, near_next) by a plain sort."""
    order = sorted(((i, t or "") for i, t in pairs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), merkle.encode(merkle.tree(t)),
                    merkle.encode(merkle.tree(edited)), merkle.likeness(merkle.tree(t), merkle.tree(edited)),
                    merkle.likeness(merkle.tree(t), merkle.tree(after))))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_edge_documents(spark, edge_docs, no_docs, monkeypatch):
    want = sorted(brute_report(edge_texts()), key=key)
    assert sorted(map(tuple, merkle.neighbour_report(edge_docs).collect()), key=key) == want
    monkeypatch.setattr(merkle, "CHUNK_CHARS", 500)
    assert sorted(map(tuple, merkle.neighbour_report(edge_docs).collect()), key=key) == want
    assert merkle.neighbour_report(no_docs).count() == 0
    one = spark.createDataFrame(rows([(4, "alone here")]), DOCS)
    assert [tuple(r) for r in merkle.neighbour_report(one).collect()] == brute_report([(4, "alone here")])


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op3_merkle_fingerprints(spark, SF).collect())
    assert got == sorted(brute_report([(r["doc_id"], r["text"]) for r in docs]))


def test_equal_roots_only_for_equal_texts():
    rnd = random.Random(3)
    text = "\n".join(" ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 8))) for _ in range(rnd.randint(0, 60))) for _ in range(30))
    t = merkle.tree(text)
    assert merkle.tree(text) == t and merkle.parse(merkle.encode(t)) == t
    for at in rnd.sample(range(len(text)), 40):
        other = text[:at] + "#" + text[at + 1:]
        u = merkle.tree(other)
        assert u[0] != t[0]
        assert any(a <= at < b for a, b in merkle.edited_spans(t, u))
        assert 0.8 < merkle.likeness(t, u) < 1.0
        inserted = merkle.tree(text[:at] + "some words " + text[at:])
        assert merkle.likeness(t, inserted) > 0.8


def test_likeness_of_the_empty_text():
    assert merkle.likeness(merkle.tree(""), merkle.tree(None)) == 1.0
    assert merkle.likeness(merkle.tree(""), merkle.tree("abc")) == 0.0


def test_document_fingerprints(edge_docs):
    got = sorted((tuple(r) for r in merkle.document_fingerprints(edge_docs).collect()), key=key)
    assert got == sorted(((i, len(t or ""), merkle.encode(merkle.tree(t))) for i, t in edge_texts()), key=key)
