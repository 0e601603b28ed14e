import random

from newsloom.llm import decontam
from tests.llm.conftest import DOCS, edge_texts, rows


def brute(items, words, window=10):
    hit, found = [False] * len(words), set()
    for i, w in items:
        k = min(window, len(w))
        grams = {tuple(w[s:s + k]) for s in range(len(w) - k + 1)} if k else ()
        for s in range(len(words) - k + 1) if k else ():
            if tuple(words[s:s + k]) in grams:
                found.add(i)
                hit[s:s + k] = [True] * k
    return hit, found


def test_automaton_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        letters = [b"a", b"b", b"c"]
        items = [(str(i), [rnd.choice(letters) for _ in range(rnd.randint(0, 9))]) for i in range(rnd.randint(0, 5))]
        words = [rnd.choice([*letters, b"z"]) for _ in range(rnd.randint(0, 25))]
        window = rnd.choice([2, 3, 4, 5])
        spans, found = decontam.SuffixAutomaton(items, window).scan(words)
        hit = [False] * len(words)
        for a, b in spans:
            hit[a:b] = [True] * (b - a)
        assert (hit, found) == brute(items, words, window)


def items_of(spark):
    texts = dict(edge_texts())
    pairs = [("a", texts[14]), ("b", texts[13][200:900]), ("b", "one two"), (None, "emoji 中文"), ("c", None), ("d", "?!"), ("e", texts[17])]
    return pairs, spark.createDataFrame([(i, t, 1) for i, t in pairs], "item_id string, text string, n_words int")


def test_edge_documents_in_one_and_many_shards(spark, edge_docs, monkeypatch):
    pairs, items = items_of(spark)
    coded = [(i, decontam.item_words(t)) for i, t in pairs]
    want = []
    for i, t in edge_texts():
        words = decontam.item_words(t)
        hit, found = brute(coded, words)
        want.append((i or -1, len(words), sum(hit), sorted(x for x in found if x)))
    for shard in (100_000, 60):
        monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
        got = [(r["id"] or -1, r["n_words"], sum(r["hits"][1::2]) - sum(r["hits"][::2]), r["items"])
               for r in decontam.contamination(edge_docs, items).collect()]
        assert sorted(got) == sorted(want)


def test_spans_are_cut_and_mostly_hit_documents_go(spark, edge_docs, no_docs):
    _, items = items_of(spark)
    kept = decontam.remove_contamination(edge_docs, items)
    assert kept.columns == edge_docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert not {14, 15, 17, 5} & set(texts) and texts[7] is None and texts[12] == "x" * 70000
    assert texts[2] == "😀 text" and len(texts[13]) < len(dict(edge_texts())[13])
    clean = dict(edge_texts())
    assert all(texts[i] == clean[i] for i in range(100, 140))
    assert decontam.remove_contamination(no_docs, items).count() == 0
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.remove_contamination(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_words_lower_case_ascii_only():
    assert [w.decode() for w in decontam.item_words("Ab-C É1_x y")] == ["ab", "c", "É1", "x y"]
    assert decontam.cut_words("Keep THE bad words, here", [(1, 4)]) == "Keep , here"


def test_extra_document_columns_do_not_matter(spark):
    df = spark.createDataFrame(rows([(1, "a b c")]), DOCS)
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    r = decontam.contamination(df, items).first()
    assert (r["n_words"], r["hits"], r["items"]) == (3, [1, 3], ["1"])


def test_shards_do_not_change_what_is_cut(spark, edge_docs, monkeypatch):
    """Limit and cut follow the hits of all shards: 30% by one item and 30% by another is over half."""
    word = lambda c, n, at=0: [f"{c}{k}" for k in range(at, at + n)]
    items = [(f"i{c}", " ".join(word(c, 40))) for c in "abcdefgh"]
    items += [(f"o{c}{at}", " ".join(word(c, 12, at))) for c in "pqrs" for at in (0, 6)]     # overlap in words 6..11
    texts = [(910 + k, " ".join(word(a, 30) + word("x", 40) + word(b, 30))) for k, (a, b) in enumerate(zip("abcdefg", "bcdefgh"))]
    texts += [(902 + k, " ".join(word("y", 80) + word(c, 18) + word("y", 40, 90))) for k, c in enumerate("pqrs")]
    docs = spark.createDataFrame(rows(texts), DOCS).unionByName(edge_docs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    results = []
    for shard in (100_000, 150, 40):
        monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
        kept = decontam.remove_contamination(docs, bench)
        assert kept.columns == docs.columns
        results.append(sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()))
    assert results[0] == results[1] == results[2]
    texts = dict(results[0])
    assert not set(range(910, 917)) & set(texts)
    assert all(texts[902 + k].split() == word("y", 80) + word("y", 40, 90) for k in range(4))
