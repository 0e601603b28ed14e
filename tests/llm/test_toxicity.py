import random
import time
import zlib

from pyspark.sql import functions as F

from newsloom.llm import queries, toxicity
from tests.llm.conftest import edge_texts


def corpus(spark, n=900):
    """Documents of invented words; label 1 exactly where one of three marker words stands."""
    rnd = random.Random(6)
    syllables = "ba de ki lo mu na po ri sa te vu ze".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["grompf", "idiot", "trashy"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000 + i, t) for i, t in edge_texts()[:4] for i in [i or 0]]
    docs += [(6000, "a gr0mpf"), (6001, "you 1d10t"), (6002, "i d i o t"), (6003, "idiooooot"), (6004, "tr@shy n0te")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_rows_and_disguises(spark):
    docs, labels = corpus(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id is not null and toxic is not null").collect()}
    score = {r["id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels, ~F.expr(queries.HELD_OUT)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200
    wrong = [i for i in held if (score[i] >= 0.7) != (truth[i] == 1)]
    assert len(wrong) <= len(held) // 50
    assert all(score[i] >= 0.7 for i in range(6000, 6005))
    assert all(0.0 <= s <= 1.0 for s in score.values()) and score[5003] < 0.7
    kept = toxicity.remove_toxic(docs, labels, ~F.expr(queries.HELD_OUT))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s < 0.7}


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 20)
    none = toxicity.toxicity_scores(docs, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] < 1e-6 for r in none} == {True}
    assert toxicity.toxicity_scores(docs.limit(0), labels, F.lit(True)).count() == 0


def test_only_true_copies_of_one_label_count_once(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    apart = [(" ".join(["of", "the", *text(60), "it", "is", "of", "the"]), k % 2) for k in range(300)]     # share common pairs
    base = text(100)
    near = [(" ".join([*base[:40], f"x{k}", *base[41:]]), 1) for k in range(20)]
    long = text(3000)
    rows = [*apart, *near, (" ".join(near[0][0].split()[:50] + text(50)), 1), (" ".join(base), 0), (apart[0][0], 1), *[apart[1]] * 30,
            (" ".join(long), 1), (" ".join([*long[:1500], "y", *long[1501:]]), 1), (" ".join(long[:1500] + text(1500)), 1),
            (None, 0), (None, 0), ("", 1), ("one", 1), ("One", 1)]
    kept = [(r["t"], r["y"]) for r in toxicity._one_per_copy(spark.createDataFrame(rows, "t string, y int").repartition(5)).collect()]
    assert len(set(kept)) == len(kept) and set(kept) <= set(rows)

    def pairs(t):
        words = (t or "").lower().split()
        return set(zip(words, words[1:])) or {tuple(words)}

    for t, y in set(rows) - set(kept):
        assert any(len(pairs(t) & pairs(x)) >= 0.8 * len(pairs(t) | pairs(x)) for x, z in kept if z == y)
    assert set(apart) <= set(kept) and (apart[0][0], 1) in kept and (" ".join(base), 0) in kept
    assert len(set(near) & set(kept)) == 1 and len(kept) == len(set(apart)) + 1 + 1 + 1 + 1 + 2 + 1 + 1 + 1


def test_restoration_is_the_best_path():
    """Viterbi equals the cheapest of all readings."""
    from itertools import product

    model = toxicity.CharModel({g: n for w, n in [("  idiot ", 9), ("  the ", 50), ("  dot ", 5), ("  odd ", 3)]
                                for g in [w[i:i + 3] for i in range(len(w) - 2)]})

    def cost(word):
        w = "  " + "".join(map(toxicity._class, word)) + " "
        return sum(model.cost(*w[i:i + 3]) for i in range(len(w) - 2))

    for token in ("1d10t", "d0t", "t4e", "0d"):
        options = [[(x, toxicity.LEET_COST) for x in toxicity.LEET.get(c, "")] + [(c, toxicity.KEEP_COST if c in toxicity.LEET else 0.0)] for c in token]
        best = min(product(*options), key=lambda p: sum(c for _, c in p) + cost("".join(x for x, _ in p)))
        assert toxicity.restore(token, model) == "".join(x for x, _ in best)


def test_query_marks_held_out_rows(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_repeats_take_linear_time():
    took = []
    for n in (200_000, 400_000):
        token, best = "aaa1" + "ab" * n, 9e9
        for _ in range(3):
            start = time.process_time()
            assert [w for w in toxicity._WORD.findall(token) if toxicity._TRIPLE(w)] == ["aaa"]
            best = min(best, time.process_time() - start)
        took.append(best)
    assert took[1] <= 2.5 * took[0] + 0.05
