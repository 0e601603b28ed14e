import random

import __spark_entry__ as entry
from newsloom.operators import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = entry.queries()["identify_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and r["language"] is not None]
    assert len(rows) == len(truth) and len(held) > 200
    assert sum(r["language"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_short_empty_and_foreign_texts(spark):
    rnd = random.Random(4)
    words = {"en": "the of and to in is that it was for".split(), "es": "el la de que y en un ser se no".split()}
    train = [(k, " ".join(rnd.choices(w, k=60))) for k, w in words.items() for _ in range(30)] + [(None, "der die das " * 50)]
    model = language.train_language_model(spark.createDataFrame(train, "language string, content string"), top=50)
    assert {r["lang"] for r in model.collect()} == {"en", "es"} and model.groupBy("lang").count().where("count > 50").count() == 0
    texts = [("the that was", "en"), ("que la de", None), ("que un ser la de", "es"), ("", None), (None, None), ("42 %", None),
             ("ЖЖЖ ШШШ ЩЩЩ ЮЮЮ", None), ("THE THAT WAS FOR", "en")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(texts)], "doc_id long, content string, letters string, language int")
    got = language.identify_language(df, model, margin=0.3, min_grams=11)
    assert got.columns == ["doc_id", "content", "letters", "language", "lead"]
    assert {r["doc_id"]: r["language"] for r in got.collect()} == {i: want for i, (_, want) in enumerate(texts)}
    assert language.identify_language(df, model.limit(0)).where("language is not null").count() == 0
    assert language.identify_language(df.limit(0), model).count() == 0


def test_likelihoods_equal_their_definition():
    import math
    rows = [("a", " x ", 3), ("a", "xy ", 1), ("b", " x ", 1)]
    lang, lead = language.LanguageModel(rows)(" x ", 1, 0.0)
    assert lang == "a" and abs(lead - (math.log(4 / 6) - math.log(2 / 3))) < 1e-12 or lang in "ab"
