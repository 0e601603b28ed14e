import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from newsloom.llm import decontam, pii, queries
from newsloom.llm.common import stored
from tests.llm.conftest import SF
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "pipeline-test")
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    before, after = map(text, seen["toxicity"])
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)

    before, after = map(text, seen["simhash near-dedup"])
    prints = [(i, brute_fingerprint(t)) for i, t in sorted(before.items())]
    assert set(after) == {i for (i, _), c in zip(prints, brute_groups(prints)) if i == c}

    before, after = map(text, seen["benchmark decontamination"])
    items = [(str(r["item_id"]), decontam.item_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontam.SuffixAutomaton(items, 10)
    for i, t in before.items():
        hits, _ = automaton.scan(decontam.item_words(t))
        if not hits:
            assert after[i] == t
        elif i in after:
            assert after[i] == decontam.cut_words(t, hits) != t
        else:
            assert sum(b - a for a, b in hits) > 0.5 * len(decontam.item_words(t))

    before, after = map(text, seen["pii"])
    assert after == {i: pii.mask_text(t) for i, t in before.items()}

    last = seen["sentencepiece"][1].collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["token_ids"] for r in last} == {i: model.encode(t) for i, t in after.items()}
    assert all(r["round_trip"] and r["n_chars"] == len(after[r["doc_id"]]) for r in last)


def test_sql_of_the_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("op2_decontamination", "op4_substring_dedup"):
        query, sql = queries.REGISTRY[name]
        df = query(spark, SF)
        cur = con.execute(sql)
        order = [df.columns.index(d[0]) for d in cur.description]
        assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(cur.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.REGISTRY} == {f"op{i}" for i in range(1, 14)}
