"""Round trips of the sinks, streams against their batch twin, and the term operators."""

from pyspark.sql import functions as F

from newsloom.operators import digest, embed, terms
from newsloom.session import scratch_path
from newsloom.sources import files
from newsloom.streaming import streams


def test_csv_round_trip_with_separators_quotes_newlines(spark):
    rows = [(1, "S", "u", 'T "quoted"', 'line one;\nline "two"\n', None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, url string, title string, content string, scraping_date timestamp")
    path = scratch_path(spark, "csv")
    files.write_articles_csv(df, path)
    back = files.read_articles_csv(spark, path, "doc_id long, source string, url string, title string, content string, "
                                                "scraping_date timestamp").first()
    assert back.content == 'line one;\nline "two"\n' and back.title == 'T "quoted"'


def test_missing_parquet_is_empty(spark):
    assert files.read_articles_parquet(spark, scratch_path(spark, "nothing")).count() == 0


def test_ledger_versions(spark):
    root = scratch_path(spark, "ledger")
    assert files.load_processed_urls(spark, root).count() == 0
    files.append_processed_urls(spark, root, spark.createDataFrame([("a",), ("b",)], "url string"), "1")
    files.append_processed_urls(spark, root, spark.createDataFrame([("b",), ("c",)], "url string"), "2")
    assert sorted(r.url for r in files.load_processed_urls(spark, root).collect()) == ["a", "b", "c"]


def test_stream_dedupe_and_weekly_twin(spark):
    rows = [(i, f"u{i % 7}", "view" if i % 2 else "thumb_up", f"2024-01-{1 + i % 28:02d} 07:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, url string, rating string, ts string").withColumn("ts", F.to_timestamp("ts"))
    land = scratch_path(spark, "land")
    df.repartitionByRange(3, "ts").write.parquet(land)
    s = spark.readStream.schema(streams.FEEDBACK_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(land)
    out, ck = scratch_path(spark, "o"), scratch_path(spark, "ck")
    streams.run_to_table(streams.stream_url_dedupe(s, "ts", "60 days"), out, ck)
    assert spark.read.parquet(out).select("url").distinct().count() == spark.read.parquet(out).count() == 7
    out2, ck2 = scratch_path(spark, "o2"), scratch_path(spark, "ck2")
    streams.run_to_table(streams.stream_feedback_counts(s, delay="60 days"), out2, ck2, output_mode="update")
    got = spark.read.parquet(out2).groupBy("week", "rating").agg(F.max_by("n", "batch_id").alias("n"))
    want = streams.weekly_windows(df)
    assert sorted(map(tuple, got.select(F.col("week.start"), "rating", "n").collect())) == \
        sorted(map(tuple, want.select(F.col("week.start"), "rating", "n").collect()))
    # windows start on Monday 06:00
    assert {r.d for r in want.select(F.date_format("week.start", "E HH:mm").alias("d")).collect()} == {"Mon 06:00"}


def test_name_clusters_docstring_example(spark):
    top = spark.createDataFrame([(0, 1, "machine"), (0, 2, "learning"), (0, 3, "algorithm"), (0, 4, "extra")],
                                "cluster int, rank int, term string")
    assert terms.name_clusters(top).first().cluster_name == "Machine / Learning / Algorithm"


def test_tfidf_matches_smooth_idf_definition(spark):
    docs = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (2, 0, ["a", "c"]), (3, 1, ["b", "c"])],
                                 "doc_id long, cluster int, terms array<string>")
    w = {(r.doc_id, r.term): r.weight for r in terms.tfidf(docs, min_df=1, max_df=1.0).collect()}
    import math
    idf = {t: math.log(4 / (1 + df)) + 1 for t, df in {"a": 2, "b": 2, "c": 2}.items()}
    raw = {"a": 2 * idf["a"], "b": idf["b"]}
    n = math.sqrt(sum(x * x for x in raw.values()))
    assert abs(w[(1, "a")] - raw["a"] / n) < 1e-12


def test_stop_word_cleaning_and_language(spark):
    df = spark.createDataFrame([(1, "The cat and the dog", "en"), (2, "el gato y el perro", "es"), (3, "le chat est dans la maison", "fr")],
                               "doc_id long, content string, language string")
    got = {r.doc_id: r.text_tfidf for r in terms.clean_for_tfidf(df).collect()}
    assert got == {1: "cat dog", 2: "gato perro", 3: ""}
    lang = {r.doc_id: r.language for r in embed.detect_language(df.drop("language")).collect()}
    assert lang[1] == "en" and lang[2] == "es" and lang[3] == "fr"


def test_unknown_encoder_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, "x")], "doc_id long, text_for_embedding string")
    with pytest.raises(ValueError):
        embed.embed_text(df, "no-such-model")
    v = embed.embed_text(df, "hashing").first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_digest_area_escapes_on_request(spark):
    df = spark.createDataFrame([(1, "A", "<b>t</b>", "s", "u", 0.5)], "doc_id long, area string, title string, source string, url string, final_score double")
    raw = digest.digest_by_area(df).first().html
    esc = digest.digest_by_area(df, escape=True).first().html
    assert "<b>t</b>" in raw and "&lt;b&gt;t&lt;/b&gt;" in esc


def test_replayed_batch_is_idempotent(spark):
    from newsloom.sources import pages
    from newsloom.operators import embed as EM
    html = "<html lang=\"en\"><body><article><h1>Title</h1><p>" + " ".join(["word"] * 200) + "</p></article></body></html>"
    pg = spark.createDataFrame([(1, "https://a.example.com/1", html), (2, "https://a.example.com/2", html)],
                               "page_id long, url string, html string")
    cents = spark.createDataFrame([(0, [1.0] + [0.0] * 63)], "cluster int, centroid array<double>")
    out, ledger = scratch_path(spark, "ing"), scratch_path(spark, "led")
    args = (pages.source_rules(spark), cents, lambda d: EM.embed_text(d, "hashing"), "2024-04-01 00:00:00", out, ledger)
    streams.ingest_batch(pg, *args, version="000000")
    streams.ingest_batch(pg, *args, version="000000")  # replay of the same batch
    assert spark.read.parquet(out).count() == 2
    streams.ingest_batch(pg, *args, version="000001")  # next batch: both urls already seen
    assert spark.read.parquet(out).count() == 2
    assert files.load_processed_urls(spark, ledger).count() == 2


def test_ledger_survives_a_crash_between_writes(spark):
    import os
    root = scratch_path(spark, "ledger-crash")
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    files.append_processed_urls(spark, root, urls("a", "b"), "1")
    os.makedirs(f"{root.replace('file:', '', 1)}/batch=2/_temporary/0/task_1")   # a batch whose write died
    assert sorted(r.url for r in files.load_processed_urls(spark, root).collect()) == ["a", "b"]
    files.append_processed_urls(spark, root, urls("b", "c", "c"), "2")           # its replay
    files.append_processed_urls(spark, root, urls("b", "c"), "2")
    assert sorted(r.url for r in files.load_processed_urls(spark, root).collect()) == ["a", "b", "c"]
    assert sorted(r.url for r in files.ledger_before(spark, root, "2").collect()) == ["a", "b"]


def test_one_page_of_a_repeated_url_by_smallest_id(spark):
    from newsloom.operators import embed as EM
    from newsloom.sources import pages
    page = lambda i, t: (i, "https://a.example.com/1", f'<html lang="en"><h1>{t}</h1><p>' + " ".join(["word"] * 200) + "</p></html>")
    pg = spark.createDataFrame([page(9, "nine"), page(4, "four"), page(7, "seven")], "page_id long, url string, html string")
    cents = spark.createDataFrame([(0, [1.0] + [0.0] * 63)], "cluster int, centroid array<double>")
    out = scratch_path(spark, "ing")
    streams.ingest_batch(pg, pages.source_rules(spark), cents, lambda d: EM.embed_text(d, "hashing"), "2024-04-01 00:00:00", out,
                         scratch_path(spark, "led"), version="1")
    assert [(r.page_id, r.title) for r in spark.read.parquet(out).collect()] == [(4, "four")]


def test_styled_area_digest(spark):
    rows = [(i, "A", f"t{i}", "s", f"u{i}", i / 100) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, area string, title string, source string, url string, final_score double")
    html = digest.digest_by_area(df, top_n=10, styled=True).first().html
    assert html.startswith("\n    <style>") and "<h1>Newsletter – A</h1>" in html
    assert html.count("<li>") == 10 and html.index("t11") < html.index("t10") and "t1<" not in html


def test_weekly_counts_drop_rows_later_than_the_watermark(spark):
    import os
    import time as _t
    land = scratch_path(spark, "late")
    # late rows are judged against the previous batch's watermark (Spark's rule for chained stateful operators)
    batches = [[(1, "u", "view", "2024-03-05 10:00:00")] * 3,     # week of Mon 2024-03-04
               [(2, "u", "view", "2024-04-10 10:00:00")],          # watermark moves to 2024-04-03
               [(4, "u", "view", "2024-04-11 10:00:00")],          # (now in force for late events)
               [(3, "u", "view", "2024-03-06 10:00:00")] * 2]      # late: older than the watermark -> dropped
    for k, rows in enumerate(batches):
        d = spark.createDataFrame(rows, "event_id long, url string, rating string, ts string").withColumn("ts", F.to_timestamp("ts"))
        d.coalesce(1).write.mode("overwrite").parquet(f"{land}/f{k}")
        local = f"{land}/f{k}".replace("file:", "", 1)
        for f in os.listdir(local):  # pin the arrival order: the file source reads oldest first
            os.utime(f"{local}/{f}", (_t.time() - 100 + 10 * k, _t.time() - 100 + 10 * k))
    s = (spark.readStream.schema(streams.FEEDBACK_STREAM_SCHEMA).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", True).parquet(land))
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ck")
    streams.run_to_table(streams.stream_feedback_counts(s, delay="7 days"), out, ck, output_mode="update")
    got = spark.read.parquet(out).groupBy("week", "rating").agg(F.max_by("n", "batch_id").alias("n"))
    counts = {str(r.start)[:10]: r.n for r in got.select("week.start", "n").collect()}
    assert counts["2024-03-04"] == 3 and counts["2024-04-08"] == 2


def test_weekly_digest_orders_and_escapes(spark):
    rows = [(i, i % 2, f"T<{i}>", "S&P", "en", f"https://x/{i}", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, cluster int, title string, source string, language string, "
                                     "url string, final_score double")
    r = digest.digest_weekly(df, "20240401T0000Z", top_n=2).first()
    assert r.n_articles == 4 and "T&lt;7&gt;" in r.html and "S&amp;P" in r.html and "<7>" not in r.html
    order = [r.html.index(f"T&lt;{i}&gt;") for i in (7, 6, 5, 4)]
    assert order == sorted(order)  # overall score order, best first
    assert "Generado automáticamente el 20240401T0000Z" in r.html


def test_full_digest_orders_by_day_then_feed_order(spark):
    rows = [("S1", 1, 0, "b", "u1", "2024-03-30 01:00:00", "c1"), ("S0", 0, 5, "a", "u2", "2024-03-30 23:00:00", "c2"),
            ("S0", 0, 1, "z", "u3", "2024-03-31 00:00:00", "c3")]
    df = spark.createDataFrame(rows, "source string, feed_ord int, pos int, title string, url string, date string, "
                                     "full_content string").withColumn("date", F.to_timestamp("date"))
    html = digest.digest_full(df).first().html
    assert html.index("'u3'") < html.index("'u2'") < html.index("'u1'")  # newest day, then feed order in a day


def test_term_counts_are_made_once(spark, monkeypatch):
    """Weights and document frequencies read one count; null arrays, null terms and empty documents count nothing."""
    from newsloom.operators import terms

    rows = [(1, ["a", "b", "a", None]), (2, None), (3, []), (3, ["b"]), (None, ["a", "é", "é"]), (4, ["b", "b"])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>").coalesce(1)
    got = sorted((str(r.doc_id), r.term, r.tf) for r in terms.term_counts(docs).collect())
    assert got == sorted([("1", "a", 2), ("1", "b", 1), ("3", "b", 1), ("None", "a", 1), ("None", "é", 2), ("4", "b", 2)])
    plan = terms.tfidf(docs, min_df=1, max_df=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan           # both readers read the stored counts


def plain_tfidf(rows, min_df, max_df):
    """(doc_id, term) -> weight from the definition; rows of one id are one document for the norm."""
    import collections
    import math

    counts = [(d, collections.Counter(t for t in ts or [] if t is not None)) for d, ts in rows]
    df = collections.Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(rows)}
    w = [(d, t, n * idf[t]) for d, c in counts for t, n in c.items() if t in idf]
    norm = collections.defaultdict(float)
    for d, _, x in w:
        norm[d] += x * x
    return sorted((str(d), t, round(x / math.sqrt(norm[d]), 9)) for d, t, x in w)


def test_tfidf_shuffles_only_rare_terms(spark, monkeypatch):
    """Frequent terms by broadcast, rare and long ones by a shuffle join behind a bitmap: the same weights."""
    import random

    from newsloom.operators import terms

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["long" * 30, "é", ""]
    rows = [(i if i % 9 else None, [words[min(int(rnd.expovariate(0.1)), 42)] for _ in range(rnd.randrange(30))] + [f"once{i}", None])
            for i in range(60)]
    rows += [(1, ["w1", "long" * 30] * 3), (2, None), (3, [])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(3)
    want = plain_tfidf(rows, 3, 0.9)
    for hot_terms, hot_docs in ((1 << 18, 1 << 21), (5, 1 << 21), (5, 0), (1, 0)):
        monkeypatch.setattr(terms, "HOT_TERMS", hot_terms)
        monkeypatch.setattr(terms, "HOT_DOCS", hot_docs)
        got = terms.tfidf(docs, min_df=3)
        assert sorted((str(r.doc_id), r.term, round(r.weight, 9)) for r in got.collect()) == want
        if hot_docs:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_documents_are_stored_compressed(spark):
    import glob
    import os

    from newsloom.operators import terms

    docs = terms.materialize(spark.createDataFrame([(i, ["word"] * 4000) for i in range(50)], "doc_id long, tokens array<string>"))
    files = [f for p in docs.inputFiles() for f in glob.glob(p.removeprefix("file://"))]
    assert files and sum(map(os.path.getsize, files)) < 50 * 4000
    assert docs.count() == 50


def test_cluster_terms_shuffle_no_weights(spark):
    from newsloom.operators import terms

    rows = [(i % 7, f"t{i % 5}", float(i)) for i in range(40)] + [(None, "t1", 9.0)]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    clusters = spark.createDataFrame([(d, d % 2) for d in range(7)] + [(3, 0), (8, 1), (None, 1)], "doc_id long, cluster int")
    got = terms.term_scores(weights, clusters)
    want = {}
    for d, t, w in rows:
        for e, c in [(d, d % 2) for d in range(7)] + [(3, 0)]:
            if d == e:
                want[c, t] = want.get((c, t), 0.0) + w
    assert {(r.cluster, r.term): round(r.score, 9) for r in got.collect()} == {
        (c, t): round(s / (5 if c == 0 else 5), 9) for (c, t), s in want.items()}
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_batch_run_with_fixed_centroids_stores_texts_once(spark, tmp_dir, monkeypatch):
    from newsloom.plans import runs

    rows = [(i, "TechCrunch", f"u{i}", f"Title {i}", f"some words\nabout \"topic {i % 3}\"; more", "2024-03-30 01:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, url string, title string, content string, d string")
    df = df.withColumn("scraping_date", F.to_timestamp("d")).drop("d")
    cents = spark.createDataFrame([(0, [1.0] + [0.0] * 63), (1, [0.0] * 63 + [1.0])], "cluster int, centroid array<double>")
    names, stored = [], runs.stored
    monkeypatch.setattr(runs, "stored", lambda df, name: names.append(name) or stored(df, name))
    got = []
    for kind in ("none", "gzip"):
        files.write_articles_csv(df, f"{tmp_dir}/{kind}", compression=kind)
        out = runs.batch_run(spark, f"{tmp_dir}/{kind}", f"{tmp_dir}/out-{kind}", "2024-04-01 00:00:00", model="md5-64", centroids=cents)
        got.append(sorted((r.doc_id, r.content, r.cluster, round(r.final_score, 9)) for r in out.collect()))
    assert got[0] == got[1] and [r[1] for r in got[0]] == [r[4] for r in rows]
    assert names == ["batch-clusters", "batch-names"] * 2


def test_full_retrain_counts_the_vocabulary_once(spark, tmp_dir, monkeypatch):
    from newsloom.operators import terms
    from newsloom.plans import runs

    rows = [(i, runs.RETRAIN_SOURCES[i % 4], f"u{i}", f"Title {i}", f"word{i % 2} text common{i} again", "2024-03-30 01:00:00") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, source string, url string, title string, content string, d string")
    df = df.withColumn("scraping_date", F.to_timestamp("d")).drop("d")
    calls, doc_freq = [], terms.doc_freq
    monkeypatch.setattr(terms, "doc_freq", lambda *a, **k: calls.append(1) or doc_freq(*a, **k))
    runs.full_retrain(spark, df, f"{tmp_dir}/m", f"{tmp_dir}/c", "20240401", 2, 3, model="md5-64", top_terms=2)
    vocab = spark.read.parquet(f"{tmp_dir}/m/vocabulary/v=20240401")
    assert vocab.columns == ["term", "idf"] and {r.term for r in vocab.collect()} >= {"word0", "word1"}
    assert spark.read.parquet(f"{tmp_dir}/c").count() == 14 and len(calls) == 1
