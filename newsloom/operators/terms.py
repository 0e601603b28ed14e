"""Terms and cluster interpretation (section G): TF-IDF and top terms as SQL aggregates.

Plan shape for ``tfidf``: the cleaned tokens are stored once, compressed; terms are counted per document where it is
read, with no shuffle, and the counts are stored once for their readers; document frequencies are counted from those
(doc, term) rows by term (map-side combine absorbs hot terms) and the vocabulary is stored.  A (doc, term) row meets its
weight without a shuffle if the term is one of the ``HOT_TERMS`` most frequent; the other rows are shuffled by term, after
a bitmap of the vocabulary's hashes has dropped most of those outside it.  Norms and labels are one row a document: they
are broadcast up to ``HOT_DOCS`` rows, counted before, and joined by a shuffle beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stopwords import stop_words
from ..functions.text import title_case
from ..session import scratch_path

WORD_PATTERN = r"\p{L}+"
TERM_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
HOT_TERMS = 1 << 18     # vocabulary rows that are broadcast
HOT_LENGTH = 64         # letters of a term that may be broadcast
HOT_DOCS = 1 << 21      # rows of (document, number) that are broadcast
BITMAP_WORDS = 1 << 20  # longs of the bitmap at most
TIE_DIGITS = 12  # scores are compared at 12 decimals so summation order cannot flip ties


def clean_tokens(df: DataFrame, text_col: str = "content", lang_col: str = "language", out: str = "tokens",
                 languages=("en", "es"), lemmas: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """G1 as an array: lower-case alphabetic tokens without the row's language stop words; other languages -> [].

    Stop words are removed by ``StopWordsRemover`` (a JVM hash set per language), in one pass over the rows.
    ``lemmas`` (word, lemma) is an optional lookup applied per token (identity when absent).
    """
    tok = df.withColumn("_tok", F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0))
    if lemmas is not None:
        tok = _lemmatize(tok, lemmas, id_col)
    kept = F.array().cast("array<string>")
    for lang in languages:
        tok = StopWordsRemover(inputCol="_tok", outputCol=f"_sw_{lang}", stopWords=list(stop_words(lang)),
                               caseSensitive=True).transform(tok)
        kept = F.when(F.col(lang_col) == lang, F.col(f"_sw_{lang}")).otherwise(kept)
    return tok.withColumn(out, kept).drop("_tok", *[f"_sw_{lang}" for lang in languages])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once, compressed, below the shared checkpoint folder (reliable, lineage cut) and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(docs: DataFrame) -> DataFrame:
    """Documents feed several aggregates (term counts, N, cluster sizes): write them once to the shared checkpoint folder
    instead of cleaning per consumer.  Given tokens, the n-grams of which are made where they are read, this is a third
    of what the n-grams take."""
    return stored(docs, "term-documents")


def clean_for_tfidf(df: DataFrame, text_col: str = "content", lang_col: str = "language", out: str = "text_tfidf",
                    languages=("en", "es"), lemmas: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """G1: the cleaned tokens joined by spaces (a string, as the vectoriser's input)."""
    t = clean_tokens(df, text_col, lang_col, "_ct", languages, lemmas, id_col)
    return t.withColumn(out, F.array_join("_ct", " ")).drop("_ct")


def _lemmatize(tok: DataFrame, lemmas: DataFrame, id_col: str) -> DataFrame:
    ex = tok.select(id_col, F.posexplode("_tok").alias("_p", "_w"))
    lk = lemmas.select(F.col("word").alias("_w"), F.col("lemma").alias("_l"))
    j = ex.join(lk, "_w", "left").select(id_col, "_p", F.coalesce("_l", "_w").alias("_w"))
    back = j.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_p", "_w"))).alias("_pw"))
    back = back.select(id_col, F.transform("_pw", lambda s: s["_w"]).alias("_lt"))
    return tok.join(back, id_col, "left").withColumn("_tok", F.coalesce("_lt", F.array().cast("array<string>"))).drop("_lt")


def ngrams(df: DataFrame, text_col: str = "text_tfidf", out: str = "terms") -> DataFrame:
    """Unigrams then bigrams of the tokens of at least two word characters (MLlib ``NGram`` for the pairs)."""
    t = df.withColumn("_t1", F.regexp_extract_all(F.col(text_col), F.lit(TERM_TOKEN_PATTERN), 0))
    return _with_bigrams(t, out)


def token_ngrams(df: DataFrame, tokens_col: str = "tokens", out: str = "terms") -> DataFrame:
    """G2 straight from G1's token array: cleaned tokens are letter runs, so the vectoriser's tokens are exactly
    those of two or more characters -- no join-and-re-split of the text."""
    t = df.withColumn("_t1", F.filter(tokens_col, lambda w: F.length(w) >= 2))
    return _with_bigrams(t, out).drop(tokens_col)


def _with_bigrams(t: DataFrame, out: str) -> DataFrame:
    t = NGram(n=2, inputCol="_t1", outputCol="_t2").transform(t)
    return t.withColumn(out, F.concat("_t1", "_t2")).drop("_t1", "_t2")


def term_counts(docs: DataFrame, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
    """(doc_id, term, tf): raw term counts.  A row is a document with all its tokens, so it is counted where it is read:
    no (document, term) row is shuffled for it."""
    schema = T.StructType([docs.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = part.column(1)
                length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()         # without null arrays
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                size = max(1, len(coded.dictionary))
                pair = np.repeat(np.arange(len(lists), dtype=np.int64), length) * size + code
                pair, n = np.unique(pair[code >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(pair // size)), coded.dictionary.take(pa.array(pair % size)).cast(pa.string()),
                     pa.array(n.astype(np.int64))], [id_col, "term", "tf"])

    return docs.select(id_col, terms_col).mapInArrow(run, schema).where("term is not null")


def stored_counts(docs: DataFrame, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
    """``term_counts`` written once below the shared checkpoint folder: document frequencies and weights both read them."""
    return stored(term_counts(docs, id_col, terms_col), "term-counts")


def doc_freq(docs: DataFrame, id_col: str = "doc_id", terms_col: str = "terms", tf: DataFrame | None = None) -> DataFrame:
    """(term, df): number of documents containing each term -- counted from the (doc, term) counts, so the
    texts are tokenised once for both tf and df (the shared exchange is reused)."""
    tf = tf if tf is not None else term_counts(docs, id_col, terms_col)
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_freq_bounds(docs: DataFrame, min_df: int = 5, max_df: float = 0.9, id_col: str = "doc_id",
                    terms_col: str = "terms", tf: DataFrame | None = None) -> DataFrame:
    """Vocabulary (term, df, n_docs) with df >= min_df and df <= max_df * N."""
    n = docs.select(F.count(F.lit(1))).scalar()
    d = doc_freq(docs, id_col, terms_col, tf).withColumn("n_docs", n)
    return d.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))


def idf_table(docs: DataFrame, min_df: int = 5, max_df: float = 0.9, id_col: str = "doc_id", terms_col: str = "terms",
              tf: DataFrame | None = None) -> DataFrame:
    """The vocabulary with its weights: (term, idf), idf = ln((1+N)/(1+df)) + 1."""
    return _idf(doc_freq_bounds(docs, min_df, max_df, id_col, terms_col, tf)).select("term", "idf")


def _idf(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("idf", F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def stored_vocabulary(docs: DataFrame, min_df: int = 5, max_df: float = 0.9, id_col: str = "doc_id", terms_col: str = "terms",
                      tf: DataFrame | None = None) -> DataFrame:
    """(term, idf, df), stored: the terms are counted once for all that read the vocabulary."""
    return stored(_idf(doc_freq_bounds(docs, min_df, max_df, id_col, terms_col, tf)).select("term", "idf", "df"), "vocabulary")


def weighted(tf: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, w) with w = tf * idf of the vocabulary's terms: an equi-join on the term."""
    n = vocab.count()
    weight = (F.col("tf") * F.col("idf")).alias("w")
    short = F.length("term") <= HOT_LENGTH
    if n <= HOT_TERMS:
        hot, cold = vocab.where(short), vocab.where(~short)
    else:                                                       # the threshold only balances: any gives the same rows
        least = vocab.select(F.percentile_approx("df", 1 - HOT_TERMS / n, 10000)).scalar()
        hot, cold = vocab.where(short & (F.col("df") > least)), vocab.where(~(short & (F.col("df") > least)))
    direct = tf.join(F.broadcast(hot.select("term", "idf")), "term").select(id_col, "term", weight)
    if n <= HOT_TERMS and not cold.limit(1).count():
        return direct
    rest = tf.join(F.broadcast(hot.select("term")), "term", "left_anti").where(_may_hold(cold, n))
    rest = rest.join(cold.hint("shuffle_merge").select("term", "idf"), "term").select(id_col, "term", weight)
    return direct.unionByName(stored(rest, "term-rest"))         # norms and weights read them: one shuffle


def _may_hold(vocab: DataFrame, n: int):
    """Whether the vocabulary may hold ``term``: a bitmap of its hashes, in one value of at most BITMAP_WORDS longs."""
    words = min(BITMAP_WORDS, 1 << max(4, math.ceil(math.log2(max(1, n) / 4))))       # 16 bits a term

    def word(c):
        return F.pmod(F.xxhash64(c), F.lit(words * 64))

    bits = vocab.select(F.floor(word("term") / 64).cast("int").alias("i"), F.expr("1L").alias("one"), (word("term") % 64).cast("int").alias("b"))
    bits = bits.select("i", F.expr("shiftleft(one, b)").alias("x"))
    every = vocab.sparkSession.range(words).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("x"))
    bitmap = bits.unionByName(every).groupBy("i").agg(F.bit_or("x").alias("x"))
    bitmap = bitmap.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m")).scalar()
    at = word("term")
    return F.getbit(F.get(bitmap, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1


def by_document(rows: DataFrame, table: DataFrame, id_col: str = "doc_id", how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (a row a document, slim): broadcast if it has at most HOT_DOCS rows."""
    return rows.join(F.broadcast(table) if table.limit(HOT_DOCS + 1).count() <= HOT_DOCS else table, id_col, how)


def tfidf(docs: DataFrame, min_df: int = 5, max_df: float = 0.9, id_col: str = "doc_id",
          terms_col: str = "terms", tf: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight) with weight = tf * (ln((1+N)/(1+df)) + 1), L2-normalised per document.

    Not ``pyspark.ml.feature.IDF`` (it lacks the +1).
    """
    tf = tf if tf is not None else stored_counts(docs, id_col, terms_col)
    vocab = vocab if vocab is not None else stored_vocabulary(docs, min_df, max_df, id_col, terms_col, tf)
    w = weighted(tf, vocab, id_col)
    # a document's counts lie together: one partial sum each
    norms = stored(w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")), "term-norms")
    without = norms.where(F.col(id_col).isNull()).select("_norm").scalar()       # rows without an id are one group
    norm = F.when(F.col(id_col).isNull(), without).otherwise(F.col("_norm"))
    return by_document(w, norms, id_col, "left").select(id_col, "term", (F.col("w") / norm).alias("weight"))


def term_scores(weights: DataFrame, clusters: DataFrame, id_col: str = "doc_id", cluster_col: str = "cluster") -> DataFrame:
    """Mean weight of each term over ALL rows of each cluster (absent = 0): sum / cluster size."""
    sizes = clusters.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_size"))
    sums = by_document(weights, clusters.select(id_col, cluster_col), id_col).groupBy(cluster_col, "term").agg(F.sum("weight").alias("_sum"))
    return (sums.join(F.broadcast(sizes), cluster_col)  # one row per cluster
            .select(cluster_col, "term", (F.col("_sum") / F.col("_size")).alias("score")))


def top_terms_per_cluster(weights: DataFrame, clusters: DataFrame, top_n: int = 10, id_col: str = "doc_id",
                          cluster_col: str = "cluster") -> DataFrame:
    """(cluster, rank, term, score), best ``top_n`` terms per cluster; ties -> term ascending."""
    s = term_scores(weights, clusters, id_col, cluster_col)
    w = Window.partitionBy(cluster_col).orderBy(F.desc(F.round("score", TIE_DIGITS)), F.asc("term"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def top_terms_one_cluster(weights: DataFrame, clusters: DataFrame, cluster_id: int, top_n: int = 10,
                          id_col: str = "doc_id", cluster_col: str = "cluster") -> DataFrame:
    """G5 for one cluster, filtered before aggregation."""
    c = clusters.where(F.col(cluster_col) == cluster_id)
    return top_terms_per_cluster(weights.join(c.select(id_col), id_col, "left_semi"), c, top_n, id_col, cluster_col)


def name_clusters(top_terms: DataFrame, n_words: int = 3, cluster_col: str = "cluster") -> DataFrame:
    """The first ``n_words`` terms joined by ' / ', title case (at most n_words rows per group are collected)."""
    t = top_terms.where(F.col("rank") <= n_words)
    g = t.groupBy(cluster_col).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_rt"))
    return g.select(cluster_col, title_case(F.array_join(F.transform("_rt", lambda s: s["term"]), " / ")).alias("cluster_name"))


def attach_cluster_name(df: DataFrame, names: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Cluster -> name, missing -> null (names has one row per cluster)."""
    return df.join(F.broadcast(names.select(cluster_col, "cluster_name")), cluster_col, "left")
