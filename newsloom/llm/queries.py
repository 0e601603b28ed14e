"""The subpackage's registered queries: each applies one operator to its whole tables and returns the full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import scratch_path

from . import align, decontam, htmltext, merkle, minhash, pii, simhash, spm, substring, tokencount, toxicity, trie, warc
from .common import read_table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), k=3, max_bits=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: x.cast("long") - acc)  # ends less starts
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS MATERIALIZED (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT DISTINCT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbour_report(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read_table(spark, sf_dir, "documents"), 20)
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = spm.encode_documents(docs, public_tokenizers.path(PIECE_MODEL), verify_col="round_trip")
    return encoded.select("doc_id", "n_tokens", "token_ids", "round_trip")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> counts the base spans; n_<kind>_all also those that deobfuscation adds."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    kinds = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *kinds, "base_sha256", "spans", *[f"{k}_all" for k in kinds])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS m FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST(concat('0x', substr(x, 1 + 10 * (i // 8), 10)) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM f
"""


HELD_OUT = "crc32(cast(doc_id AS string)) % 3 = 1"
TOXIC_SCORE = 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                                      ~F.expr(HELD_OUT))
    held_out = F.expr(HELD_OUT.replace("doc_id", "id"))
    return scores.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL),
                                  public_tokenizers.path(PIECE_MODEL))
    return found.withColumnRenamed("id", "doc_id")


def op12_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.keep_one_per_class(read_table(spark, sf_dir, "documents"), k=5, min_pct=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


OP12_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) m
  JOIN n a ON a.doc_id = m.x JOIN n b ON b.doc_id = m.y WHERE 100 * m.c >= 85 * (a.n + b.n - m.c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT r.x AS doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, r.x = r.c AS kept
FROM (SELECT x, min(y) AS c FROM reach GROUP BY x) r LEFT JOIN n ON n.doc_id = r.x
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, turn IS NOT NULL AS known,
         md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY known, turn, m) AS l FROM t GROUP BY c),
h AS (
  SELECT c, l, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
           lambda z: [unicode(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 AS h
  FROM o),
w AS MATERIALIZED (
  SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS MATERIALIZED (
  SELECT c, d, len(l) AS n, md5(CAST(to_json(l[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(l[1:d - 1]) AS VARCHAR)) END AS u,
         CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM w)),
v AS MATERIALIZED (
  SELECT k, min(c) AS c, any_value(d) AS d, any_value(u) AS u, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends
  FROM m GROUP BY k),
kids AS MATERIALIZED (SELECT u AS k, count(*) AS n FROM v WHERE u IS NOT NULL GROUP BY u),
sub AS (
  SELECT m.k, count(*) FILTER (kids.k IS NULL) AS leaves, sum(v.saved) AS saved
  FROM v LEFT JOIN kids ON kids.k = v.k JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY m.k)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN sub ON sub.k = v.k LEFT JOIN kids ON kids.k = v.k LEFT JOIN v p ON p.k = v.u
"""


# name -> (query, DuckDB SQL or None)
REGISTRY = {
    "op1_simhash_neardup": (op1_simhash_neardup, None),
    "op2_decontamination": (op2_decontamination, OP2_SQL),
    "op3_merkle_fingerprints": (op3_merkle_fingerprints, None),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op5_sentencepiece": (op5_sentencepiece, None),
    "op6_pii": (op6_pii, None),
    "op7_warc": (op7_warc, OP7_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_main_text": (op9_main_text, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_minhash_neardup": (op12_minhash_neardup, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
