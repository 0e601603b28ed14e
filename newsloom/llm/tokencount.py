"""Exact token counts without token ids.

Method.  The piece model never merges across a change from a non-space to a space, so a text is a sequence of
pre-tokens (a run of spaces with the word after it) whose piece counts add up.  Pieces are counted once per distinct
pre-token of the corpus; the counts are joined to each document's pre-token frequencies and summed.

Scale.  The census sums per-task counters before the shuffle.  Pre-tokens with more than 1/HOT_PARTS of all occurrences
(so fewer than HOT_PARTS of them; those of over HOT_CHARS characters by a 128-bit digest) are broadcast and summed where
the text is read; the remaining (document, pre-token, frequency) rows go through a shuffle join, so every pre-token counts.
No key is hot in that join: a pre-token there has at most 1/HOT_PARTS of the occurrences, and a document's head row has
a key of its own.  Rows are numbered by partition and position (``monotonically_increasing_id``): neighbouring numbers
compress to a byte or two, and the id travels in the head row alone.  No two rows share a number, whatever their ids and
texts; as with every such number, a task that Spark repeats must meet its rows in the same order, as scans of files do.

Edge cases.  Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are each returned.  Null ids are kept.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, stored

HOT_PARTS = 3_000_000
HOT_CHARS = 64
_FLUSH = 400_000     # distinct pre-tokens a task holds before it passes its counter on
_SPACED = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Strings whose own encodings, one after the other, are the encoding of ``text``.

    The library puts one space before what it encodes, so a pre-token after the first loses one leading space; a lone
    trailing space becomes the empty string.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")                     # the library's own sign for a space
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    parts = _SPACED.findall(text)
    return parts[:1] + [p[1:] for p in parts[1:]]


class PieceCounter:
    """Pieces of one pre-token, as the library counts them."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        # a lone trailing space: what "x " has over "x"
        self.space = len(self.model.encode("x ")) - len(self.model.encode("x"))

    def __call__(self, keys: list[str]) -> list[int]:
        return [len(ids) if k else self.space for k, ids in zip(keys, self.model.encode(keys, num_threads=1))]


def hot_key(pre_token: str) -> str | bytes:
    """The name of a pre-token in the broadcast table."""
    return pre_token if len(pre_token) <= HOT_CHARS else xxhash.xxh128_digest(pre_token.encode("utf-8"))


def pre_token_census(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece_key, n): every distinct pre-token with its occurrences in the corpus."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(pre_tokens(t.as_py()))
                if len(seen) > _FLUSH:
                    yield table(seen)
                    seen = Counter()
        yield table(seen)

    def table(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], ["piece_key", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "piece_key string, n long")
    return parts.groupBy("piece_key").agg(F.sum("n").alias("n"))


def piece_counts(census: DataFrame, model_path: str) -> DataFrame:
    """(piece_key, n, pieces): the piece count of each distinct pre-token, computed once."""

    def run(batches):
        count = PieceCounter(model_path)
        for b in batches:
            pieces = pa.array(count(b.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pieces], ["piece_key", "n", "pieces"])

    return census.mapInArrow(run, "piece_key string, n long, pieces long")


def _hot_table(hot: DataFrame) -> dict[str | bytes, int]:
    """Pieces of the frequent pre-tokens by ``hot_key``, which is taken in the tasks."""

    def run(batches):
        for b in batches:
            keys = [hot_key(k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k if isinstance(k, str) else None for k in keys], pa.string()),
                                              pa.array([k if isinstance(k, bytes) else None for k in keys], pa.binary()),
                                              b.column(1)], ["key", "digest", "pieces"])

    rows = hot.select("piece_key", "pieces").mapInArrow(run, "key string, digest binary, pieces long").collect()
    return {r[0] if r[0] is not None else bytes(r[1]): r[2] for r in rows}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    vocab = stored(piece_counts(pre_token_census(src, "t"), model_path), "pieces")
    total = vocab.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(HOT_PARTS) > F.lit(total)
    hot = spark.sparkContext.broadcast(_hot_table(vocab.where(is_hot)))
    id_type = field_type(docs, id_col)
    names = ["id", "n_bytes", "freq", "row", "piece_key"]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("freq", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("piece_key", T.StringType())])

    def run(batches):
        """One head row per document (its id, bytes and the sum over broadcast pre-tokens), then a row for each other one."""
        pieces = hot.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                at, size, freq, row, key = [], [], [], [], []
                for i, (number, t) in enumerate(zip(part.column(0).to_pylist(), part.column(2))):
                    text = t.as_py() or ""
                    rest, total = Counter(), 0
                    for k in pre_tokens(text):
                        n = pieces.get(k if len(k) <= HOT_CHARS else hot_key(k))
                        if n is None:
                            rest[k] += 1
                        else:
                            total += n
                    at += [i] + [None] * len(rest)
                    size += [len(text.encode("utf-8"))] + [None] * len(rest)
                    freq += [total, *rest.values()]
                    row += [number] * (1 + len(rest))
                    # no pre-token has an inner space before a non-space, so the head row's key is its own
                    key += [f"x x{number}", *rest]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(pa.array(at, pa.int32())), pa.array(size, pa.int64()), pa.array(freq, pa.int64()),
                     pa.array(row, pa.int64()), pa.array(key, pa.string())], names)

    rows = src.select(F.monotonically_increasing_id().alias("row"), "id", "t").mapInArrow(run, schema)
    cold = vocab.where(~is_hot).select("piece_key", "pieces")
    # head rows meet no pre-token: their sum counts once
    return (rows.join(cold, "piece_key", "left")
            .groupBy("row")
            .agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"),
                 F.sum(F.col("freq") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
            .drop("row"))
