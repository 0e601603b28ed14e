"""Language identification by a trained character n-gram model.

A model holds, per language, the ``top`` most frequent character trigrams of labelled texts: letters only, lower case, words
apart by one space, with a space before the first and after the last.  A text is scored by the mean log-likelihood of its
trigrams that any language knows, with add-one smoothing; the best language wins if it leads the second by ``margin`` and at
least ``min_grams`` known trigrams stand in the text, otherwise the language is unknown (null).

Scale.  Training is an aggregate with per-task counters before the shuffle, so frequent trigrams cost one row a task.  The
model is bounded by ``top`` rows a language and is the only thing broadcast; scoring is one pass without a shuffle.  Null or
empty texts are unknown; rows without a label do not train.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP, MIN_GRAMS, MARGIN = 3000, 10, 0.05
_FLUSH = 300_000


def letters(text_col: str) -> Column:
    """The text as the model reads it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(x: str) -> Counter:
    return Counter(map("".join, zip(x, x[1:], x[2:])))


def train_language_model(labelled: DataFrame, lang_col: str = "language", text_col: str = "content", top: int = TOP) -> DataFrame:
    """(lang, gram, n): the ``top`` trigrams of each language by count, ties in code-point order."""

    def table(seen: dict[str, Counter]):
        rows = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          ["lang", "gram", "n"])

    def run(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(grams(x))
            if sum(map(len, seen.values())) > _FLUSH:
                yield table(seen)
                seen = {}
        yield table(seen)

    src = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), letters(text_col).alias("x"))
    counts = src.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).drop("r")


class LanguageModel:
    """Log-likelihoods of the model's trigrams per language, languages in name order."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        vocab = {g: i for i, g in enumerate(sorted({r[1] for r in rows}))}
        n = np.zeros((len(vocab), len(self.langs)))
        for lang, g, c in rows:
            n[vocab[g], at[lang]] = c
        self.vocab, self.logs = vocab, np.log((n + 1) / (n.sum(axis=0) + len(vocab))) if vocab else n

    def __call__(self, x: str, min_grams: int, margin: float) -> tuple[str | None, float | None]:
        """(language or None, lead of the best over the second)."""
        known = [(self.vocab[g], n) for g, n in grams(x).items() if g in self.vocab]
        total = sum(n for _, n in known)
        if total < max(1, min_grams) or not self.langs:
            return None, None
        score = np.array([n for _, n in known], float) @ self.logs[[i for i, _ in known]] / total
        order = np.argsort(-score, kind="stable")
        lead = float(score[order[0]] - score[order[1]]) if len(order) > 1 else float("inf")
        return (self.langs[order[0]] if lead >= margin else None), lead


def identify_language(df: DataFrame, model: DataFrame, text_col: str = "content", out: str = "language", lead: str = "lead",
                      min_grams: int = MIN_GRAMS, margin: float = MARGIN) -> DataFrame:
    """``df`` with the language of each text and its lead over the second (both null where too few trigrams are known)."""
    df = df.drop(out, lead)
    rows = [(r["lang"], r["gram"], r["n"]) for r in model.select("lang", "gram", "n").collect()]      # top rows a language
    held = df.sparkSession.sparkContext.broadcast(LanguageModel(rows))
    names = [*df.columns, out, lead]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(lead, T.DoubleType())])

    def run(batches):
        for b in batches:
            found = [held.value(x, min_grams, margin) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names)

    read = "letters"
    while read in df.columns:
        read = f"_{read}"
    return df.withColumn(read, letters(text_col)).mapInArrow(run, schema)
