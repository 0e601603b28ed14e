"""Text embedding (E1, E3) behind a registry of encoders (M1), and language detection.

The default encoder is pure JVM: MLlib ``HashingTF`` over unigrams and bigrams,
L2-normalised -- deterministic and needs no model weights.  Plugged encoders
(a real sentence model, say) run in an iterator ``arrow_udf``, one for all the
models asked for: Arrow batches, each model built once per Python worker and
reused.  A model never sees a whole batch: texts reach it in slices of at most
``SLICE_CHARS`` characters and ``SLICE_ROWS`` rows, so a worker's memory does not
grow with the length of the texts (a single longer text is a slice of its own).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, NGram, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import stop_words

# name -> (factory, dim); factory() returns encode(list[str]) -> ndarray (n, dim)
ENCODERS: dict[str, tuple[Callable[[], Callable[[list[str]], np.ndarray]] | None, int]] = {
    "hashing": (None, 64),
}
_WORKER_MODELS: dict[str, Callable] = {}
SLICE_ROWS = 512
SLICE_CHARS = 1 << 18
_WORD = re.compile(r"[^\W_]+")
HASHES = 200_000           # words whose hash a worker remembers
_HASHES: dict[str, int] = {}
_LAST: tuple = (None, None, None)


def register_encoder(name: str, factory: Callable[[], Callable[[list[str]], np.ndarray]] | None, dim: int) -> None:
    """M1: plug an embedding model by name (the factory runs once per Python worker).

    ``factory=None`` registers another width of the JVM hashing encoder (e.g. ``register_encoder("hashing-768",
    None, 768)``)."""
    ENCODERS[name] = (factory, dim)


def _hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number named by the MD5) of every word; remembered for the list last seen, which several widths ask for."""
    global _LAST
    if _LAST[0] is not texts:
        words = [_WORD.findall(t.lower()) for t in texts]
        row = np.repeat(np.arange(len(texts)), np.array([len(w) for w in words], np.int64))
        codes, distinct = pd.factorize(np.array([w for of in words for w in of], object))
        if len(_HASHES) > HASHES:
            _HASHES.clear()
        for w in distinct:
            if w not in _HASHES:
                _HASHES[w] = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:7], 16)
        _LAST = (texts, row, np.array([_HASHES[w] for w in distinct], np.int64)[codes])
    return _LAST[1:]


def md5_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A plug-in encoder: counts of lower-cased words (letters and digits), each in the column its MD5 names (the first
    seven hexadecimal digits modulo ``dim``).  Any engine can repeat it, so results can be compared value by value."""
    def encode(texts: list[str]) -> np.ndarray:
        row, number = _hashed_words(texts)
        return np.bincount(row * dim + number % dim, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
    return encode


# three encoders of different width, for the ensemble operators; none needs model weights
ENSEMBLE = {"md5-64": 64, "md5-96": 96, "md5-128": 128}
for _name, _dim in ENSEMBLE.items():
    register_encoder(_name, functools.partial(md5_encoder, _dim), _dim)


def _check(name: str):
    if name not in ENCODERS:
        raise ValueError(f"unsupported model: {name}")
    return ENCODERS[name]


def hashing_embed(df: DataFrame, text_col: str = "text_for_embedding", out: str = "v", dim: int = 64) -> DataFrame:
    """Default encoder: hashed unigram + bigram counts, unit length (zero vector for empty text)."""
    t = df.withColumn("_w", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0))
    t = NGram(n=2, inputCol="_w", outputCol="_b").transform(t).withColumn("_wb", F.concat("_w", "_b"))
    t = HashingTF(numFeatures=dim, inputCol="_wb", outputCol="_tf").transform(t)
    t = Normalizer(p=2.0, inputCol="_tf", outputCol="_n").transform(t)
    return t.withColumn(out, vector_to_array("_n")).drop("_w", "_b", "_wb", "_tf", "_n")


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of at most SLICE_ROWS rows and SLICE_CHARS characters (one text at least)."""
    held, chars = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and (len(held) == SLICE_ROWS or chars + len(t) > SLICE_CHARS):
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def _udf_for(plugged: list[tuple[str, Callable, int]]):
    """The unit vectors of all plugged models, one after the other: a text passes to Python once, whatever their number."""
    width = sum(dim for _, _, dim in plugged)

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for name, factory, _ in plugged:
            if name not in _WORKER_MODELS:
                _WORKER_MODELS[name] = factory()
        for b in batches:
            for texts in slices(b):
                parts = []
                for name, _, dim in plugged:
                    m = np.asarray(_WORKER_MODELS[name](texts), dtype=np.float64).reshape(len(texts), dim)
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    parts.append(np.divide(m, n, out=np.zeros_like(m), where=n > 0))
                ends = pa.array(np.arange(0, width * len(texts) + 1, width, dtype=np.int32))
                yield pa.ListArray.from_arrays(ends, pa.array(np.hstack(parts).ravel()))
    return encode


def embed_text(df: DataFrame, model: str = "hashing", text_col: str = "text_for_embedding", out: str = "v") -> DataFrame:
    """Unit vectors for the text column with the named encoder; unknown model -> ValueError."""
    factory, dim = _check(model)
    if factory is None:
        return hashing_embed(df, text_col, out, dim)
    return df.withColumn(out, _udf_for([(model, factory, dim)])(F.col(text_col)))


def embed_models(df: DataFrame, models: list[str], id_col: str = "doc_id",
                 text_col: str = "text_for_embedding") -> DataFrame:
    """The same text under several models, long form (id, model, v)."""
    d = df.select(id_col, text_col)                 # the text is read once for all models
    found = [(m, *_check(m)) for m in models]
    plugged = [(m, factory, dim) for m, factory, dim in found if factory is not None]
    if plugged:
        d = d.withColumn("_all", _udf_for(plugged)(F.col(text_col)))
    each, at = [], 1
    for i, (m, factory, dim) in enumerate(found):
        if factory is None:
            d = hashing_embed(d, text_col, f"_v{i}", dim)
            v = F.col(f"_v{i}")
        else:
            v, at = F.slice("_all", at, dim), at + dim
        each.append(F.struct(F.lit(m).alias("model"), v.alias("v")))
    return d.select(id_col, F.inline(F.array(*each)))


# ------------------------------------------------------------------ language

LANGS = ("en", "es", "fr", "de")


def detect_language(df: DataFrame, text_col: str = "content", out: str = "language", langs=LANGS) -> DataFrame:
    """Language whose stop words occur most often in the text; no hit -> 'unknown'; ties -> first in ``langs``.

    Counting is per row: tokens minus the tokens left after each language's ``StopWordsRemover`` (a JVM hash set),
    so there is no explode and no shuffle.
    """
    t = df.withColumn("_tok", F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\p{L}+"), 0))
    cands = []
    for i, lang in enumerate(langs):
        t = StopWordsRemover(inputCol="_tok", outputCol=f"_k_{lang}", stopWords=list(stop_words(lang)),
                             caseSensitive=True).transform(t)
        hits = F.size("_tok") - F.size(f"_k_{lang}")
        cands.append(F.struct(hits.alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")))
    best = F.array_max(F.array(*cands))
    res: Column = F.when(best["n"] > 0, best["lang"]).otherwise(F.lit("unknown"))
    return t.withColumn(out, res).drop("_tok", *[f"_k_{lang}" for lang in langs])
