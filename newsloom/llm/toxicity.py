"""Toxicity scores of texts restored by a noisy-channel decoder.

Method.  (1) Word counts of the whole corpus give a character trigram model.  (2) Tokens that look disguised --
leetspeak, repeated letters, letters set apart -- become a lattice of characters (each symbol may stand for some
letters, a run of one letter for one or two, a gap for nothing); Viterbi decoding under channel costs and the
character model restores the likeliest word.  (3) Character n-grams of raw and restored words, chosen by their
association with the label, feed a logistic model; the score is its probability.

Learning.  The census of words covers every document.  The classifier is fitted on at most SAMPLE_ROWS labelled rows
(a documented bound; chosen by a hash of the id, only rows the caller marks as learnable).  Copies of one label count
once: equal texts, and texts whose word pairs have a Jaccard similarity of at least NEAR with those of a kept row.
Rows of different labels are never taken for copies.

Scale.  The census sums per-task counters before the shuffle; the model has at most |ALPHABET|^3 trigrams, the
classifier at most FEATURES n-grams, so what is collected and broadcast is bounded.  Scoring is one pass without a
shuffle; n-grams are found by an Aho-Corasick automaton, so a text costs time linear in its length.

Edge cases.  Null text counts as empty; an empty text scores the model's bias.  Without labelled rows of both classes
every score is the share of label 1 (0.0 if there is none).  Repeated rows are each returned.  Rows of the label table
with null ids or labels teach nothing; repeated label rows count once each.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, stored

SAMPLE_ROWS = 20_000
FEATURES = 4_000
GRAMS = (4, 5, 6)
MIN_ROWS = 5              # rows of label 1 that must hold an n-gram
NEAR = 0.8                # Jaccard similarity of near copies
SKETCH = 512              # least word-pair hashes kept of a text: up to so many distinct pairs the similarity is exact
BANDS, BAND = 12, 5       # rows that agree in the BAND minima of some band are compared
_FLUSH = 100_000          # entries a task's counter or memory may hold
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
OTHER = "?"
# fixed values: letters a symbol may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou", "#": "h"}
LEET_COST, KEEP_COST, DROP_COST, DOUBLE_COST = 0.7, 2.5, 0.3, 1.2

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.escape("".join(LEET))
_LEET_TOKEN = re.compile(rf"(?<![\w{_SYMBOLS}])(?=[\w{_SYMBOLS}]*[^\W\d_])[^\W_{_SYMBOLS}]*[{_SYMBOLS}](?:[^\W_]|[{_SYMBOLS}])*[^\W_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1").search
_SPACED = re.compile(rf"(?<![\w{_SYMBOLS}])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{{1,2}}(?:[^\W_]|[@$!|+])(?!\w)){{3,}}")
_SPACED_HINT = re.compile(r"[ .\-_*]\S[ .\-_*]{1,2}\S[ .\-_*]").search


class CharModel:
    """Interpolated character trigram model as costs (negative logarithms)."""

    def __init__(self, counts: dict[str, int]):
        pair, one, single = Counter(), Counter(), Counter()
        for g, n in counts.items():
            pair[g[:2]] += n
            one[g[1:]] += n
            single[g[2]] += n
        lead, total = Counter(), sum(single.values()) or 1
        for g, n in one.items():
            lead[g[0]] += n
        floor = 1.0 / (len(ALPHABET) + 2)
        self.uni = {c: 0.9 * n / total + 0.1 * floor for c, n in single.items()}
        self.floor = 0.1 * floor
        self.counts, self.pair, self.one, self.lead = counts, pair, one, lead
        self.memo: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        got = self.memo.get(g)
        if got is None:
            p1 = self.uni.get(c, self.floor)
            p2 = (self.one.get(b + c, 0) + 20 * p1) / (self.lead.get(b, 0) + 20)
            p3 = (self.counts.get(g, 0) + 20 * p2) / (self.pair.get(a + b, 0) + 20)
            got = self.memo[g] = -math.log(p3)
        return got


def _class(c: str) -> str:
    return c if c in _LETTERS or c == " " else OTHER


_LETTERS = frozenset(ALPHABET)


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind a disguised token: Viterbi over its character lattice."""
    runs: list[tuple[str, int]] = []
    for c in token.lower():
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    paths = {"  ": (0.0, "")}
    for c, n in runs:
        if c in " .-_":
            choices = [("", DROP_COST)]
        else:
            singles = [(x, LEET_COST) for x in LEET.get(c, "")] + [(c, KEEP_COST if c in LEET else 0.0)]
            choices = [(x, cost) for x, cost in singles] if n != 2 else [(x * 2, cost) for x, cost in singles]
            if n > 1:
                choices += [(x if n == 2 else x * 2, cost + DOUBLE_COST) for x, cost in singles]
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, word) in paths.items():
            for text, extra in choices:
                a, b, total = state[0], state[1], cost + extra
                for x in text:
                    y = _class(x)
                    total += model.cost(a, b, y)
                    a, b = b, y
                key = a + b
                if key not in after or total < after[key][0]:
                    after[key] = (total, word + text)
        paths = after
    return min((cost + model.cost(s[0], s[1], " "), word) for s, (cost, word) in paths.items())[1]


class Restorer:
    """Normalised text: raw words, then the restored words of disguised tokens, each between single spaces."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def __call__(self, text: str) -> str:
        text = text.lower()
        words, memo = _WORD.findall(text), self.memo
        if len(memo) > _FLUSH:
            memo.clear()
        for token in set(text.split()):
            got = memo.get(token)
            if got is None:
                got = memo[token] = self._restored(token)
            words += got
        if _SPACED_HINT(text):
            for m in _SPACED.finditer(text):
                words += _WORD.findall(restore(m.group(), self.model))
        return f" {' '.join(words)} "

    def _restored(self, token: str) -> tuple[str, ...]:
        """Words behind the disguised parts of one token; most tokens have none."""
        found = [w for w in _WORD.findall(token) if _TRIPLE(w)] if _TRIPLE(token) else []
        if not token.isalpha():
            found += [m.group() for m in _LEET_TOKEN.finditer(token)]
        return tuple(w for x in found for w in _WORD.findall(restore(x, self.model)))


def word_census(docs: DataFrame, text_col: str) -> DataFrame:
    """(w, n): every word of the corpus with its count."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(_WORD.findall((t.as_py() or "").lower()))
                if len(seen) > _FLUSH:
                    yield table(seen)
                    seen = Counter()
        yield table(seen)

    def table(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "w string, n long")
    return rows.groupBy("w").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Trigram counts over all words of all documents; at most (len(ALPHABET) + 2) ** 3 rows reach the driver."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = "  " + "".join(map(_class, w)) + " "
                for i in range(len(w) - 2):
                    seen[w[i:i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["g", "n"])

    grams = word_census(docs, text_col).mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel({r["g"]: r["n"] for r in grams.collect()})


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return list({w[i:i + k] for k in GRAMS for i in range(len(w) - k + 1)} | {w})


class Classifier:
    """Logistic model over the presence of n-grams, and for each n-gram the lower bound of its share of label 1.

    The score is the larger of the model's probability and the best bound: training texts hold several signs at once,
    which halves each one's weight, yet one certain sign is enough.
    """

    def __init__(self, weight: dict[str, float], bias: float, sure: dict[str, float] | None = None):
        self.weight, self.bias, self.sure = weight, bias, sure or {}

    def scorer(self):
        auto = ahocorasick.Automaton()
        for g, w in self.weight.items():
            auto.add_word(g, (g, w, self.sure.get(g, 0.0)))
        auto.make_automaton()

        def score(normal: str) -> float:
            signs = sorted({x for _, x in auto.iter(normal)}) if self.weight else ()
            total = self.bias + math.fsum(w for _, w, _ in signs)
            return max([1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, total)))), *(s for _, _, s in signs)])

        return score


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, model: CharModel, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most about ``sample_rows`` labelled rows for which ``learnable`` (over the label table) holds."""
    known = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # at most the sample's bounded number of ids is broadcast; the texts are scanned where they are
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t"))
    rows = _one_per_copy(rows.join(F.broadcast(known), "__id").select("t", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        restorer, seen = Restorer(shared.value), {}
        for b in batches:
            for t, y in zip(*b.columns):
                grams: set = set()
                for w in set(restorer(t.as_py() or "").split()):
                    grams.update(_grams(w))
                for g in grams:
                    two = seen.get(g)
                    if two is None:
                        two = seen[g] = [0, 0]
                    two[y.as_py() > 0] += 1
                if len(seen) > 3 * _FLUSH:
                    yield table(seen)
                    seen = {}
        yield table(seen)

    def table(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                           pa.array([v[1] for v in seen.values()], pa.int64())], ["g", "n0", "n1"])

    total = {r["y"] > 0: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(False, 0), total.get(True, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Classifier({}, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    grams = rows.mapInArrow(count, "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    odds = F.log(p1 * (1 - p0) / (p0 * (1 - p1)))
    strong = grams.where((F.col("n1") >= MIN_ROWS) & (odds > 2)).withColumn("rank", odds * F.sqrt("n1"))
    best = strong.orderBy(F.desc("rank"), "g").limit(FEATURES).collect()
    sure = {r["g"]: _lower_bound(r["n1"], r["n0"]) for r in best}
    return _logistic(rows, [r["g"] for r in best], shared, sure)


def _lower_bound(n1: int, n0: int, z: float = 3.0) -> float:
    """Wilson lower bound of n1 / (n1 + n0)."""
    n = n1 + n0
    p = n1 / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _one_per_copy(rows: DataFrame) -> DataFrame:
    """One row of each group of equal (t, y), and of those no row that is a near copy of a kept row of its label.

    Each row of the bounded sample reaches the driver as a sketch of bounded size, never as its text."""

    def sketch(batches):
        for b in batches:
            found = [_sketch(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.binary()) for c in zip(*found))], ["t", "y", "h", "m", "s"])

    schema = "t string, y int, h binary, m binary, s binary"
    rows = stored(rows.dropDuplicates(["t", "y"]).mapInArrow(sketch, schema), "toxic-sample")
    gone = near_copies([(bytes(r["h"]), r["y"] > 0, r["m"], r["s"]) for r in rows.select("h", "y", "m", "s").collect()])
    gone = rows.sparkSession.createDataFrame([(bytearray(h), y) for h, y in gone], "h binary, positive boolean")
    return rows.join(F.broadcast(gone), (rows["h"] == gone["h"]) & ((rows["y"] > 0) == gone["positive"]), "left_anti").select("t", "y")


_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(text: str) -> tuple[bytes, bytes, bytes]:
    """Hash of the text, its minima for the bands, and its SKETCH least word-pair hashes."""
    words = text.lower().split()
    pairs = {f"{x} {y}" for x, y in zip(words, words[1:])} or {" ".join(words)}
    x = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, pairs), np.uint64, len(pairs)))
    y = x ^ (x >> np.uint64(29))
    minima = np.array([(y * a + b).min() for a, b in _MIX.T], np.uint64)
    return xxhash.xxh3_128_digest(text), minima.tobytes(), x[:SKETCH].tobytes()


def near_copies(sketches: list[tuple[bytes, bool, bytes, bytes]]) -> list[tuple[bytes, bool]]:
    """(hash, label) of the rows that are near copies of a kept row, rows being taken by hash; all others are kept."""
    gone, kept, by_band = [], [], {}
    for h, y, minima, least in sorted(sketches, key=lambda r: (r[1], r[0])):
        keys = [(y, i, minima[i * BAND * 8:(i + 1) * BAND * 8]) for i in range(BANDS)]
        least = np.frombuffer(least, np.uint64)
        if any(_similar(least, kept[k]) for k in {k for key in keys for k in by_band.get(key, ())}):
            gone.append((h, y))
            continue
        for key in keys:
            by_band.setdefault(key, []).append(len(kept))
        kept.append(least)
    return gone


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sketches is at least NEAR: the share of common hashes among the
    least of their union, which is all of it unless a text has more than SKETCH pairs."""
    if min(len(x), len(y)) < NEAR * max(len(x), len(y)):
        return False
    both = np.union1d(x, y)
    if max(len(x), len(y)) == SKETCH:
        both = both[:SKETCH]
    common = np.intersect1d(x, y, assume_unique=True)
    return np.count_nonzero(common <= both[-1]) >= NEAR * len(both)


def _logistic(rows: DataFrame, chosen: list[str], shared, sure: dict[str, float]) -> Classifier:
    """Ridge logistic regression over the chosen n-grams; each sampled row reaches the driver as its feature numbers."""
    names = rows.sparkSession.sparkContext.broadcast(chosen)

    def hits(batches):
        auto, restorer = ahocorasick.Automaton(), Restorer(shared.value)
        for i, g in enumerate(names.value):
            auto.add_word(g, i)
        auto.make_automaton()
        for b in batches:
            found = [sorted({i for _, i in auto.iter(restorer(t.as_py() or ""))}) if names.value else [] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "f"])

    data = rows.mapInArrow(hits, "y int, f array<int>").collect()
    data.sort(key=lambda r: (r["y"], r["f"]))                 # the order of rows must not change the fit
    y = np.array([r["y"] > 0 for r in data], float)
    row = np.repeat(np.arange(len(data)), [len(r["f"]) for r in data])
    col = np.array([f for r in data for f in r["f"]], int)
    w, b = np.zeros(len(chosen)), math.log(y.mean() / (1 - y.mean()))
    hit = np.bincount(col, minlength=len(chosen)).astype(float)
    each = np.maximum(1.0, np.bincount(row, minlength=len(data)))
    widest = np.bincount(col, weights=each[row], minlength=len(chosen)) / np.maximum(1.0, hit)
    for _ in range(300):                                       # diagonal Newton steps, damped for correlated n-grams
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=len(data)), -60, 60)))
        grad = np.bincount(col, weights=(y - p)[row], minlength=len(chosen)) - 0.5 * w
        curve = np.bincount(col, weights=(p * (1 - p))[row], minlength=len(chosen)) * widest + 0.5
        w += grad / curve
        b += 0.5 * (y - p).sum() / max(1e-6, (p * (1 - p)).sum() + 1e-3)
    return Classifier(dict(zip(chosen, w.tolist())), float(b), sure)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """(id, score) for every row."""
    score = scorer(docs, labels, learnable, id_col, text_col, label_col)
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches):
        scored = score.value.ready()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scored(t.as_py()) for t in b.column(1)], pa.float64())],
                                             ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


class TextScorer:
    def __init__(self, model: CharModel, classifier: Classifier):
        self.model, self.classifier = model, classifier

    def ready(self):
        restorer, score = Restorer(self.model), self.classifier.scorer()
        return lambda text: score(restorer(text or ""))


def scorer(docs, labels, learnable, id_col="doc_id", text_col="text", label_col="toxic"):
    """A broadcast TextScorer trained on ``docs`` and ``labels``."""
    model = character_model(docs, text_col)
    classifier = fit(docs, labels, learnable, model, id_col, text_col, label_col)
    return docs.sparkSession.sparkContext.broadcast(TextScorer(model, classifier))


def remove_toxic(docs: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.7, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` with all its columns, without the rows whose score reaches ``threshold``."""
    score = scorer(docs, labels, learnable, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches):
        scored = score.value.ready()
        for b in batches:
            yield b.filter(pa.array([scored(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
