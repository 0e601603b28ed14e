"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Method.  Item words become the alphabet of a generalised suffix automaton.  Document words are streamed through it;
the automaton tracks the length of the longest match that ends at each word.  A window of ``window`` consecutive item
words occurs where that length reaches ``window``; an item with fewer words is one window and occurs where the match
reaches its own state.  Words inside an occurrence are hit; spans of hit words can be cut, and documents whose hit
share exceeds a limit can be dropped.

Scale.  Items are dealt by hash into shards of about SHARD_WORDS words; each shard's automaton is built on the driver
and broadcast (its size is bounded by the shard, not by the benchmark), and the documents pass through the shards one
after the other without a shuffle, each pass stored.  Only stretches of known words of at least the shortest window
are streamed: a window cannot hold an unknown word.

Edge cases.  Null text has no words (document or item); an item without words has no window.  A repeated item id is
one item; an item without an id hits words but is not listed.  Repeated document rows are each returned.  Extra
columns are ignored (``remove_contamination`` keeps them).  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, stored

SHARD_WORDS = 100_000
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")   # of text whose A-Z are lower-cased
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased letters and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the word sequences of (item id, words) pairs."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.code.setdefault(w, len(self.code)) for w in words]) for i, words in items if words]
        self.shortest = min((min(window, len(c)) for _, c in coded), default=window)
        for _, codes in coded:
            state = 0
            for c in codes:
                state = self._extend(state, c)
        self.long: dict[int, set] = {}       # state that holds a window of full length -> items
        self.short: dict[int, list] = {}     # state that holds a whole shorter item -> [(words, item)]
        for item, codes in coded:
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    self.long.setdefault(self._holding(state, window), set()).add(item)
                    state = self._holding(state, window)
            if len(codes) < window:
                self.short.setdefault(self._holding(state, len(codes)), []).append((len(codes), item))
        self.above = self._short_above()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _holding(self, state: int, n: int) -> int:
        """The suffix state of ``state`` whose strings include the one of ``n`` words."""
        while self.length[self.link[state]] >= n and self.link[state] > 0:
            state = self.link[state]
        return state

    def _short_above(self) -> list[int]:
        """For each state the nearest proper suffix state that holds a whole shorter item, or 0."""
        above = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            above[state] = up if up in self.short else above[up] if up > 0 else 0
        return above

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [first, end) word intervals of all window occurrences, and the items whose windows occur."""
        n = len(words)
        if n < self.shortest or not self.code:
            return [], set()
        codes = np.fromiter(map(self.code.get, words, [-1] * n), np.int64, n)
        edge = np.flatnonzero(np.diff(np.r_[False, codes >= 0, False]))
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= self.shortest
        found: list[list[int]] = []
        items: set = set()
        for lo, hi in zip(begin[keep].tolist(), end[keep].tolist()):
            self._stream(codes[lo:hi].tolist(), lo, found, items)
        return [tuple(x) for x in found], items

    def _stream(self, codes, at, found, items):
        nxt, link, length, window, short, above = self.next, self.link, self.length, self.window, self.short, self.above
        state = size = 0
        for i, c in enumerate(codes, at + 1):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            if size < self.shortest:
                continue
            cover = 0
            if size >= window:
                cover = window
                items |= self.long[self._holding(state, window)]
            s = state
            while s and short:
                for w, item in short.get(s, ()):
                    if w <= size:
                        cover = max(cover, w)
                        items.add(item)
                s = above[s]
            if cover:
                first = i - cover
                while found and found[-1][0] >= first:     # a longer match swallows shorter ones
                    found.pop()
                if found and found[-1][1] >= first:
                    found[-1][1] = i
                else:
                    found.append([first, i])


def automata(items: DataFrame, id_col: str, text_col: str, window: int):
    """Yield one automaton per shard of the items (at least one)."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
    words = rows.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\u0080-\U0010FFFF]+")))).first()[0] or 0
    shards = -(-words // SHARD_WORDS) or 1
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == k) if shards > 1 else rows
        yield SuffixAutomaton([(r["id"], item_words(r["t"])) for r in part.collect()], window)


def _scan_pass(rows: DataFrame, automaton: SuffixAutomaton, schema: T.StructType) -> DataFrame:
    """Columns id, t, words, hits (flat list of interval ends), items: one more shard's hits merged in."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        auto = shared.value
        for b in batches:
            size, hits, items = [], [], []
            for t, old, had in zip(b.column(1), b.column(3).to_pylist(), b.column(4).to_pylist()):
                words = item_words(t.as_py())
                spans, found = auto.scan(words)
                size.append(len(words))
                pairs = zip(old[::2], old[1::2]) if old else ()
                hits.append([x for s in merged([*pairs, *spans]) for x in s])
                items.append(sorted({*had, *(i for i in found if i is not None)}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], ["id", "t", "n_words", "hits", "items"])

    return rows.mapInArrow(run, schema)


def merged(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, t, n_words, hits, items) for every row: word count, merged hit intervals [first, end) of word numbers as a
    flat list, and the sorted ids of items with occurring windows."""
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("t", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for k, automaton in enumerate(automata(items, item_id, item_text, window)):
        out = _scan_pass(stored(out, "decontam") if k else out, automaton, schema)
    return out


def cut_words(text: str, hits: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each interval."""
    where = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    kept, at = [], 0
    for a, b in hits:
        kept.append(text[at:where[a][0]])
        at = where[b - 1][1]
        if kept[-1].endswith(" ") or not kept[-1]:
            at += text[at:at + 1] == " "
    return "".join([*kept, text[at:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
                         text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with all its columns: hit words are cut from the text, and a document with more than ``max_coverage`` of
    its words hit is dropped, both by the merged hits of all shards on the text as given.  Texts without hits stay."""
    at, own = docs.columns.index(text_col), "__hits"
    while own in docs.columns:
        own += "_"
    out = docs.withColumn(own, F.array().cast("array<int>"))
    shards = automata(items, item_id, item_text, window)
    automaton, after = next(shards), next(shards, None)
    while after is not None:
        out = stored(_hit_pass(out, automaton, at, None), "decontam-hits")
        automaton, after = after, next(shards, None)
    return _hit_pass(out, automaton, at, max_coverage)


def _hit_pass(rows: DataFrame, automaton: SuffixAutomaton, at: int, max_coverage: float | None) -> DataFrame:
    """``rows`` with one more shard's hits merged into their last column; with ``max_coverage`` (the last shard) the
    texts are cut once by the hits of all shards, and that column goes."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    schema = rows.schema if max_coverage is None else T.StructType(rows.schema.fields[:-1])

    def run(batches):
        auto = shared.value
        for b in batches:
            keep, texts, every = [], [], []
            for t, old in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                text = t.as_py()
                words = item_words(text)
                hits = auto.scan(words)[0]
                if old:
                    hits = [tuple(s) for s in merged([*zip(old[::2], old[1::2]), *hits])]
                if max_coverage is None:
                    every.append([x for s in hits for x in s])
                else:
                    keep.append(sum(e - s for s, e in hits) <= max_coverage * len(words))
                    texts.append(cut_words(text, hits) if hits else text)
            columns, fields = [*b.columns], [*b.schema]
            if max_coverage is None:
                columns[-1] = pa.array(every, fields[-1].type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
            else:
                columns[at] = pa.array(texts, fields[at].type)
                yield pa.RecordBatch.from_arrays(columns[:-1], schema=pa.schema(fields[:-1])).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, schema)
