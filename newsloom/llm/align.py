"""Links between the tokens of two tokenizers over the same text, by products of sparse incidence matrices.

Method.  The token-byte incidence matrices A and B of a text (one row per token, one column per byte, hand-built CSR) are
multiplied by Gustavson's row products: row i of A·Bᵀ merges the rows of Bᵀ at the bytes of token i, so its entries are the
tokens of B that overlap token i, with the bytes they share.  Byte offsets where tokens of both end cut the text into
groups; the token-group incidence matrices GA and GB give the shared-group links as GA·GBᵀ in the same way.

Scale.  Neither tokenizer has a token across the change from a non-space to a single space, so the matrices of a text are
block-diagonal by its segments (a word, mostly): each distinct segment's blocks are built and multiplied once, many segments
in one product, and remembered in a bounded table; a document adds up its segments.  Products are made in blocks of rows, so
no work array grows with a text.  A document keeps its distinct (a, b) pairs with their numbers.  Counts are summed per task before the shuffle.  Pairs with
more than 1/HOT_PAIRS of all links (so fewer than HOT_PAIRS of them, 25 bytes each) are broadcast and looked up where
the document is; the others go through a shuffle join, in which no key is hot.

Edge cases.  Null or empty texts, and texts whose joined token bytes are not a space and the text (the text holds the piece
sign U+2581, for one), have no tokens: zeros and an empty digest column.  Repeated rows and null ids are each returned.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, stored

HOT_PAIRS = 1_000_000
PART_CHARS = 1 << 16
_BLOCK = 1 << 18            # entries of a work array
_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")
_FLUSH = 500_000
_SEGMENTS = 300_000         # remembered segments of a worker, in two generations
_TOGETHER = 4_000           # segments multiplied at a time
_JOINED = 200               # segments encoded as one text
_CHARS = 1 << 20            # characters of documents taken at a time


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has ``data`` at the columns ``cols``, both from ``ptr[i]`` to ``ptr[i + 1]``."""
    ptr: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    width: int


def incidence(ends: np.ndarray, width: int) -> Csr:
    """Rows are consecutive spans of columns: span i ends (exclusive) at ``ends[i]``."""
    return Csr(np.r_[0, ends].astype(np.int64), np.arange(width, dtype=np.int64), np.ones(width, np.int64), width)


def membership(groups: np.ndarray, width: int) -> Csr:
    """Row i has one entry, at column ``groups[i]``."""
    n = len(groups)
    return Csr(np.arange(n + 1, dtype=np.int64), groups.astype(np.int64), np.ones(n, np.int64), width)


def transpose(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.ptr) - 1), np.diff(m.ptr))
    order = np.argsort(m.cols, kind="stable")
    ptr = np.r_[0, np.cumsum(np.bincount(m.cols, minlength=m.width))]
    return Csr(ptr.astype(np.int64), rows[order], m.data[order], len(m.ptr) - 1)


def row_products(a: Csr, b: Csr, block: int = _BLOCK):
    """Gustavson's product a·b as blocks (row, column, value) of whole rows; a row with more than ``block`` terms is a
    block of its own, so a block is bounded by that or by one row."""
    if a.width != len(b.ptr) - 1:
        raise ValueError("shapes differ")
    size = np.diff(b.ptr)[a.cols]                               # terms of each entry of a
    terms = np.r_[0, np.cumsum(size)][a.ptr]
    rows, lo = len(a.ptr) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(terms, terms[lo] + block, "right")) - 1)
        s, e = a.ptr[lo], a.ptr[hi]
        n = size[s:e]
        at = np.repeat(b.ptr[a.cols[s:e]] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(int(n.sum()))
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.ptr[lo:hi + 1])), n)
        col, val = b.cols[at], np.repeat(a.data[s:e], n) * b.data[at]
        key = row * b.width + col
        if len(key):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, val = key[order], val[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])     # equal entries of a row merge
            yield key[head] // b.width, key[head] % b.width, np.add.reduceat(val, head)
        lo = hi


class Alignment(NamedTuple):
    """Ids and byte ends of both token sequences, the group of each token, and the number of groups."""
    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    n_groups: int

    def overlap_links(self):
        """Blocks (a token, b token, bytes shared) of A·Bᵀ."""
        width = int(self.a_ends[-1]) if len(self.a_ends) else 0
        return row_products(incidence(self.a_ends, width), transpose(incidence(self.b_ends, width)))

    def group_links(self):
        """Blocks (a token, b token, 1) of GA·GBᵀ: tokens of one group."""
        return row_products(membership(self.a_groups, self.n_groups), transpose(membership(self.b_groups, self.n_groups)))

    def group_texts(self) -> list[str]:
        """``a1,a2|b1`` for each group."""
        sides = []
        for ids, group in ((self.a, self.a_groups), (self.b, self.b_groups)):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(ids) else []
            text = list(map(str, ids.tolist()))
            sides.append([text[s] if e - s == 1 else ",".join(text[s:e]) for s, e in zip(first, [*first[1:], len(text)])])
        return [f"{x}|{y}" for x, y in zip(*sides)]

    def groups_text(self) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        return ";".join(self.group_texts())


def byte_level_bytes() -> dict[str, int]:
    """The byte of each sign of the byte-level alphabet: printable Latin-1 stands for itself, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of about ``size`` characters; each but the first starts with a space between two non-spaces."""
    out, lo = [], 0
    while len(text) - lo > size:
        m = _CUT.search(text, lo + size - 1)
        if not m:
            break
        out.append(text[lo:m.start()])
        lo = m.start()
    return [*out, text[lo:]]


class Aligner:
    """Both tokenizers of a worker: ``bpe_path`` byte-level (A), ``piece_path`` with byte fallback (B)."""

    def __init__(self, bpe_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of = byte_level_bytes()
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexes = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.b_bytes = [bytes([int(h[1], 16)]) if h else p.replace("▁", " ").encode() for h, p in zip(hexes, pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def __call__(self, texts: list[str | None]) -> list[Alignment | None]:
        """None for a text without tokens."""
        split = [parts(t) if t else [] for t in texts]
        flat = [p for s in split for p in s]
        first = [i == 0 for s in split for i in range(len(s))]
        a = self.a.encode_batch_fast([" " + p if f else p for p, f in zip(flat, first)], add_special_tokens=False)
        b = self.b.encode([p if f else p[1:] for p, f in zip(flat, first)], num_threads=1)       # it adds a space itself
        out, at = [], 0
        for text, s in zip(texts, split):
            span = range(at, at + len(s))
            at += len(s)
            ids_a, ids_b = [i for k in span for i in a[k].ids], [i for k in span for i in b[k]]
            want = (" " + text).encode("utf-8") if s else b""
            same = s and b"".join([self.a_bytes[i] for i in ids_a]) == want == b"".join([self.b_bytes[i] for i in ids_b])
            out.append(self.align(ids_a, ids_b) if same else None)
        return out

    def align(self, ids_a, ids_b) -> Alignment:
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        # (a token without bytes would repeat an end)
        both = np.intersect1d(a_ends, b_ends, assume_unique=bool(self.a_len[a].all() and self.b_len[b].all()))
        # a token belongs to the first group that ends at or after its own end
        return Alignment(a, b, a_ends, b_ends, np.searchsorted(both, a_ends), np.searchsorted(both, b_ends), len(both))


# A segment's share of a document: numbers of tokens (A, B) and of groups, its groups' ids, and the id pair (a << 32 | b) of
# each overlap link as the bytes of an array of longs
Block = tuple[int, int, int, str, bytes]


def segments(text: str) -> list[str]:
    """The text cut at single spaces between non-spaces, without them."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return _CUT.split(text)


class Blocks:
    """Blocks of segments, each after one space; None for one whose token bytes are not its text."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.known: dict[str, Block | None] = {}
        self.older: dict[str, Block | None] = {}

    def of(self, wanted: set[str]) -> dict[str, Block | None]:
        if len(self.known) > _SEGMENTS // 2:
            self.older, self.known = self.known, {}
        out, new = {}, []
        for s in wanted:
            if s in self.known:
                out[s] = self.known[s]
            elif s in self.older:
                out[s] = self.known[s] = self.older[s]
            else:
                new.append(s)
        for lo in range(0, len(new), _TOGETHER):
            made = self._made(new[lo:lo + _TOGETHER])
            out.update(made)
            self.known.update((s, x) for s, x in made.items() if len(s) <= 64)
        return out

    def _made(self, texts: list[str]) -> dict[str, Block | None]:
        """The blocks of many segments from one product of their block-diagonal matrices.

        Segments are encoded a few hundred at a time, joined by the single spaces that no token crosses; a run whose token
        bytes are not its text, or have no cut at every segment, is encoded segment by segment.
        """
        al = self.aligner
        out: dict[str, Block | None] = dict.fromkeys(texts)
        plain = [t for t in texts if t[:1] not in ("", " ") and t[-1] != " "]
        alone = [t for t in texts if t[:1] in ("", " ") or t[-1] == " "]
        runs = [plain[i:i + _JOINED] for i in range(0, len(plain), _JOINED)]
        good: list[str] = []
        ids: list[list[np.ndarray]] = [[], []]
        cuts: list[list[np.ndarray]] = [[], []]
        for step in (runs, None):
            if step is None:
                step = [[t] for t in alone]
            joined = [" ".join(r) for r in step]
            enc_a = [x.ids for x in al.a.encode_batch_fast([f" {t}" for t in joined], add_special_tokens=False)]
            enc_b = al.b.encode(joined, num_threads=1) if joined else []                 # it adds the first space itself
            for run, text, a, b in zip(step, joined, enc_a, enc_b):
                want = f" {text}".encode("utf-8")
                ends = np.cumsum([len(t.encode("utf-8")) + 1 for t in run])
                found = [self._cut(x, of, n, want, ends) for x, of, n in ((a, al.a_bytes, al.a_len), (b, al.b_bytes, al.b_len))]
                if None not in found:
                    good += run
                    for side, (x, cut) in enumerate(found):
                        ids[side].append(x)
                        cuts[side].append(np.diff(cut, prepend=0))
                elif len(run) > 1:
                    alone += run
        if not good:
            return out
        n_a, n_b = (np.concatenate(c) for c in cuts)
        whole = al.align(np.concatenate(ids[0]), np.concatenate(ids[1]))
        a_cut = np.cumsum(n_a)
        links = [(i, whole.a[i] << 32 | whole.b[j]) for i, j, _ in whole.overlap_links()]
        pairs = np.concatenate([p for _, p in links]).tobytes()
        link_cut = (8 * np.searchsorted(np.concatenate([i for i, _ in links]), a_cut)).tolist()
        group_cut = (whole.a_groups[a_cut - 1] + 1).tolist()                            # a segment ends a group
        groups, g, k, join = whole.group_texts(), 0, 0, ";".join
        for t, x, y, g_end, k_end in zip(good, n_a.tolist(), n_b.tolist(), group_cut, link_cut):
            out[t] = (x, y, g_end - g, groups[g] if g_end - g == 1 else join(groups[g:g_end]), pairs[k:k_end])
            g, k = g_end, k_end
        return out

    @staticmethod
    def _cut(ids: list[int], of: list[bytes], length: np.ndarray, want: bytes, ends: np.ndarray):
        """(ids, number of tokens up to each of the byte offsets ``ends``), or None if the tokens are not ``want`` or one
        lies across an offset."""
        if b"".join(map(of.__getitem__, ids)) != want:
            return None
        flat = np.array(ids, np.int64)
        at = np.cumsum(length[flat])
        cut = np.searchsorted(at, ends)
        return (flat, cut + 1) if (at[cut] == ends).all() else None


def link_pairs(packed: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a document's overlap links, and how many links each has."""
    pairs = np.sort(np.frombuffer(b"".join(packed), np.int64))
    head = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[head], np.diff(np.r_[head, len(pairs)])


def _cuts(texts: pa.Array) -> list[int]:
    """Ends of row ranges of about _CHARS bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    ends = np.flatnonzero(np.diff(size // _CHARS, prepend=0)) + 1
    return sorted({*ends.tolist(), len(texts)} - {0})


def document_links(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, nums): per row its counts, the digest of its groups, and its
    distinct id pairs with the number of their links."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "nums"]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(n, t) for n, t in zip(
        names, [field_type(docs, id_col), long, long, long, long, T.StringType(), longs, longs])])

    def run(batches):
        table = Blocks(Aligner(bpe_path, piece_path))
        for b in batches:
            lo = 0
            for hi in _cuts(b.column(1)):
                part = b.slice(lo, hi - lo)
                lo = hi
                split = [segments(t) if t else [] for t in part.column(1).to_pylist()]
                blocks = table.of({s for words in split for s in words})
                cols: list[list] = [[] for _ in names[1:]]
                for words in split:
                    own = [blocks[s] for s in words]
                    if not own or None in own:
                        row = (0, 0, 0, 0, "", [], [])
                    else:
                        n_a, n_b, n_groups, groups, packed = zip(*own)
                        pairs, nums = link_pairs(packed)
                        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
                        row = (sum(n_a), sum(n_b), sum(n_groups), int(nums.sum()), sha, pairs, nums)
                    for c, x in zip(cols, row):
                        c.append(x)
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols, kinds)], names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def pair_census(linked: DataFrame) -> DataFrame:
    """(pair, n): links of each id pair over all documents."""

    def run(batches):
        keys, nums, held = [], [], 0

        def table():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(nums), len(k)).astype(np.int64)
            return k, n

        for b in batches:
            keys.append(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            nums.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(keys[-1])
            if held > _FLUSH:
                k, n = table()
                keys, nums, held = [k], [n], len(k)
                if held > _FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])
                    keys, nums, held = [], [], 0
        if held:
            k, n = table()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])

    parts = linked.select("pairs", "nums").mapInArrow(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    count_sum adds up, over the links, how many links of all documents have the same id pair; n_best counts the links
    whose pair has the most of its b id, ties included.
    """
    spark = docs.sparkSession
    linked = document_links(docs, bpe_path, piece_path, id_col, text_col)
    linked = stored(linked.withColumn("uid", F.monotonically_increasing_id()), "align-docs")   # fixed once written
    census = stored(pair_census(linked), "align-census")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    top = census.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))           # one row per id of the vocabulary
    counts = census.withColumn("b", b_id).join(F.broadcast(top), "b").select("pair", "n", F.expr("n = top").alias("best"))
    counts = stored(counts, "align-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(HOT_PAIRS) > F.lit(total)
    hot = counts.where(is_hot).sort("pair").toPandas()
    held = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def look_up(batches):
        """Per document the sums over broadcast pairs, and the pairs left over."""
        pair, n, best = held.value
        for b in batches:
            size = np.diff(np.r_[0, np.cumsum([len(x) for x in b.column(1)])])
            key = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            num = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), size)
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            n_best, count = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            if known.any():
                i = at[known]
                np.add.at(count, doc[known], num[known] * n[i])
                np.add.at(n_best, doc[known], num[known] * best[i])
            rest = ~known
            ends = np.r_[0, np.cumsum(np.bincount(doc[rest], minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_best), pa.array(count),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(key[rest])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(num[rest]))], ["uid", "n_best", "count_sum", "pairs", "nums"])

    found = linked.select("uid", "pairs", "nums").mapInArrow(
        look_up, "uid long, n_best long, count_sum long, pairs array<long>, nums array<long>")
    found = stored(found, "align-found")
    cold = found.select("uid", F.explode(F.arrays_zip("pairs", "nums")).alias("x")).select("uid", "x.pairs", "x.nums")
    cold = (cold.join(counts.where(~is_hot).withColumnRenamed("pair", "pairs"), "pairs").groupBy("uid")
            .agg(F.sum(F.col("nums") * F.col("n")).alias("more"), F.sum(F.col("nums") * F.col("best").cast("long")).alias("more_best")))
    out = linked.drop("pairs", "nums").join(found.select("uid", "n_best", "count_sum"), "uid").join(cold, "uid", "left")
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", F.expr("n_best + coalesce(more_best, 0)").alias("n_best"),
                      F.expr("count_sum + coalesce(more, 0)").alias("count_sum"), "groups_sha256")
