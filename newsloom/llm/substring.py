"""Removal of repeated word windows: suffixes partitioned by word prefixes, cut at the window and sorted by hash.

Method.  Every window of ``window`` consecutive words is a suffix cut at that depth.  Suffixes are grouped by a
variable-length word prefix: from a sample of suffixes the driver learns which prefixes are too frequent for one group
and must be extended by further words (one word, two, ... up to the full window); the group of a suffix is its
shortest prefix that is not extended, dealt into memory-sized parts.  Within a part the suffixes are sorted by the hash of
their first ``window`` words, so equal windows are neighbours.  No suffix tree is built: what is found are the nodes that a
tree would have at exactly that depth, which is all the removal needs.  All but the earliest occurrence (smallest document
id, then start) of such a window are repeats; words covered by one are removed.  The sample only balances groups; the result does not depend on it.

Paths are 64-bit hashes of word sequences, kept apart by part as well (the part comes from an independent prefix hash).

Scale.  Texts are read in chunks of about CHUNK_CHARS.  Within a chunk a path is sent once (its earliest occurrence),
the other occurrences are known repeats: a passage held by a third of all documents costs one entry per chunk.  An
entry is about ten bytes (path and offset), packed per chunk and part.  Repeats return as offsets per chunk, and the
texts are shuffled once, compressed, to meet them.  The number of parts grows with the corpus.

Edge cases.  Null or short texts have no window and keep all words.  Rows with equal id count as the same document:
equal rows never remove each other's words.  A null id is later than every id.  Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type

CHUNK_CHARS = 6_000_000      # text held by one task at a time (a longer document is a chunk of its own)
PART_WORDS = 2_000_000       # suffixes of one part
SAMPLE_DOCS = 2_000          # documents from which prefix frequencies are learnt
SAMPLE_SUFFIXES = 50         # suffixes taken of each
NO_ID = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def path_hashes(words: list[bytes], depths: list[int], seed: int = 0):
    """Yield (depth, hash of the next ``depth`` words at each position) for increasing depths; hashes that would run
    past the end are short by the missing words and must not be used."""
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in code), np.uint64, len(code))[ids]
    pad = np.zeros(max(depths), np.uint64)
    doubled, size = [h], 1                                  # hashes of 1, 2, 4, ... words
    power = [int(_MUL)]
    while size * 2 <= max(depths):
        doubled.append(doubled[-1] * np.uint64(power[-1]) + np.r_[doubled[-1][size:], pad[:size]])
        power.append(power[-1] * power[-1] % (1 << 64))
        size *= 2
    for depth in depths:
        out, at = None, 0
        for bit in reversed(range(len(doubled))):
            if depth >> bit & 1:
                part = np.r_[doubled[bit][at:], pad[:at]]
                out = part if out is None else out * np.uint64(power[bit]) + part
                at += 1 << bit
        yield depth, _mix(out + np.uint64(depth))


def prefix_depths(window: int) -> list[int]:
    return sorted({d for d in (1, 2, 3, 4, 6, 8, 12, 16) if d < window} | {window})


class Chunk:
    """Documents of one chunk in id order, with the flat list of their words."""

    def __init__(self, ids: list, texts: list):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        per_doc = [t.encode("utf-8").split() if t else [] for t in self.texts]
        self.size = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
        self.words = [w for words in per_doc for w in words]
        self.start = np.cumsum(self.size) - self.size
        mark = xxhash.xxh64()
        for i, t in zip(self.ids, self.texts):
            mark.update(f"{i}\n{'' if t is None else len(t)}\n{t}\n".encode("utf-8"))
        self.key = mark.intdigest() - (1 << 63)

    def window_starts(self, window: int) -> np.ndarray:
        n = np.maximum(0, self.size - window + 1)
        return np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def chunks(batches):
    """Cut a task's (id, text) batches into chunks; depends only on the order of the rows."""
    ids, texts, chars = [], [], 0
    for b in batches:
        for i, t in zip(*b.columns):
            ids.append(i.as_py())
            texts.append(t.as_py())
            chars += len(texts[-1] or "")
            if chars >= CHUNK_CHARS:
                yield Chunk(ids, texts)
                ids, texts, chars = [], [], 0
    if ids:
        yield Chunk(ids, texts)


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them; the first byte is the width."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def learn_prefixes(src: DataFrame, window: int, parts: int) -> list[np.ndarray]:
    """For each depth but the last the sorted hashes of prefixes that must be extended."""
    n = src.count()
    if not n:
        return [np.empty(0, np.uint64)] * (len(prefix_depths(window)) - 1)
    depths = prefix_depths(window)

    def run(batches):
        for c in chunks(batches):
            at = c.window_starts(window)
            at = at[_mix(at.astype(np.uint64)) % np.uint64(max(1, len(at) // (SAMPLE_SUFFIXES * len(c.ids)))) == 0] if len(at) else at
            if len(at):
                levels = np.stack([h[at] for _, h in path_hashes(c.words, depths, seed=1)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(levels), pa.list_(pa.int64()))], ["h"])

    sample = src.sample(min(1.0, SAMPLE_DOCS / n), seed=7).mapInArrow(run, "h array<long>").collect()
    out: list[np.ndarray] = []
    table = np.array([r["h"] for r in sample], np.int64).reshape(-1, len(depths)).view(np.uint64)
    limit = max(2, len(table) / (4 * parts))
    for level in range(len(depths) - 1):
        value, count = np.unique(table[:, level], return_counts=True)
        out.append(value[count > limit])
        table = table[np.isin(table[:, level], out[-1])]
    return out


def _parts_of(words, at, window, extended, parts) -> tuple[np.ndarray, np.ndarray]:
    """(part, path) of the suffixes that start at ``at``."""
    part = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for (depth, h), more in zip(path_hashes(words, prefix_depths(window), seed=1), [*extended, None]):
        own = h[at[open_]]
        stop = np.ones(len(open_), bool)
        if more is not None and len(more):
            stop = more[np.minimum(np.searchsorted(more, own), len(more) - 1)] != own
        part[open_[stop]] = (own[stop] % np.uint64(parts)).astype(np.int64)
        open_ = open_[~stop]
        if not len(open_):
            break
    (_, path), = path_hashes(words, [window], seed=2)
    return part, path[at]


def _send(src: DataFrame, window: int, parts: int, extended: list[np.ndarray]) -> DataFrame:
    """One row per chunk and part: paths, offsets, document table; one of a chunk's rows carries its known repeats."""

    def run(batches):
        for c in chunks(batches):
            at = c.window_starts(window)
            if not len(at):
                continue
            part, path = _parts_of(c.words, at, window, extended, parts)
            doc = np.searchsorted(c.start, at, side="right") - 1
            ids = np.array([NO_ID if i is None else i for i in c.ids], np.int64)
            pos = at - c.start[doc]
            if len(np.unique(ids)) == len(ids):
                order = np.argsort(path, kind="stable")        # offsets are in (id, start) order already
            else:
                order = np.lexsort((pos, ids[doc], path))
            head = np.r_[True, path[order][1:] != path[order][:-1]]
            first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            later = (ids[doc[order]] > ids[doc[first]]) | (pos[order] > pos[first]) & (ids[doc[order]] == ids[doc[first]])
            known = np.sort(at[order[later]])
            keep = np.sort(order[~later])                      # the earliest, and equal rows' twins
            keep = keep[np.argsort(part[keep], kind="stable")]
            cut = np.flatnonzero(np.r_[True, part[keep][1:] != part[keep][:-1]])
            for n, (lo, hi) in enumerate(zip(cut, np.r_[cut[1:], len(keep)])):
                k = keep[lo:hi]
                docs, count = np.unique(doc[k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[k[0]])], pa.int32()), pa.array([c.key], pa.int64()),
                     pa.array([path[k].astype("<u8").tobytes()], pa.binary()), pa.array([_pack(np.diff(at[k], prepend=0))], pa.binary()),
                     pa.array([ids[docs].astype("<i8").tobytes()], pa.binary()), pa.array([_pack(np.diff(c.start[docs], prepend=0))], pa.binary()),
                     pa.array([_pack(count)], pa.binary()), pa.array([_pack(np.diff(known, prepend=0)) if n == 0 else None], pa.binary())],
                    _SENT)

    return src.mapInArrow(run, "part int, chunk long, path binary, at binary, ids binary, start binary, count binary, known binary")


_SENT = ["part", "chunk", "path", "at", "ids", "start", "count", "known"]


def _subtree(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats of one part: sort its suffixes by path; every node of two or more keeps only the earliest."""
    path = np.concatenate([np.frombuffer(p, "<u8") for p in rows["path"]])
    at = [np.cumsum(_unpack(x)) for x in rows["at"]]
    count = [_unpack(x) for x in rows["count"]]
    ids = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), n) for i, n in zip(rows["ids"], count)])
    pos = np.concatenate([a - np.repeat(np.cumsum(_unpack(s)), n) for a, s, n in zip(at, rows["start"], count)])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    at = np.concatenate(at)
    order = np.argsort(path, kind="stable")
    p = path[order]
    node = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    size = np.diff(np.r_[node, len(p)])
    deep = np.repeat(size > 1, size)
    order, p = order[deep], p[deep]                            # leaves drop out
    order = order[np.lexsort((pos[order], ids[order], p))]
    p = path[order]
    head = np.r_[True, p[1:] != p[:-1]][:len(p)]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    late = order[(ids[order] != ids[first]) | (pos[order] != pos[first])]
    late = late[np.lexsort((at[late], owner[late]))]
    out = []
    for r, (lo, hi) in enumerate(zip(*(np.searchsorted(owner[late], np.arange(len(rows)), side=s) for s in ("left", "right")))):
        if hi > lo:
            out.append((rows["chunk"].iloc[r], _pack(np.diff(at[late[lo:hi]], prepend=0))))
    out += [(c, k) for c, k in zip(rows["chunk"], rows["known"]) if k is not None and len(k) > 1]
    return pd.DataFrame(out, columns=["chunk", "repeats"])


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: kept words joined by one space.  Ids are integers.

    The input is read twice and must give the same rows in the same order (a table does); a chunk that changed between
    the two reads is noticed and raises.
    """
    spark = docs.sparkSession
    kind = field_type(docs, id_col)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    chars = src.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (5 * PART_WORDS)))
    extended = learn_prefixes(src, window, parts)
    found = (_send(src, window, parts, extended).groupBy("part").applyInPandas(_subtree, "chunk long, repeats binary")
             .groupBy("chunk").agg(F.collect_list("repeats").alias("repeats")))

    def whole(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for c in chunks(batches):
            batch = pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.texts, pa.string())], ["id", "t"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([c.key], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             ["chunk", "data"])

    def cut(batches):
        for b in batches:
            for data, repeats in zip(*b.columns):
                if not data.is_valid:
                    raise RuntimeError("the documents changed between two reads")
                rows = pa.ipc.open_stream(data.as_py()).read_all()
                c = Chunk(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                edge = np.zeros(len(c.words) + window + 1, np.int64)
                for r in repeats.as_py() or ():
                    at = np.cumsum(_unpack(r))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                kept = np.cumsum(edge)[:len(c.words)] == 0
                for lo in range(0, len(c.ids), 500):
                    hi = min(lo + 500, len(c.ids))
                    texts, gone = [], []
                    for s, n in zip(c.start[lo:hi].tolist(), c.size[lo:hi].tolist()):
                        mask = kept[s:s + n]
                        gone.append(n - int(mask.sum()))
                        words = c.words[s:s + n]
                        texts.append(b" ".join([w for w, k in zip(words, mask.tolist()) if k] if gone[-1] else words).decode("utf-8"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.ids[lo:hi], pa.int64()), pa.array(c.size[lo:hi], pa.int64()), pa.array(gone, pa.int64()),
                         pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])

    joined = src.mapInArrow(whole, "chunk long, data binary").join(found, "chunk", "full").select("data", "repeats")
    out = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.withColumn("id", F.col("id").cast(kind)) if kind != T.LongType() else out
