"""SimHash near-duplicate groups: pigeonhole blocks, exact Hamming check, components.

Method.  A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  The 64 bits are
cut into ``BLOCKS`` blocks; two fingerprints that differ in at most d bits agree on at least BLOCKS - d blocks, so they
share a key for one choice of BLOCKS - d blocks.  Distinct fingerprints (copies are collapsed first, by an aggregate
with map-side combine) are dealt by (choice, key), and each bucket is verified by Hamming distance.

Scale.  The bits outside a key are at most 2 * 11 = 22, so a bucket can never hold more than 2**22 distinct
fingerprints, whatever the data.  Short runs compare neighbours directly; long runs (near copies of one text) look up
one-bit neighbours instead of comparing all pairs: f and g differ in at most two bits exactly if flipping at most one
bit in each gives the same value, so linking all owners of a flipped value to one of them loses no link and is linear.

Edge cases.  Null or empty text: no words, fingerprint zero, linked like any other.  Fewer words than the shingle
length: the whole sequence is one shingle.  Repeated rows stay as rows.  A null id stays a row and is never the
smallest id of a component unless all its ids are null.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, free_name, left_join_skewed, stored
from .components import connected_components

BLOCKS = 6
SEED = 42
_RUN = 16           # longer runs of a bucket are linked through one-bit neighbours
_PART = 1 << 21     # flipped values handled at a time within a long run


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle (repeats included); bytes.lower and bytes.split act on ASCII only."""
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    h64 = xxhash.xxh64_intdigest
    spans = zip((end - size)[: n - k + 1].tolist(), end[k - 1:].tolist())
    return np.fromiter((h64(flat[i:j], SEED) for i, j in spans), np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value whose bit is 1 where over half the hashes have it."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8), bitorder="little")
        count += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), k)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def block_choices(max_bits: int) -> list[tuple[int, list[int]]]:
    """(mask of the kept blocks, free bit numbers) for each choice of BLOCKS - max_bits blocks."""
    cut = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    out = []
    for kept in combinations(range(BLOCKS), BLOCKS - max_bits):
        bits = [b for i in kept for b in range(cut[i], cut[i + 1])]
        out.append((sum(1 << b for b in bits), sorted(set(range(64)) - set(bits))))
    return out


def _flip_links(fps: np.ndarray, free: list[int], max_bits: int):
    """Links within one long run, through values reached by flipping at most one free bit."""
    flips = np.array([0] + [1 << b for b in free], np.uint64)
    parts = max(1, len(fps) * len(flips) // _PART)
    for part in range(parts):
        keys, owner = [], []
        for f in flips:
            x = fps ^ f
            here = np.flatnonzero((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts) == part)
            keys.append(x[here])
            owner.append(fps[here])
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")        # the unflipped owner of a value, if any, comes first
        key, own = key[order], own[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = np.repeat(own[head], np.diff(np.r_[head, len(key)]))
        near = (first != own) & (np.bitwise_count(first ^ own) <= max_bits)
        yield first[near], own[near]


def _run_links(group: np.ndarray, fps: np.ndarray, frees: list[list[int]], choice: np.ndarray, max_bits: int):
    """Verified links among complete runs of equal ``group``."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[head, len(group)])
    run = np.repeat(size, size)
    short = run <= _RUN
    for shift in range(1, int(size[size <= _RUN].max(initial=1))):
        i = np.flatnonzero(short[:-shift] & (group[shift:] == group[:-shift]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= max_bits]
        yield fps[i], fps[i + shift]
    for h, n in zip(head[size > _RUN], size[size > _RUN]):
        yield from _flip_links(fps[h:h + n], frees[choice[h]], max_bits)


def simhash_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links among distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` (1 or 2) bits.
    Not every linked pair of a long run is listed, but its components are those of all links."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    choices = block_choices(max_bits)
    frees = [free for _, free in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in choices]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k"))
        for i, m in enumerate(signed)])).alias("x")).select("x.c", "x.k", "fp")
    dealt = keyed.repartition("c", "k").sortWithinPartitions("c", "k")

    def run(batches):
        held = None
        for b in batches:
            c, k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.view(np.uint64)
            if held is not None:
                c, k, f = np.r_[held[0], c], np.r_[held[1], k], np.r_[held[2], f]
            if not len(c):
                continue
            new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]
            last = int(np.flatnonzero(new)[-1])       # this run may go on in the next batch
            held = (c[last:], k[last:], f[last:])
            yield from out(np.cumsum(new)[:last], f[:last], c[:last])
        if held is not None:
            yield from out(np.zeros(len(held[0]), np.int64), held[2], held[0])

    def out(group, f, c):
        if len(group) > 1:
            for a, b in _run_links(group, f, frees, c, max_bits):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                   max_bits: int = 2) -> DataFrame:
    """(id, fp, component): every row with the smallest id reachable through links of at most ``max_bits`` bits."""
    prints = stored(simhash_fingerprints(docs, id_col, text_col, k), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-fp")
    roots = connected_components(simhash_links(distinct, max_bits)).withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = member.groupBy("root").agg(F.min("first").alias("component"))
    label = stored(member.join(low, "root").select("fp", "n", "component"), "simhash-label")
    total = prints.count()
    return left_join_skewed(prints, label, "fp", "n", total).select("id", "fp", "component")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id is the smallest of its component.  Rows of one id are one
    document: it goes if any of its texts belongs to an earlier id's group.  Rows with a null id stay."""
    groups = simhash_groups(docs, id_col, text_col, k, max_bits)
    name = free_name(docs, "gone")
    gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
