"""Document fingerprints as Merkle trees over sections, paragraphs and pieces.

Method.  A text is cut into pieces at every line end and where a hash of the last eight bytes says so (content-defined,
so an insertion moves only the cuts beside it; finer near the start, so short texts have enough pieces); pieces make paragraphs (lines), paragraphs make sections (which end at
an empty line or, content-defined again, after about eight paragraphs), sections make the root.  Every node's hash
covers its children's.  Equal roots mean equal texts; where roots differ, only branches with differing hashes are
descended, which locates the edit and gives the likeness: twice the characters in equal branches over all characters.

The fingerprint is the tree written out: root, then per section its hash and paragraphs, per paragraph its hash and
pieces (hash and length); it can be compared and diffed without the text.

Scale.  ``neighbour_report`` compares each document with the next one in descending id order without a global sort in
one task: ids are cut at approximate quantiles into parts of as many ids each, about PART_CHARS of text on average, each part's first document is
also sent to the part before it, and each part is handled on its own.  Texts are shuffled once, compressed.

Edge cases.  Null text counts as empty; empty texts have the empty tree, alike to each other (1.0) and to nothing else
(0.0).  Rows of equal id follow each other in text order; null ids come last.  A lone row is its own neighbour.  Ids
are integers.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, sha256_hex

PART_CHARS = 16_000_000
CHUNK_CHARS = 6_000_000
MAX_PIECE = 512
FINE = ((256, 3, 4), (1024, 4, 8))      # up to this byte: cuts where so many hash bits are zero, least piece
COARSE = (6, 16)                        # beyond
SECTION_BITS = 3
NO_ID = np.iinfo(np.int64).min
_MUL = np.uint64(0x9E3779B97F4A7C15)

Node = tuple[int, int, list]        # hash, characters, children


def _cuts(raw: bytes) -> list[int]:
    """Ends of the pieces of ``raw`` (UTF-8), between characters only."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    inner = np.empty(0, np.int64)
    if n > 8:
        window = np.ndarray((n - 7,), "<u8", raw, strides=(1,)) * _MUL
        cut = window >> np.uint64(64 - COARSE[0]) == 0
        for upto, bits, _ in reversed(FINE):
            cut[:upto] = window[:upto] >> np.uint64(64 - bits) == 0
        inner = np.flatnonzero(cut) + 8
        inner = inner[inner < n]
        inner = inner[(data[inner] & 0xC0) != 0x80]
    lines = np.flatnonzero(data == 10) + 1
    ends, last = [], 0
    line_ends = set(lines.tolist())
    for at in [*np.union1d(inner, lines).tolist(), n]:
        while at - last > MAX_PIECE:
            last += MAX_PIECE
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        least = next((m for upto, _, m in FINE if at <= upto), COARSE[1])
        if at > last and (at in line_ends or at == n or at - last >= least):
            ends.append(at)
            last = at
    return ends


def _parent(children: list[Node], hashes: list[int]) -> Node:
    body = b"".join([h.to_bytes(8, "big") for h in hashes])
    return xxhash.xxh64_intdigest(body, len(children)), sum(c[1] for c in children), children


def tree(text: str | None) -> tuple[str, list[Node]]:
    """(root, sections) of a text.  Parents cover 64-bit piece hashes, of which the tree shows 32 bits."""
    raw = (text or "").encode("utf-8")
    ascii_only = len(raw) == len(text or "")
    sections, paragraphs, pieces, hashes, last = [], [], [], [], 0
    for end in _cuts(raw):
        part = raw[last:end]
        hashes.append(xxhash.xxh64_intdigest(part))
        pieces.append((hashes[-1] & 0xFFFFFFFF, len(part) if ascii_only else len(part.decode("utf-8")), []))
        if end == len(raw) or part.endswith(b"\n"):
            paragraphs.append(_parent(pieces, hashes))
            pieces, hashes = [], []
            if paragraphs[-1][0] % (1 << SECTION_BITS) == 0 or part == b"\n":
                sections.append(_parent(paragraphs, [p[0] for p in paragraphs]))
                paragraphs = []
        last = end
    if paragraphs:
        sections.append(_parent(paragraphs, [p[0] for p in paragraphs]))
    root = hashlib.blake2b(b"".join(s[0].to_bytes(8, "big") for s in sections), digest_size=16).hexdigest()
    return root, sections


def encode(t: tuple[str, list[Node]]) -> str:
    """root|section;section...  section: hash=paragraph,paragraph...  paragraph: hash:piece.piece...  piece: eight digits of hash, length (hexadecimal)"""
    return t[0] + "|" + ";".join(
        f"{s:016x}=" + ",".join(f"{p:016x}:" + ".".join(f"{h:08x}{n:x}" for h, n, _ in pieces) for p, _, pieces in paragraphs)
        for s, _, paragraphs in t[1])


def parse(fingerprint: str) -> tuple[str, list[Node]]:
    root, _, body = fingerprint.partition("|")
    sections = []
    for s in body.split(";") if body else []:
        h, _, rest = s.partition("=")
        paragraphs = []
        for p in rest.split(","):
            ph, _, leaves = p.partition(":")
            pieces = [(int(x[:8], 16), int(x[8:], 16), []) for x in leaves.split(".")]
            paragraphs.append((int(ph, 16), sum(x[1] for x in pieces), pieces))
        sections.append((int(h, 16), sum(x[1] for x in paragraphs), paragraphs))
    return root, sections


def _shared(a: list[Node], b: list[Node]) -> int:
    """Characters in branches that both sides hold; only branches that differ are descended."""
    there = Counter((h, n) for h, n, _ in b)
    both, left = 0, []
    for h, n, children in a:
        if there[h, n] > 0:
            there[h, n] -= 1
            both += n
        else:
            left += children
    if left:
        rest = []
        for h, n, children in b:
            if there[h, n] > 0:
                there[h, n] -= 1
                rest += children
        if rest:
            both += _shared(left, rest)
    return both


def likeness(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> float:
    """1.0 for equal roots, else twice the shared characters over all characters."""
    if a[0] == b[0]:
        return 1.0
    total = sum(n for _, n, _ in a[1]) + sum(n for _, n, _ in b[1])
    return min(1.0, 2.0 * _shared(a[1], b[1]) / total) if total else 1.0


def edited_spans(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> list[tuple[int, int]]:
    """Character spans of ``a`` whose pieces have no counterpart in ``b``: where the texts differ."""
    there = Counter((h, n) for _, _, ps in b[1] for _, _, pieces in ps for h, n, _ in pieces)
    spans: list[tuple[int, int]] = []
    at = 0
    for _, _, paragraphs in a[1]:
        for _, _, pieces in paragraphs:
            for h, n, _ in pieces:
                if there[h, n] > 0:
                    there[h, n] -= 1
                elif spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + n)
                else:
                    spans.append((at, at + n))
                at += n
    return spans


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for every row."""
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("n_chars", T.LongType()),
                           T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()),
                                              pa.array([encode(tree(t)) for t in texts], pa.string())], [f.name for f in schema])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _part(ids: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Part 0 holds the largest ids."""
    return len(splits) - np.searchsorted(splits, ids, side="left")


def _pack(ids: list, texts: list, heads: list) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(heads, pa.bool_())], ["id", "t", "head"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def neighbour_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row: the row, its
    edit (see ``edit``) with the next row in descending id order, and the likenesses."""
    spark = docs.sparkSession
    kind = field_type(docs, id_col)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    chars = src.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    at = [i / parts for i in range(1, parts)] or [0.5]
    cut = src.agg(F.percentile_approx("id", at, max(10_000, 20 * parts)).alias("q")).first()["q"] or []
    splits = np.unique(np.array(cut, np.int64))

    def tops(batches):
        for b in batches:
            ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            part = _part(ids, splits)
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([ids[part == p].max()], pa.int64())], ["part", "top"])

    # one number per part reaches the driver: the id its first document has
    top = src.select("id").mapInArrow(tops, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect()
    first = sorted((r["part"], r["top"]) for r in top)
    before: dict[int, list[int]] = {}                # id -> parts that end where it begins
    for (part, _), (_, head) in zip(first, first[1:] + first[:1]):
        before.setdefault(head, []).append(part)

    def send(batches):
        held: dict[int, tuple[list, list, list]] = {}
        size = 0
        for b in batches:
            ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            for p, i, t in zip(_part(ids, splits).tolist(), ids.tolist(), b.column(1)):
                text = t.as_py() or ""
                for q, head in [(p, False), *((q, True) for q in before.get(i, ()))]:
                    box = held.setdefault(q, ([], [], []))
                    box[0].append(i)
                    box[1].append(text)
                    box[2].append(head)
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_pack(*x) for x in held.values()], pa.binary())],
                                          ["part", "data"])

    def report(rows: pd.DataFrame) -> pd.DataFrame:
        table = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in rows["data"]])
        docs_, heads = [], []
        for i, t, head in zip(*(c.to_pylist() for c in table.columns)):
            (heads if head else docs_).append((i, t))
        docs_.sort(key=lambda r: (-r[0], r[1]))
        after = min(heads, key=lambda r: r[1])[1]
        trees = tree(after)
        done = []
        for i, text in reversed(docs_):              # each row needs the one after it
            own, changed = tree(text), edit(text, after)
            edited = tree(changed)
            done.append((None if i == NO_ID else i, len(text), sha256_hex(changed), encode(own), encode(edited),
                         likeness(own, edited), likeness(own, trees)))
            after, trees = text, own
        return pd.DataFrame(done, columns=names).astype({"id": "Int64"})

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    result = src.mapInArrow(send, "part int, data binary").groupBy("part").applyInPandas(
        report, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return result.withColumn("id", F.col("id").cast(kind)) if kind != T.LongType() else result
