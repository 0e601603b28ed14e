"""Prefix trie of conversations with subtree totals by depth-band rollup.

Method.  Every conversation is rebuilt (a shared head from its base conversation, then its own turns) and each of its
prefixes is named by a polynomial hash modulo 2**61 - 1 in two lanes, so equal prefixes are one trie node.  Subtree totals:
a node explodes only to its ancestors within its band of ``height`` depths; the totals of the bands' roots are the values of
a trie ``height`` times flatter, which is rolled up the same way; then the finished total of each band root is added to its
ancestors in the band above it.  A node explodes to at most ``height`` ancestors a level, and a trie of depth D takes
log(D) / log(height) levels down and as many up.

Scale.  Only 16 bytes and a word count of each turn are sorted.  The sort is by ranges of (conversation, turn, ...), so one
conversation may span many tasks: each task numbers and hashes its own rows, and the driver joins what the tasks say of
their first and last conversation (two rows a task).  Band paths are grouped by (conversation, band): height + 1 rows at
most.  Nodes are aggregates with map-side combine, so the root, or a first turn that a third of all conversations share,
costs one row a task; joins to a parent split hot parents off.  The members that end in one node are sorted by ranges too and
packed, so a digest reads few long strings in order.

Edge cases.  Null role or text: empty.  Null turns come first; rows of equal turn follow the digest of (role, text), so the
order of the input never matters; repeated rows are turns of their own.  Rows without a conversation id belong to no
conversation and make no node.  Extra columns are ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inner_join_skewed, left_join_skewed, stored

PRIME = (1 << 61) - 1
BASES = (1_099_511_628_211_003, 2_305_843_008_139_952_128 - 1_181)
HEIGHT = 8
HEAD_MAX = 3                # a conversation takes at most its first 3 turns from its base
_PACK = 1 << 16             # characters of a packed string of member ids
_ROWS = 20_000


class _Powers:
    """Powers of the two bases, grown as conversations get longer."""

    def __init__(self):
        self.of = [[1], [1]]

    def __call__(self, lane: int, n: int) -> int:
        table = self.of[lane]
        while len(table) <= n:
            table.append(table[-1] * BASES[lane] % PRIME)
        return table[n]


_LOCAL = "part int, edge boolean, conv long, pos long, p0 long, p1 long, q0 long, q1 long, w long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` (conv, turn, h, w) in order: position and prefix hash (p) within the task, and the hash before
    the row (q); then, as edge rows, length and hash of the task's first and last conversation."""
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h"), F.col("at")]
    dealt = turns.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, pos, p0, p1, first = None, 0, 0, 0, None
        for b in batches:
            out = []
            for c, h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if c != conv:
                    if first is None and conv is not None:
                        first = (part, True, conv, pos, p0, p1, 0, 0, 0)
                    conv, pos, p0, p1 = c, 0, 0, 0
                q0, q1 = p0, p1
                pos += 1
                p0 = (p0 * BASES[0] + int.from_bytes(h[:8], "big") % (PRIME - 1) + 1) % PRIME
                p1 = (p1 * BASES[1] + int.from_bytes(h[8:], "big") % (PRIME - 1) + 1) % PRIME
                out.append((part, False, c, pos, p0, p1, q0, q1, w))
            yield _batch(out, _LOCAL)
        ends = ([first] if first else []) + ([(part, True, conv, pos, p0, p1, 0, 0, 0)] if conv is not None else [])
        yield _batch(ends, _LOCAL)

    return dealt.select("conv", "h", "w").mapInArrow(run, _LOCAL)


def task_offsets(edges: list[tuple]) -> dict[int, tuple]:
    """part -> (conv, length, hashes) of what earlier parts hold of the conversation that starts in ``part``.

    ``edges``: (part, conv, length, p0, p1) of each part's first and last conversation, in order; two a part at most.
    """
    power, out, held = _Powers(), {}, None
    for part, conv, n, p0, p1 in edges:
        if held and held[0] == conv:
            out[part] = held
            p0, p1 = ((held[2 + i] * power(i, n) + p) % PRIME for i, p in enumerate((p0, p1)))
            n += held[1]
        held = (conv, n, p0, p1)
    return out


_PLACED = "conv long, pos long, p0 long, p1 long, q0 long, q1 long, w long"


def _placed(local: DataFrame, offsets: dict[int, tuple]) -> DataFrame:
    """Positions and hashes within whole conversations."""
    known = local.sparkSession.sparkContext.broadcast(offsets)

    def run(batches):
        power = _Powers()
        for b in batches:
            out = []
            for part, _, conv, pos, p0, p1, q0, q1, w in zip(*(c.to_pylist() for c in b.columns)):
                held = known.value.get(part)
                if held and held[0] == conv:
                    p0, q0 = ((held[2] * power(0, n) + x) % PRIME for n, x in ((pos, p0), (pos - 1, q0)))
                    p1, q1 = ((held[3] * power(1, n) + x) % PRIME for n, x in ((pos, p1), (pos - 1, q1)))
                    pos += held[1]
                out.append((conv, pos, p0, p1, q0, q1, w))
            yield _batch(out, _PLACED)

    return local.where("not edge").mapInArrow(run, _PLACED)


_MEMBER = "conv long, depth long, k0 long, k1 long, u0 long, u1 long, w long, last boolean"


def members(conversations: DataFrame, family: int = 20, heads: int = HEAD_MAX + 1, conv_col: str = "conv_id",
            turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, k0, k1, u0, u1, w, last): every prefix of every rebuilt conversation, with its key k, the key u of the
    prefix one turn shorter, the words of its last text, and whether it is the whole conversation.

    Conversation c takes its first crc32(c) % heads turns from conversation c - c % family.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("h"),
                                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")).where("conv is not null")
    local = stored(_numbered(turns), "trie-turns")
    edges = local.where("edge").select("part", "conv", "pos", "p0", "p1").collect()                # two a task at most
    # of a part's two rows the one that goes on from the part before comes first
    edges = sorted(map(tuple, edges), key=lambda e: (e[0], e[1]))
    placed = stored(_placed(local, task_offsets(edges)), "trie-placed")

    start = [F.max(F.when(F.col("pos") == i, F.struct("p0", "p1", "w"))).alias(f"s{i}") for i in range(1, heads)]
    zero = F.expr("named_struct('p0', 0L, 'p1', 0L, 'w', 0L)")
    info = placed.groupBy("conv").agg(F.max("pos").alias("n"), *start)
    info = info.select("conv", "n", F.array(zero, *[f"s{i}" for i in range(1, heads)]).alias("s"))   # s[i]: after i turns
    info = stored(info, "trie-info")
    base = info.where(f"conv % {family} = 0").select(F.col("conv").alias("base"), F.col("n").alias("bn"), F.col("s").alias("bs"))
    plan = info.withColumn("base", F.expr(f"conv - conv % {family}")).join(base, "base", "left")
    plan = plan.withColumn("h", F.expr(f"crc32(cast(conv as string)) % {heads}"))
    plan = plan.withColumn("pre", F.least("h", F.coalesce("bn", F.lit(0))).cast("int"))
    plan = plan.withColumn("own", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = plan.withColumn("bs", F.coalesce("bs", F.array(zero)))
    shift = [F.expr(f"(bs[pre].p{i} - s[cast(h as int)].p{i} + {PRIME}L) % {PRIME}L").alias(f"d{i}") for i in (0, 1)]
    plan = stored(plan.select("conv", "n", "h", "pre", "own", "bs", *shift), "trie-plan")

    head = plan.select("conv", "pre", "own", "bs", F.explode(F.sequence(F.lit(0), "pre")).alias("i"))
    at, up = F.col("bs")[F.col("i")], F.col("bs")[F.greatest(F.col("i") - 1, F.lit(0))]
    head = head.select("conv", F.col("i").cast("long").alias("depth"), at["p0"].alias("k0"), at["p1"].alias("k1"),
                       up["p0"].alias("u0"), up["p1"].alias("u1"), at["w"].alias("w"), F.expr("i = pre and own = 0").alias("last"))
    rows = inner_join_skewed(placed, plan.select("conv", "n", "h", "pre", "own", "d0", "d1"), "conv", "n", placed.count())
    rows = rows.where("pos > h").select("conv", F.expr("pos - h").alias("i"), "pre", "own", "p0", "p1", "q0", "q1", "d0", "d1", "w")

    def run(batches):
        power = _Powers()
        for b in batches:
            out = []
            for conv, i, pre, own, p0, p1, q0, q1, d0, d1, w in zip(*(c.to_pylist() for c in b.columns)):
                out.append((conv, pre + i, (p0 + d0 * power(0, i)) % PRIME, (p1 + d1 * power(1, i)) % PRIME,
                            (q0 + d0 * power(0, i - 1)) % PRIME, (q1 + d1 * power(1, i - 1)) % PRIME, w, i == own))
            yield _batch(out, _MEMBER)

    return head.unionByName(rows.mapInArrow(run, _MEMBER))


def band_paths(prefixes: DataFrame, step: int, height: int) -> DataFrame:
    """One row per node and band: ``prefixes`` (conv, depth, k, ...) of depths that ``step`` divides are cut into bands of
    ``height`` such depths; ``path`` holds the keys of the node's ancestors in the band, itself included.  A band's root
    comes a second time, as a tail of the band above, with that whole band as its path."""
    level = prefixes.where(F.col("depth") % step == 0).withColumn("e", F.expr(f"depth div {step}"))
    bands = F.expr(f"if(e % {height} = 0 and e > 0, array(e div {height}, e div {height} - 1), array(e div {height}))")
    grouped = (level.select("*", F.explode(bands).alias("band")).groupBy("conv", "band")
               .agg(F.sort_array(F.collect_list(F.struct("e", *[c for c in level.columns if c not in ("e", "conv")]))).alias("all")))
    each = grouped.select("conv", "band", F.transform("all", lambda x: x["k"]).alias("keys"), F.posexplode("all").alias("i", "x"))
    tail = F.expr(f"x.e = (band + 1) * {height}")
    return each.select("conv", "x.*", tail.alias("tail"), F.expr(f"slice(keys, 1, least(i + 1, {height}))").alias("path"))


def _rollup(values: DataFrame, inside: DataFrame, prefixes: DataFrame, step: int, height: int, deepest: int) -> DataFrame:
    """(k, depth, leaves, saved) of whole subtrees.  ``values``: each node's own; ``inside``: (k, path) within the band."""
    total = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    moved = inside.join(values, "k").select(F.explode("path").alias("k"), "leaves", "saved").groupBy("k").agg(*total)
    band = stored(values.select("k", "depth").join(moved, "k"), "trie-band")
    if deepest // step < height:
        return band
    roots = band.where(F.col("depth") % (step * height) == 0)
    paths = stored(band_paths(prefixes, step * height, height).groupBy("k", "tail").agg(F.first("path").alias("path")), "trie-path")
    done = _rollup(roots, paths.where("not tail"), prefixes, step * height, height, deepest)
    below = done.where("depth > 0").select("k", "leaves", "saved")
    tails = band_paths(prefixes, step, height).where("tail").groupBy("k").agg(F.first("path").alias("path"))
    added = (tails.join(below, "k").select(F.explode("path").alias("k"), "leaves", "saved").groupBy("k")
             .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    whole = band.join(added, "k", "left")
    return stored(whole.select("k", "depth", F.expr("leaves + coalesce(more_leaves, 0)").alias("leaves"),
                               F.expr("saved + coalesce(more_saved, 0)").alias("saved")), "trie-whole")


_PIECE = "k0 long, k1 long, part int, no int, piece string, sha string"


def member_digests(ends: DataFrame) -> DataFrame:
    """(k, sha): SHA-256 of each node's members (conv), decimal, ascending and comma-joined.

    Nodes within one range of the sort are finished there; what a range begins or ends with is packed into strings, and
    the strings of a node are read in order.
    """
    dealt = ends.select("k0", "k1", "conv").repartitionByRange("k0", "k1", "conv").sortWithinPartitions("k0", "k1", "conv")

    def run(batches):
        part, key, ids, no, size, first, out = TaskContext.get().partitionId(), None, [], 0, 0, True, []
        open_run = False            # the node's ids are passed on as pieces

        def piece():
            return (*key, part, no, ",".join(ids), None)

        for b in batches:
            for k0, k1, c in zip(*(x.to_pylist() for x in b.columns)):
                if (k0, k1) != key:
                    if key is not None:
                        out.append(piece() if first or open_run else (*key, part, 0, None, _sha(",".join(ids))))
                        first = False
                    key, ids, no, size, open_run = (k0, k1), [], 0, 0, False
                ids.append(str(c))
                size += len(ids[-1]) + 1
                if size > _PACK:
                    out.append(piece())
                    ids, no, size, open_run = [], no + 1, 0, True
                if len(out) >= _ROWS:
                    yield _batch(out, _PIECE)
                    out = []
        if key is not None:
            out.append(piece())
        yield _batch(out, _PIECE)

    made = stored(dealt.mapInArrow(run, _PIECE), "trie-pieces")
    by = ["k0", "k1", "part", "no"]
    pieces = made.where("sha is null and piece != ''").repartition("k0", "k1").sortWithinPartitions(*by)

    def join(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k0, k1, text in zip(*(x.to_pylist() for x in b.columns)):
                if (k0, k1) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k0, k1), hashlib.sha256()
                sha.update(text.encode())
            yield _batch(out, "k0 long, k1 long, sha string")
        if key is not None:
            yield _batch([(*key, sha.hexdigest())], "k0 long, k1 long, sha string")

    joined = pieces.select("k0", "k1", "piece").mapInArrow(join, "k0 long, k1 long, sha string")
    done = made.where("sha is not null").select("k0", "k1", "sha").unionByName(joined)
    return done.select(F.struct("k0", "k1").alias("k"), "sha")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prefix_trie(conversations: DataFrame, height: int = HEIGHT, **settings) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (words that members but the first repeat, over the subtree) and ends_sha256 (members that end there)."""
    if height < 2:
        raise ValueError("height must be at least 2")
    flat = stored(members(conversations, **settings), "trie-members")
    key, up = F.struct("k0", "k1").alias("k"), F.struct("u0", "u1").alias("u")
    paths = band_paths(flat.select("conv", "depth", key, up, "w"), 1, height).where("not tail")
    nodes = paths.groupBy("k").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"),
                                   F.max("u").alias("u"), F.max("w").alias("w"), F.first("path").alias("path"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("u").alias("k")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "k", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes, "trie-nodes")
    own = nodes.select("k", "depth", F.expr("cast(n_children = 0 as long)").alias("leaves"), F.expr("(n_convs - 1) * w").alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    whole = _rollup(own, nodes.select("k", "path"), flat.select("conv", "depth", key), 1, height, deepest)
    rows = nodes.drop("path", "w").join(whole.drop("depth"), "k").join(member_digests(flat.where("last")), "k", "left")
    rows = stored(rows, "trie-rows")
    parents = nodes.where("n_children > 0").select(F.col("k").alias("u"), F.col("conv_id").alias("parent"), "n_children")
    named = left_join_skewed(rows.withColumnRenamed("n_children", "children"), parents, "u", "n_children", rows.count())
    return named.select("conv_id", "depth", F.expr("if(depth = 0, null, parent)").alias("parent_conv_id"), "n_convs",
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
