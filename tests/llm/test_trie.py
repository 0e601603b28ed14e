import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from newsloom.llm import queries, trie
from tests.llm.conftest import SF

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()),
    ("k", T.StringType()), ("conv", T.LongType()), ("depth", T.StringType()), ("w", T.LongType())]])


def brute(rows):
    """rows of (conv_id, turn, role, text) -> rows of the trie, by whole prefixes."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t), digest, (r, x)))
    own = {c: [p for *_, p in sorted(v)] for c, v in own.items()}
    whole, member = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            member.setdefault(tuple(whole[c][:d]), []).append(c)
    kids, leaves, saved, ends = {}, {}, {}, {}
    for p in sorted(member, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(member[p]) - 1) * words
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    for c, p in whole.items():
        ends.setdefault(tuple(p), []).append(c)
    return sorted((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in member.items())


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()))


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(parts)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize("height", [2, 3, 8])
def test_edge_rows_and_deep_tries(spark, height):
    rnd = random.Random(height)
    rows = [(0, 2, None, "b  c"), (0, None, "user", None), (0, 1, "", "a\x0bd"), (0, 1, "user", "a"), (0, 1, "user", "a"),
            (None, 1, "user", "lost"), (-5, 1, "user", "neg"), (-5, 2, "user", "two"), (1, 1, "ab", "c"), (2, 1, "a", "bc"),
            (20, 1, "x", "y"), (23, 1, "x", "y"), (45, 9, "only", "own")]
    for c in (60, 61, 65, 80, 81):                      # long ones that share long prefixes
        rows += [(c, t, "user", f"turn {t} " * (1 + t % 3)) for t in range(40 + c % 7)]
    for c in range(100, 200):                           # a bushy, mostly shared trie
        rows += [(c, t, "user", rnd.choice("ab")) for t in range(rnd.randint(1, 12))]
    assert got(trie.prefix_trie(frame(spark, rows), height=height)) == brute(rows)


def test_one_conversation_over_many_tasks_and_many_equal_ones(spark):
    rows = [(7, t // 3, "user", f"{t % 5} word") for t in range(900)]
    rows += [(c, t, "user", "the same") for c in range(1000, 1700) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(trie.prefix_trie(frame(spark, rows, 9))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert trie.prefix_trie(frame(spark, [], 1)).count() == 0


def test_offsets_join_what_tasks_saw():
    p = [trie._Powers()(0, n) for n in range(9)]
    edges = [(0, 4, 3, 10, 20), (1, 4, 2, 30, 40), (2, 4, 1, 50, 60), (2, 9, 5, 70, 80), (3, 11, 1, 1, 1)]
    out = trie.task_offsets(edges)
    assert set(out) == {1, 2} and out[1] == (4, 3, 10, 20)
    assert out[2][:3] == (4, 5, (10 * p[2] + 30) % trie.PRIME)
