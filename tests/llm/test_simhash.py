import random

import numpy as np
import xxhash

from newsloom.llm import queries, simhash
from newsloom.llm.components import connected_components
from tests.llm.conftest import DOCS, SF, edge_texts, rows


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_groups(prints, max_bits=2):
    """prints: list of (id, fingerprint) -> component per row, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def key(r):
    return tuple((x is None, x) for x in r)


def test_edge_documents(edge_docs):
    prints = [(i, brute_fingerprint(t)) for i, t in edge_texts()]
    want = sorted(((i, f, c) for (i, f), c in zip(prints, brute_groups(prints))), key=key)
    got = sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.simhash_groups(edge_docs).collect()), key=key)
    assert got == want


def test_query_equals_brute_force(spark):
    got = queries.op1_simhash_neardup(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_groups(prints)))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_long_runs_lose_no_link(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    fps = {centre}
    for _ in range(600):
        f = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    prints = [(i, f) for i, f in enumerate(sorted(fps))]
    for max_bits in (1, 2):
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in prints], "fp long")
        comp = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.simhash_links(df, max_bits)).collect()}
        want = brute_groups(prints, max_bits)
        groups, want_groups = {}, {}
        for (i, f), w in zip(prints, want):
            groups.setdefault(comp.get(f, f"alone{i}"), set()).add(i)
            want_groups.setdefault(w, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want_groups.values()))


def test_flip_links_match_all_pairs():
    rnd = random.Random(4)
    free = sorted(rnd.sample(range(64), 20))
    fps = np.array(sorted({sum(1 << b for b in free[:9] if rnd.random() < 0.5) for _ in range(200)}), np.uint64)
    linked = [(int(a), int(b)) for x, y in simhash._flip_links(fps, free, 2) for a, b in zip(x, y)]
    assert all((a ^ b).bit_count() <= 2 for a, b in linked)
    group = brute_groups([(int(f), int(f)) for f in fps])
    for part in {g: [int(f) for f, h in zip(fps, group) if h == g] for g in group}.values():
        seen, todo = {part[0]}, [part[0]]
        while todo:
            x = todo.pop()
            new = {b if a == x else a for a, b in linked if x in (a, b)} - seen
            seen |= new
            todo += new
        assert seen == set(part)


def test_a_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(None, 1), (5, 5)], "a long, b long")
    got = connected_components(links).collect()
    assert len(got) == 301 and {r["root"] for r in got} == {0}


def test_one_of_a_group_stays(spark, edge_docs, no_docs):
    kept = simhash.keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    prints = [(i, brute_fingerprint(t)) for i, t in edge_texts()]
    want = [i for (i, _), c in zip(prints, brute_groups(prints)) if i is None or i == c]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted(i or -1 for i in want)
    assert simhash.simhash_groups(no_docs).count() == 0
    one = spark.createDataFrame(rows([(1, "a")]), DOCS)
    assert [tuple(r)[::2] for r in simhash.simhash_groups(one).collect()] == [(1, 1)]
