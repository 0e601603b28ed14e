import numpy as np
import pytest

from newsloom.operators import hierarchy


def brute(ids, x, size=5, m=None):
    """Labels by the textbook: dense distances, sorted edges one by one, recursive condensed tree."""
    m = m or size
    n = len(ids)
    if n < max(size, m):
        return {i: -1 for i in ids}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(np.maximum(core[:, None], core[None]), np.maximum(d, hierarchy.LEAST))
    first = {}
    for i in np.argsort(ids):
        first.setdefault(tuple(x[i]), i)
    edges = []
    for i in range(n):
        r = first[tuple(x[i])]
        if r != i:
            edges.append((max(core[r], hierarchy.LEAST), 0, ids[r], ids[i], r, i))
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            if ids[a] < ids[b]:
                edges.append((w[a, b], 1, ids[a], ids[b], a, b))
    node, members, kids, height = list(range(n)), {i: [i] for i in range(n)}, {}, {}

    def find(i):
        while node[i] != i:
            i = node[i]
        return i

    nxt = n
    for e in sorted(edges):
        a, b = find(e[4]), find(e[5])
        if a != b:
            node += [nxt]
            node[a] = node[b] = nxt
            members[nxt], kids[nxt], height[nxt] = members[a] + members[b], (a, b), e[0]
            nxt += 1
    root = nxt - 1
    clusters = {}                                  # id -> [parent, stability, rows]

    def descend(top, parent, birth):
        me, stable, at = len(clusters), 0.0, top
        clusters[me] = [parent, 0.0, members[top]]
        while True:
            a, b = kids[at]
            lam = 1 / height[at]
            big = [k for k in (a, b) if len(members[k]) >= size]
            if len(big) == 1:
                stable += (len(members[at]) - len(members[big[0]])) * (lam - birth)
                at = big[0]
                continue
            stable += len(members[at]) * (lam - birth)
            break
        clusters[me][1] = stable
        if len(big) == 2:
            for k in big:
                descend(k, me, lam)

    descend(root, None, 0.0)
    worth, stands = {}, {}
    for c in sorted(clusters, reverse=True):
        below = sum(worth[k] for k in clusters if clusters[k][0] == c)
        stands[c] = clusters[c][0] is not None and clusters[c][1] >= below
        worth[c] = max(clusters[c][1], below)
    label = {i: -1 for i in ids}
    for c in sorted(clusters):
        up = clusters[c][0]
        while up is not None and not stands[up]:
            up = clusters[up][0]
        if stands[c] and up is None:
            rows = [ids[i] for i in clusters[c][2]]
            label.update({i: min(rows) for i in rows})
    return label


def got(spark, ids, x, parts=4, **kw):
    df = spark.createDataFrame([(int(i), [float(t) for t in r]) for i, r in zip(ids, x)], "doc_id long, v array<double>").repartition(parts)
    return {r.doc_id: r.cluster for r in hierarchy.density_hierarchy(df, **kw).collect()}


def blobs(seed, sizes, spread, noise=20, dim=3):
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.normal(size=(n, dim)) * s + rnd.normal(size=dim) * 6 for n, s in zip(sizes, spread)]
                       + [rnd.uniform(-12, 12, size=(noise, dim))])
    return rnd.permutation(len(x)) * 3 + 1, x


@pytest.mark.parametrize("seed,size,m", [(1, 5, None), (2, 8, 3)])
def test_blobs_of_unlike_density_equal_the_textbook(spark, seed, size, m):
    ids, x = blobs(seed, [40, 25, 60, 12], [0.3, 1.0, 0.6, 0.1])
    want = brute(ids, x, size, m)
    assert len(set(want.values())) > 3
    assert got(spark, ids, x, min_cluster_size=size, min_samples=m) == want


def test_copies_ties_and_many_cells(spark, monkeypatch):
    ids, x = blobs(5, [30, 30], [0.4, 0.4], noise=10, dim=2)
    x = np.concatenate([x, np.repeat(x[:3], [30, 2, 7], axis=0), [[100.0 + i % 4, 100.0 + i // 4] for i in range(16)]])
    ids = np.concatenate([ids, 1000 + np.arange(len(x) - len(ids))])
    want = brute(ids, x)
    monkeypatch.setattr(hierarchy, "GROUP_ROWS", 16)
    assert got(spark, ids, x) == want


def test_chain_over_many_tasks(spark):
    x = np.cumsum(np.r_[np.linspace(1, 2, 60), np.full(3, 50.0), np.linspace(2, 1, 40)])[:, None]
    ids = np.arange(len(x))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, ids, x, min_cluster_size=6) == brute(ids, x, 6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_inputs(spark):
    assert got(spark, [1, 2], np.eye(2)) == {1: -1, 2: -1}
    same = np.ones((9, 2))
    assert got(spark, range(9), same) == brute(list(range(9)), same)
    empty = spark.createDataFrame([], "doc_id long, v array<double>")
    assert hierarchy.density_hierarchy(empty).count() == 0


def test_running_over_ranges(spark):
    rows = [(k, i, None if i % 4 else i) for k in (-1, 2, 7) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "key long, i long, x long").repartition(6)
        out = {(r.key, r.i): (r.before, r.after) for r in hierarchy.running(df, "key", ["i"], "x", "last").collect()}
        assert out == {(k, i): ((i - 1) // 4 * 4 if i else None, i // 4 * 4) for k, i, _ in rows}
        out = {(r.key, r.i): (r.before, r.after) for r in hierarchy.running(df, "key", ["i"], "x", "sum").collect()}
        total = [sum(j for j in range(0, i + 1, 4)) for i in range(40)]
        assert out == {(k, i): (total[i - 1] if i else None, total[i]) for k, i, _ in rows}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_search_that_skips_nothing_copies_no_row_per_cell(spark):
    """Directions without structure: every row would visit every cell."""
    rnd = np.random.default_rng(9)
    rows = [(i, r.tolist(), 1, float("inf")) for i, r in enumerate(rnd.normal(size=(600, 8)))]
    points = spark.createDataFrame(rows, "id long, v array<double>, mult long, bound double").cache()
    cells = hierarchy.Cells(points, 64)
    groups = cells.search(points, points, {}, lambda ask, seen, d: ask[["id"]].assign(n=len(seen)), "id long, n long")
    got = groups.groupBy("id").agg({"n": "sum", "*": "count"}).collect()
    assert len(got) == 600 and all(r["sum(n)"] == 600 and r["count(1)"] <= 2 * 64 ** 0.5 for r in got)


def test_nearest_rows_with_ties(spark):
    rows = [(i, [float(i % 5), float(i // 5 % 3)], 1, 0) for i in range(15)]
    points = spark.createDataFrame(rows, "id long, v array<double>, mult long, copy long").cache()
    x = np.array([r[1] for r in rows])
    for r in hierarchy.neighbours(points, hierarchy.Cells(points, 4), 4).collect():
        d = np.sqrt(((x - x[r["id"]]) ** 2).sum(1))
        assert [n["q"] for n in r["near"]] == sorted(range(15), key=lambda i: (d[i], i))[:4]


def caterpillar(spark, depth, seed=4):
    """A spine of joins with a leaf at each: (cluster, parent, stability) in merge order, and what is to be selected."""
    rnd = np.random.default_rng(seed)
    rows, up = [], None
    for c in range(2 * depth, 0, -2):
        rows += [(c, up, float(rnd.exponential(c))), (c - 1, c, float(rnd.exponential(20.0)))]
        up = c
    own, parent = {c: s for c, _, s in rows}, {c: p for c, p, _ in rows}
    kids, stands = dict.fromkeys(own, 0.0), {}
    for c in sorted(own):
        stands[c] = parent[c] is not None and own[c] >= kids[c]
        if parent[c] is not None:
            kids[parent[c]] += max(own[c], kids[c])
    want = {}
    for c in sorted(own, reverse=True):
        above = want.get(parent[c])
        want[c] = above if above is not None else c if stands[c] else None
    return spark.createDataFrame(rows, "cluster long, parent long, stability double").repartition(5), want


@pytest.mark.parametrize("block,tables", [(1 << 18, 4), (40, 60)])
def test_a_deep_tree_takes_no_round_a_level(spark, monkeypatch, block, tables):
    tree, want = caterpillar(spark, 150)
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    written, kept = [], hierarchy.kept
    monkeypatch.setattr(hierarchy, "kept", lambda df: written.append(1) or kept(df))
    assert {r.cluster: r.chosen for r in hierarchy.selected(tree).collect()} == want
    assert len(set(want.values())) > 3 and len(written) <= tables


def test_a_cluster_that_ends_where_it_began_has_no_stability(spark):
    """Equal weights: the sum of the parts must not fall below what it is compared with."""
    w = next(w for w in np.arange(0.1, 3, 0.01) if 5 / w + 1 / w + 1 / w < 7 * (1 / w))
    rows = [(1, 5, 0, 0, 1), (2, 6, 5, 1, 1), (3, 7, 6, 1, 1), (4, 5, 0, 0, 4)]
    rows = [(r, w, n, before, 1 if before else 0, None if not before else 1, c, None, None, None, None) for r, n, before, _, c in rows]
    rows.append((5, w, 12, 7, 2, 1, 5, 5, 4, None, None))
    edges = spark.createDataFrame([tuple(x if not isinstance(x, np.floating) else float(x) for x in r) for r in rows],
                                  "rank long, w double, n long, n_before long, big int, cluster_before long, cluster long, n1 long, c1 long, n2 long, c2 long")
    got = {r.cluster: (r.parent, r.stability) for r in hierarchy.cluster_tree(edges, 5).collect()}
    assert got == {1: (5, 0.0), 4: (5, 0.0), 5: (None, 12 * (1 / w))}


def test_a_pair_weighs_the_same_from_either_side():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    i, j = np.triu_indices(300, 1)
    one, other = hierarchy._measured(x, x, i, j), np.concatenate([hierarchy._measured(x, x, j[k:k + 1], i[k:k + 1]) for k in range(0, len(i), 97)])
    assert (one[::97] == other).all()
