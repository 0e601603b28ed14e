import numpy as np
import pytest

from newsloom.operators import clusters, ksearch


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(5, 8)) * 4
    x = np.concatenate([c + rnd.normal(size=(40, 8)) for c in centres] + [np.zeros((3, 8)), np.repeat(centres[:1], 70, axis=0)])
    return spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "doc_id long, v array<double>").repartition(7), x


def plain_fit(x, seeds):
    c = seeds.copy()
    while True:
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() < 1e-9:
            return new, own
        c = new


def plain_silhouette(x, own):
    n = np.linalg.norm(x, axis=1)
    u = np.where(n[:, None] > 0, x / np.maximum(n, 1e-300)[:, None], 0)
    d = 1 - u @ u.T
    out = []
    for i in range(len(x)):
        mine = own == own[i]
        if mine.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)          # with the own distance of a zero vector, 1, as sums see it
        b = min(d[i, own == j].mean() for j in set(own.tolist()) - {own[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_shared_passes_equal_single_fits(blobs):
    df, x = blobs
    best, scores, models, vectors = ksearch.search_k(df, 2, 7)
    got = {r.k: r.silhouette for r in scores.collect()}
    seeds = ksearch.greedy_seeds(np.array(ksearch._seed_rows(vectors, ksearch.SEED_ROWS)), 7)
    for k in range(2, 8):
        centres, own = plain_fit(x, seeds[:k])
        assert np.allclose(models[k], centres, atol=1e-9)
        if k == 5:
            labels = {r.doc_id: r.cluster for r in ksearch.assign(vectors, models[k]).collect()}
            assert [labels[i] for i in range(len(x))] == own.tolist()
        nonzero = np.linalg.norm(x, axis=1) > 0
        assert got[k] == pytest.approx(plain_silhouette(x, own), abs=2e-2 if not nonzero.all() else 1e-9)
    assert best == max(got, key=lambda k: (got[k], -k))


def test_one_pass_per_iteration_for_all_models(blobs, monkeypatch):
    df, _ = blobs
    vectors = ksearch.slim_vectors(df)
    passes = []
    inner = ksearch._centre_sums
    monkeypatch.setattr(ksearch, "_centre_sums", lambda v, m, unit=False: passes.append(sorted(m)) or inner(v, m, unit))
    ksearch.fit_models(vectors, [2])
    alone = len(passes)
    passes.clear()
    ksearch.fit_models(vectors, list(range(2, 8)))
    assert passes[0] == [2, 3, 4, 5, 6, 7] and len(passes) >= alone
    assert all(set(b) <= set(a) for a, b in zip(passes, passes[1:]))      # models that stand still leave the passes


def test_few_rows_ties_and_empty(spark):
    schema = "doc_id long, v array<double>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)
    models = ksearch.fit_models(ksearch.slim_vectors(same), [2, 3])
    assert all(np.allclose(c, [1.0, 2.0]) for c in models.values())
    assert {r.cluster for r in ksearch.assign(ksearch.slim_vectors(same), models[3]).collect()} == {0}
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    best, scores = clusters.find_optimal_k(two, 2, 3)
    assert best == 2 and {r.k: r.silhouette for r in scores.collect()} == {2: 0.0, 3: 0.0}
    best, scores = clusters.find_optimal_k(spark.createDataFrame([], schema), 2, 3)
    assert best == 2 and scores.count() == 0


def test_a_pass_is_one_stage(spark, blobs):
    """Hundreds of passes make a fit: none may shuffle, plan an aggregate or answer more than a row a task."""
    vectors = ksearch.slim_vectors(blobs[0])
    blocks = ksearch.packed(vectors)
    assert sorted(np.frombuffer(r["x"]).tolist() for r in blocks.collect()) == sorted(r["v"] for r in vectors.collect())
    sc = spark.sparkContext
    sc.setJobGroup("one pass", "")
    try:
        ksearch._centre_sums(blocks, {3: blobs[1][:3], 5: blobs[1][:5]})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("one pass")
    assert [len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs] == [1]
    assert blocks.rdd.getNumPartitions() <= ksearch.TASKS * sc.defaultParallelism
