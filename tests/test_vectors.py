"""Identities and edge rules of the vector operators (dup_chain, tiny_clusters, block join vs brute force)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import areas, clusters, curate, scoring, similarity


def unit(v):
    v = np.asarray(v, dtype=float)
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else v.tolist()


@pytest.fixture()
def rand_vecs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 4), unit(rng.normal(size=16))) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, cluster int, v array<double>"), rows


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_block_join_equals_brute_force(rand_vecs, blocks):
    df, rows = rand_vecs
    m = np.array([r[2] for r in rows])
    sims = m @ m.T
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sims[i, j] > 0.3}
    got = {(r.id_a, r.id_b) for r in similarity.cosine_pairs(df, 0.3, blocks=blocks).collect()}
    assert got == want


def test_ensemble_pairs_equal_mean_of_model_cosines(spark, rand_vecs):
    df, rows = rand_vecs
    m1 = np.array([r[2] for r in rows])
    m2 = np.array([unit(np.roll(r[2], 1) * np.arange(1, 17)) for r in rows])
    models = spark.createDataFrame([(i, "a", m1[i].tolist()) for i in range(len(rows))]
                                   + [(i, "b", m2[i].tolist()) for i in range(len(rows))], "doc_id long, model string, v array<double>")
    mean = (m1 @ m1.T + m2 @ m2.T) / 2
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if mean[i, j] > 0.25}
    got = {(r.id_a, r.id_b) for r in similarity.ensemble_pairs(models, 0.25, blocks=3).collect()}
    assert got == want


def test_novelty_equals_full_matrix(rand_vecs):
    df, rows = rand_vecs
    got = {r.doc_id: r.novelty_score for r in scoring.novelty_score(df, "cluster", "v", 16).collect()}
    m = np.array([r[2] for r in rows])
    lab = np.array([r[1] for r in rows])
    for i in range(len(rows)):
        idx = np.where(lab == lab[i])[0]
        assert got[i] == pytest.approx(1 - (m[idx] @ m[i]).mean(), abs=1e-12)


def test_near_duplicates_not_transitive_not_greedy(spark):
    # a~b, b~c, a!~c ; word counts a > b > c: b loses to a, c loses to b (b already dropped still knocks out c)
    rows = [(1, 30, [1.0, 0.0]), (2, 20, unit([1.0, 0.5])), (3, 10, unit([0.8, 1.0]))]
    df = spark.createDataFrame(rows, "doc_id long, word_count long, v array<double>")
    kept = {r.doc_id for r in curate.near_duplicates(df, 0.85).collect()}
    assert kept == {1}
    # equal word counts: the later one goes
    eq = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, [1.0, 0.0])], "doc_id long, word_count long, v array<double>")
    assert {r.doc_id for r in curate.near_duplicates(eq, 0.85).collect()} == {1}


def test_tiny_clusters_singleton_identical_zero(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, cluster int, v array<double>")
    nov = {r.doc_id: r.novelty_score for r in scoring.novelty_score(df, "cluster", "v", 2).collect()}
    assert nov[1] == pytest.approx(0.0) and nov[2] == pytest.approx(0.0) and nov[4] == pytest.approx(1.0)


def test_assign_area_tie_goes_to_first_profile(spark):
    docs = spark.createDataFrame([(1, [1.0, 1.0])], "doc_id long, v array<double>")
    prof = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0])], "ord int, area string, v array<double>")
    assert areas.assign_area(docs, prof).first().area == "A"


def test_predict_cluster_nearest_centre(spark):
    docs = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.1, 0.8])], "doc_id long, v array<double>")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, centroid array<double>")
    got = {r.doc_id: r.cluster for r in clusters.predict_cluster(docs, cents).collect()}
    assert got == {1: 0, 2: 1}


def test_density_clusters_core_border_noise(spark):
    # chain 1-2-3 (all core with min_pts=2), 4 border of 3 only if min_pts forbids it being core; 5 isolated
    rows = [(1, unit([1, 0.05])), (2, unit([1, 0.1])), (3, unit([1, 0.15])), (5, unit([-1, 1]))]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = {r.doc_id: r.cluster for r in clusters.density_clusters(df, 0.998, 2).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == -1  # chain 1-2-3 of core points (1 and 3 not neighbours)
    got = {r.doc_id: r.cluster for r in clusters.density_clusters(df, 0.998, 3).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 5: -1}  # only 2 is core; 1 and 3 are its border points


def test_silhouette_matches_definition(spark, rand_vecs):
    df, rows = rand_vecs
    s = clusters.silhouette_cosine(df)
    m = np.array([r[2] for r in rows])
    lab = np.array([r[1] for r in rows])
    d = 1 - m @ m.T
    vals = []
    for i in range(len(rows)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        vals.append((b - a) / max(a, b))
    assert s == pytest.approx(float(np.mean(vals)), abs=1e-9)


def test_kmeans_invariants_and_repeatability(spark, rand_vecs):
    df, rows = rand_vecs
    data = clusters.stable_input(df.select("doc_id", "v"))
    model, labels, cents = clusters.fit_kmeans(data, k=4)
    lab = {r.doc_id: r.cluster for r in labels.collect()}
    assert set(lab.values()) == {0, 1, 2, 3}
    nearest = {r.doc_id: r.cluster for r in clusters.predict_cluster(df.select("doc_id", "v"), cents).collect()}
    assert nearest == lab  # every row sits at its nearest centre
    _m2, labels2, _c2 = clusters.fit_kmeans(clusters.stable_input(df.select("doc_id", "v")), k=4)
    assert {r.doc_id: r.cluster for r in labels2.collect()} == lab  # same seed, same input order -> same fit
    inertia = clusters.kmeans_inertia(df.select("doc_id", "v").join(labels, "doc_id"), cents).first().inertia
    assert inertia == pytest.approx(model.summary.trainingCost, rel=1e-9)


def test_best_neighbour_rule_equals_pair_rule(spark, rand_vecs):
    df, rows = rand_vecs
    art = df.withColumn("word_count", (F.col("doc_id") * 7919 % 13).cast("long"))  # many ties on purpose
    wc = {r.doc_id: r.word_count for r in art.collect()}
    lost = {p.id_b if wc[p.id_a] >= wc[p.id_b] else p.id_a for p in similarity.cosine_pairs(art, 0.25, blocks=3).collect()}
    assert {r.doc_id for r in curate.near_duplicates(art, 0.25, blocks=3).collect()} == set(wc) - lost


@pytest.mark.parametrize("threshold,blocks,block_rows", [(0.9, 12, 64), (0.9, None, 64), (0.97, 40, 2048), (0.2, 7, 64), (-0.5, 5, 64)])
def test_pruned_join_loses_no_pair(spark, threshold, blocks, block_rows):
    rng = np.random.default_rng(5)
    centres = [unit(rng.normal(size=6)) for _ in range(15)]
    rows = [(i, unit(np.array(centres[i % 15]) + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.4]))) for i in range(400)]
    rows += [(400 + i, centres[0]) for i in range(200)] + [(700, [0.0] * 6), (701, [0.0] * 6)]
    m = np.array([r[1] for r in rows])
    sims = m @ m.T
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sims[i, j] > threshold + 1e-9}
    edge = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if abs(sims[i, j] - threshold) <= 1e-9}
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = [(r.id_a, r.id_b) for r in similarity.cosine_pairs(df, threshold, blocks=blocks, block_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) - edge == want


def test_far_cells_are_not_compared(spark):
    rng = np.random.default_rng(6)
    rows = [(i, unit(np.eye(8)[i % 8] + rng.normal(size=8) * 0.02)) for i in range(800)]
    df = spark.createDataFrame(rows, "_id long, _u array<double>")
    groups = similarity.candidate_groups(df, 0.9, {}, blocks=40)
    asked = groups.where("_side = 1").count()
    assert asked < 3 * 800 * 5      # without pruning each row would meet about half of 40 cells


def test_a_long_chain_is_one_density_cluster(spark):
    n = 260
    rows = [(i, [math.cos(i * 0.02), math.sin(i * 0.02)]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = {r.doc_id: r.cluster for r in clusters.density_clusters(df, math.cos(0.021), 2, blocks=30).collect()}
    assert got == {i: 0 for i in range(n)}


def test_zero_vectors_are_noise(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = {r.doc_id: r.cluster for r in clusters.density_clusters(df, 0.5, 3).collect()}
    assert got == {1: -1, 2: -1, 3: -1, 4: 4, 5: 4, 6: 4}


def test_width_mismatch_raises(spark):
    from newsloom.functions import vectors as VV
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0])], "cluster int, v array<double>")
    with pytest.raises(Exception, match="width"):
        VV.mean_vectors(df, ["cluster"], "v", dim=2).collect()


def test_copy_group_output_is_linear(spark):
    # a third of the rows are copies of one article: no pair list, one best-neighbour row per article
    n_copies, n_other = 300, 600
    rng = np.random.default_rng(3)
    rows = [(i, 100 + (i % 5), [1.0] + [0.0] * 15) for i in range(n_copies)]
    rows += [(n_copies + i, 50, unit(rng.normal(size=16))) for i in range(n_other)]
    df = spark.createDataFrame(rows, "doc_id long, word_count long, v array<double>")
    best = similarity.best_neighbours(df, 0.95, blocks=4)
    assert best.count() <= len(rows)
    kept = {r.doc_id for r in curate.near_duplicates(df, 0.95, blocks=4).collect()}
    assert 4 in kept and not any(i in kept for i in range(n_copies) if i != 4)  # most words, then earliest id


def _density_brute(rows, t, min_pts):
    ids = [r[0] for r in rows]
    m = np.array([unit(r[1]) for r in rows])
    sims = m @ m.T
    n = len(rows)
    nbr = [[j for j in range(n) if j != i and sims[i, j] > t] for i in range(n)]
    core = [len(nbr[i]) + 1 >= min_pts for i in range(n)]
    label = {i: ids[i] for i in range(n) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if core[i]:
                for j in nbr[i]:
                    if core[j] and label[j] < label[i]:
                        label[i] = label[j]
                        changed = True
    out = {}
    for i in range(n):
        if core[i]:
            out[ids[i]] = label[i]
        else:
            cand = [label[j] for j in nbr[i] if core[j]]
            out[ids[i]] = min(cand) if cand else -1
    return out


@pytest.mark.parametrize("min_pts", [2, 3, 5])
def test_density_clusters_with_copies_equals_brute_force(spark, min_pts):
    rng = np.random.default_rng(11)
    base = [unit(rng.normal(size=8)) for _ in range(40)]
    rows = [(i, base[i]) for i in range(40)]
    rows += [(100 + k, base[3]) for k in range(6)]   # a copy group of 7 (with id 3)
    rows += [(200 + k, base[10]) for k in range(2)]  # a small copy group of 3
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    got = {r.doc_id: r.cluster for r in clusters.density_clusters(df, 0.5, min_pts).collect()}
    assert got == _density_brute(rows, 0.5, min_pts)


def test_mean_vectors_wide_and_generic_forms_agree(rand_vecs):
    from newsloom.functions import vectors as VV
    df, _ = rand_vecs
    wide = {r.cluster: r.mean for r in VV.mean_vectors(df, ["cluster"], "v", dim=16).collect()}
    generic = {r.cluster: r.mean for r in VV.mean_vectors(df, ["cluster"], "v").collect()}
    assert wide.keys() == generic.keys()
    for k in wide:
        assert np.allclose(wide[k], generic[k], atol=1e-12)


def test_copies_are_decided_by_their_best_ranked_row(spark, rand_vecs):
    df, rows = rand_vecs
    art = df.withColumn("word_count", (F.col("doc_id") * 7919 % 13).cast("long")).select("doc_id", "v", "word_count")
    more = art.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("word_count", F.col("word_count") % 3)
    zero = spark.createDataFrame([(5000 + i, [0.0] * len(rows[0][2]), 4) for i in range(3)], "doc_id long, v array<double>, word_count long")
    every = art.unionByName(more).unionByName(zero)
    wc = {r.doc_id: r.word_count for r in every.collect()}
    for t in (0.25, 0.9):
        lost = {p.id_b if wc[p.id_a] >= wc[p.id_b] else p.id_a for p in similarity.cosine_pairs(every, t).collect()}
        assert {r.doc_id for r in curate.near_duplicates(every, t).collect()} == set(wc) - lost


def test_groups_grow_where_nothing_can_be_skipped(spark):
    """Directions without structure at a low threshold: copies of a row must not grow with n / block_rows, no pair is lost."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "_id long, _u array<double>")
    copies = similarity.candidate_groups(df, 0.3, {}, block_rows=64).count() / len(x)
    assert copies <= 2 * math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    got = {(r.id_a, r.id_b) for r in similarity.cosine_pairs(df, 0.3, "_id", "_u", block_rows=64).collect()}
    sims = np.triu(x @ x.T, 1)
    assert got == set(zip(*(a.tolist() for a in np.nonzero(sims > 0.3)))) and len(got) > 1000
