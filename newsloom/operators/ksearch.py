"""Euclidean k-means for many values of k in shared passes over the vectors (F4, and F1 for a single k).

One Arrow pass per iteration assigns every row under all models that still move and returns, per task, the vector sum and
count of each centre; the driver adds them up.  It receives one row a task (sum of all k, times the width), of at most
``TASKS`` times the cores tasks, whatever the number of rows.  A fit may take hundreds of iterations, so a pass is a single
stage with a plan of one step over packed rows (a vector's doubles as one binary value).  A sweep over k = 4..12 so costs as many passes as its slowest model, not the sum over nine models.  The cosine
silhouettes of all models take two more passes: unit-vector sums per cluster, then each row's score from those sums
(the mean distance to a cluster is one minus the product with its mean unit vector), so no pair is ever formed.

The fit is deterministic: seeds are picked greedily (each one lowers the summed squared distance the most) among the
``SEED_ROWS`` rows with the smallest MD5 of their id, a documented bound of the driver's work; all models share the
order of seeds.  Rows go to the nearest centre, ties to the lower number; an empty cluster keeps its centre; a model is
done when no centre moves by more than TOLERANCE, a fixed point up to rounding.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

SEED_ROWS = 256
TOLERANCE = 1e-9
MAX_ITER = 300
TASKS = 4
_ROWS = 4096


def slim_vectors(df: DataFrame, id_col: str = "doc_id", vec: str = "v") -> DataFrame:
    """(id, v) stored once in the shared checkpoint folder: every pass reads only this."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).checkpoint()


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; all must have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest(x: np.ndarray, sq: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (sq[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]).argmin(axis=1)


def greedy_seeds(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows of x, in the order in which each lowers the summed squared distance the most; ties: the first row."""
    d2 = np.stack([((x - row) ** 2).sum(axis=1) for row in x]) if len(x) else np.empty((0, 0))
    near, picked = np.full(len(x), np.inf), []
    while len(picked) < min(k, len(x)):
        picked.append(int(np.minimum(d2, near[None, :]).sum(axis=1).argmin()))
        near = np.minimum(near, d2[picked[-1]])
    return x[picked]


def _seed_rows(vectors: DataFrame, rows: int) -> np.ndarray:
    by = F.md5(F.col("id").cast("string"))
    return np.array([r["v"] for r in vectors.orderBy(by, "id").limit(rows).select("v").collect()], float)


def packed(vectors: DataFrame) -> DataFrame:
    """(x): the vectors of (id, v) as binary values, stored once in the shared checkpoint folder over the cores of the session."""
    spark = vectors.sparkSession

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                x = matrix(b.column(0).slice(lo, _ROWS))
                ends = pa.array(np.arange(0, 8 * x.size + 1, 8 * x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(x.tobytes())])], ["x"])

    rows = vectors.select("v").mapInArrow(run, "x binary").repartition(2 * spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "packed")
    rows.write.parquet(path)
    return spark.read.schema("x binary").parquet(path).coalesce(TASKS * spark.sparkContext.defaultParallelism)


def _unpacked(column) -> np.ndarray:
    """Rows of a packed column as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def _centre_sums(blocks: DataFrame, models: dict[int, np.ndarray], unit: bool = False) -> dict[tuple[int, int], tuple]:
    """(k, j) -> (rows, vector sum) of the rows whose nearest centre of model k is j, for all models in one pass."""
    keys = sorted(models)
    width = models[keys[0]].shape[1]
    at = [(k, j) for k in keys for j in range(len(models[k]))]

    def run(batches):
        sums = {k: np.zeros((len(models[k]), width)) for k in keys}
        count = {k: np.zeros(len(models[k]), np.int64) for k in keys}
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                x = _unpacked(b.column(0).slice(lo, _ROWS))
                sq = (x * x).sum(axis=1)
                if unit:
                    norm = np.sqrt(sq)
                    to_add = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
                else:
                    to_add = x
                for k in keys:
                    own = _nearest(x, sq, models[k])
                    one = np.zeros((len(models[k]), len(x)))
                    one[own, np.arange(len(x))] = 1.0
                    sums[k] += one @ to_add
                    count[k] += np.bincount(own, minlength=len(models[k]))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([count[k] for k in keys]).tobytes()], pa.binary()),
                                          pa.array([np.concatenate([sums[k] for k in keys]).tobytes()], pa.binary())], ["n", "s"])

    n, s = np.zeros(len(at), np.int64), np.zeros((len(at), width))
    for r in blocks.mapInArrow(run, "n binary, s binary").collect():
        n += np.frombuffer(r["n"], np.int64)
        s += np.frombuffer(r["s"], np.float64).reshape(len(at), width)
    return {kj: (int(n[i]), s[i]) for i, kj in enumerate(at) if n[i]}


def fit_models(vectors: DataFrame, ks: list[int], max_iter: int = MAX_ITER, seed_rows: int = SEED_ROWS,
               blocks: DataFrame | None = None) -> dict[int, np.ndarray]:
    """k -> centres (fewer than k if the seeds hold fewer rows).  ``vectors`` is (id, v), best from ``slim_vectors``;
    ``blocks`` are its ``packed`` rows, if they are at hand."""
    seeds = greedy_seeds(_seed_rows(vectors, max(seed_rows, max(ks))), max(ks))
    if not len(seeds):
        return {}
    models = {k: seeds[:k].copy() for k in ks}
    blocks = blocks if blocks is not None else packed(vectors)
    moving = set(ks)
    for _ in range(max_iter):
        found = _centre_sums(blocks, {k: models[k] for k in moving})
        for k in sorted(moving):
            new = models[k].copy()
            for j in range(len(new)):
                n, s = found.get((k, j), (0, None))
                if n:
                    new[j] = s / n
            if np.sqrt(((new - models[k]) ** 2).sum(axis=1)).max() <= TOLERANCE:
                moving.discard(k)
            models[k] = new
        if not moving:
            return models
    warnings.warn(f"models {sorted(moving)} still moved after {max_iter} iterations", stacklevel=2)
    return models


def silhouettes(vectors: DataFrame, models: dict[int, np.ndarray], blocks: DataFrame | None = None) -> dict[int, float | None]:
    """Mean cosine silhouette of every model, from per-cluster sums of unit vectors: two passes for all models.

    A row alone in its cluster scores 0; a model with a single cluster has no silhouette (None).
    """
    blocks = blocks if blocks is not None else packed(vectors)
    sums = _centre_sums(blocks, models, unit=True)
    means = {k: (np.array([sums[k, j][1] / sums[k, j][0] if (k, j) in sums else np.zeros(c.shape[1]) for j in range(len(c))]),
                 np.array([sums[k, j][0] if (k, j) in sums else 0 for j in range(len(c))])) for k, c in models.items()}

    def run(batches):
        total, rows = {k: 0.0 for k in models}, 0
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                x = _unpacked(b.column(0).slice(lo, _ROWS))
                sq = (x * x).sum(axis=1)
                norm = np.sqrt(sq)
                u = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
                rows += len(x)
                for k, (m, size) in means.items():
                    own, at = _nearest(x, sq, models[k]), np.arange(len(x))
                    away = 1.0 - u @ m.T
                    n = size[own]
                    a = np.where(n > 1, away[at, own] * n / np.maximum(n - 1, 1), 0.0)
                    other = np.where(size[None, :] > 0, away, np.inf)
                    other[at, own] = np.inf
                    near = other.min(axis=1)
                    top = np.maximum(a, near)
                    s = np.where((n > 1) & (top > 0) & np.isfinite(near), (near - a) / np.where(top > 0, top, 1.0), 0.0)
                    total[k] += float(s.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64()),
                                          pa.array([rows] * len(total), pa.int64())], ["k", "s", "n"])

    parts = blocks.mapInArrow(run, "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    got = {r["k"]: r["s"] / r["n"] for r in parts.collect() if r["n"]}
    return {k: got.get(k) if (size > 0).sum() > 1 else None for k, (_, size) in means.items()}


def assign(vectors: DataFrame, centres: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id, cluster): the nearest centre of every row of (id, v)."""
    schema = vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster")).schema

    def run(batches):
        for b in batches:
            own = np.concatenate([_nearest(x, (x * x).sum(axis=1), centres) for lo in range(0, max(1, b.num_rows), _ROWS)
                                  for x in [matrix(b.column(1).slice(lo, _ROWS))] if len(x)] or [np.empty(0, int)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32))], [id_col, "cluster"])

    return vectors.select("id", "v").mapInArrow(run, schema)


def centroid_table(spark, centres: np.ndarray) -> DataFrame:
    """k rows (cluster, centroid)."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centroid array<double>")


def search_k(df: DataFrame, k_min: int = 3, k_max: int = 10, id_col: str = "doc_id", vec: str = "v", max_iter: int = MAX_ITER):
    """(best_k, scores (k, silhouette), models k -> centres, the stored (id, v)); the highest silhouette wins, ties go
    to the smallest k."""
    vectors = slim_vectors(df, id_col, vec)
    blocks = packed(vectors)
    models = fit_models(vectors, list(range(k_min, k_max + 1)), max_iter, blocks=blocks)
    scores = [(k, s) for k, s in sorted(silhouettes(vectors, models, blocks).items())] if models else []
    known = [(s, -k) for k, s in scores if s is not None]
    best = -max(known)[1] if known else k_min
    return best, df.sparkSession.createDataFrame(scores, "k int, silhouette double"), models, vectors
