"""All-pairs cosine similarity (E5, E6) and its consumers.

Exact pairs above a threshold t come from a *pruned block join*.  A bounded set of rows (the pivots) cuts the unit
vectors into cells: each row belongs to its nearest pivot, and a cell's radius is its largest angle to the pivot.  By
the triangle inequality of angles a row x can only have a neighbour in another cell if its angle to that cell's pivot
is at most the cell's radius plus acos(t); only then is x sent there, as a guest.  At the thresholds of duplicate
removal (0.85 to 0.95) most cells are skipped; at low thresholds nothing can be skipped and the join is a plain block
join.  Cells are cut further into groups of at most ``block_rows`` targets and about as many query rows, so a cell
that holds a third of all rows (near copies) is many groups, and memory per task is bounded whatever n is.  Inside a
group one matrix product scores all pairs; only what a consumer asks for (pairs, a best neighbour, a sum, links of a
spanning forest) leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ensure_checkpoint_dir

PAIR_SCHEMA = "id_a long, id_b long, sim double"
BEST_SCHEMA = "id long, best_wc long, best_id long"
REDUCE_SCHEMA = "id long, value long"
LINK_SCHEMA = "a long, b long, core boolean"
DEFAULT_BLOCK_ROWS = 2048
MAX_PIVOTS = 1024          # rows of the pivot matrix, the only thing broadcast
FEW_CELLS = 8
GROUP_BYTES = 24 << 20     # vectors on the target side of a group where no cell can be skipped
TILE = 2048
_EPS = 1e-6                # angles are computed in floating point
_GROUP = ["_c", "_b", "_q"]


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def candidate_groups(base: DataFrame, threshold: float, payload: dict[str, str], blocks: int | None = None,
                     block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Rows (_c, _b, _q, _side, _same, _id, _u, payload) dealt into groups so that every unordered pair of rows with
    cosine above ``threshold`` meets in exactly one group, one row as target (side 0), the other as query (side 1).

    Query rows with ``_same`` also lie among the group's targets; of those pairs only query id < target id counts.
    ``base`` has columns _id (unique), _u (unit vectors of one width, or zero) and the payload columns; it is read
    several times and should be stored.  ``blocks`` fixes the number of cells.
    """
    spark = base.sparkSession
    n = base.count()
    rows = max(64, min(block_rows, math.ceil(n / math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))))
    cells = min(MAX_PIVOTS, blocks or max(1, math.ceil(n / rows)))
    prune = threshold >= 0.0
    source = base.where(V.sumsq("_u") > 0) if prune else base    # a zero vector has cosine 0 to everything
    # a few cells could skip hardly a pair, and finding out costs more than comparing: one cell, without any pass over the rows
    few = blocks is None and cells <= FEW_CELLS
    nonzero = source.where(V.sumsq("_u") > 0)
    picked = nonzero.limit(1).select("_u").collect() if few else (
        nonzero.orderBy(F.xxhash64("_id"), "_id").limit(cells).select("_u").collect())
    theta = math.acos(min(1.0, threshold)) + _EPS if prune else math.pi
    schema = "_c int, _b int, _q int, _side int, _same boolean, _id long, _u array<double>" + "".join(f", {k} {t}" for k, t in payload.items())
    if not picked:
        return spark.createDataFrame([], schema)
    pivots = spark.sparkContext.broadcast(np.array([r["_u"] for r in picked], float))

    def extent(batches):
        for pdf in batches:
            a = _angles(np.vstack(pdf["_u"].to_numpy()), pivots.value)
            own = a.argmin(axis=1)
            yield pd.DataFrame({"c": own.astype(np.int32), "r": a[np.arange(len(a)), own]})

    # one row per cell (at most MAX_PIVOTS) reaches the driver
    size = {0: (math.pi, n)} if few else {r["c"]: (r["r"], r["n"]) for r in source.select("_u").mapInPandas(extent, "c int, r double").groupBy("c").agg(
        F.max("r").alias("r"), F.count("*").alias("n")).collect()}
    radius = np.array([size.get(c, (-math.inf, 0))[0] for c in range(len(picked))])
    members = np.array([size.get(c, (0.0, 0))[1] for c in range(len(picked))])

    def guests_of(a, own):
        return (a <= radius[None, :] + theta) & (np.arange(a.shape[1])[None, :] > own[:, None]) & (members > 0)[None, :]

    def guest_counts(batches):
        for pdf in batches:
            a = _angles(np.vstack(pdf["_u"].to_numpy()), pivots.value)
            count = guests_of(a, a.argmin(axis=1)).sum(axis=0)
            yield pd.DataFrame({"c": np.flatnonzero(count).astype(np.int32), "n": count[count > 0]})

    visits = {r["c"]: r["n"] for r in source.select("_u").mapInPandas(guest_counts, "c int, n long").groupBy("c").agg(
        F.sum("n").alias("n")).collect()} if len(picked) > 1 else {}
    met = float((members * (members / 2 + np.array([visits.get(c, 0) for c in range(len(picked))]))).sum())
    if blocks is None and len(picked) > 1 and met > members.sum() ** 2 / 8:     # cells skip less than three pairs in four
        picked, radius, members, visits = picked[:1], np.array([math.pi]), np.array([members.sum()]), {}
        pivots = spark.sparkContext.broadcast(np.array([r["_u"] for r in picked], float))
        share = math.ceil(n / math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
        rows = max(rows, min(GROUP_BYTES // (8 * len(picked[0]["_u"])), share))
    subs = np.maximum(1, -(-members // rows))
    shares = np.array([max(1, -(-(int(members[c]) + visits.get(c, 0)) // (2 * rows))) for c in range(len(picked))])
    names = list(payload)

    def deal(batches):
        for pdf in batches:
            ids = pdf["_id"].to_numpy(np.int64)
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            a = _angles(np.vstack(pdf["_u"].to_numpy()), pivots.value)
            own = a.argmin(axis=1)
            visit = guests_of(a, own)
            parts = []
            for c in np.flatnonzero(visit.any(axis=0) | np.isin(np.arange(len(subs)), own)):
                s, q = int(subs[c]), int(shares[c])
                mine, guest = np.flatnonzero(own == c), np.flatnonzero(visit[:, c])
                sub = (h[mine] % np.uint64(s)).astype(int)
                for share in range(q):                                     # targets meet every share of the queries
                    parts.append((mine, c, sub, share, 0, np.zeros(len(mine), bool)))
                for b in range(s):
                    ask = mine[sub <= b]
                    parts.append((ask, c, b, (h[ask] >> np.uint64(9)) % np.uint64(q), 1, sub[sub <= b] == b))
                    parts.append((guest, c, b, (h[guest] >> np.uint64(9)) % np.uint64(q), 1, np.zeros(len(guest), bool)))
            for at, c, b, share, side, same in parts:
                if len(at):
                    out = pdf.iloc[at]
                    yield pd.DataFrame({"_c": np.int32(c), "_b": np.asarray(b, np.int32), "_q": np.asarray(share, np.int32), "_side": np.int32(side),
                                        "_same": same, "_id": out["_id"].to_numpy(), "_u": out["_u"].to_numpy(),
                                        **{k: out[k].to_numpy() for k in names}}, index=range(len(at)))

    return source.select("_id", "_u", *names).mapInPandas(deal, schema)


def _tiles(pdf: pd.DataFrame, thr: float):
    """(query rows, target rows, similarities, mask of pairs that count) of one group, in tiles of TILE rows a side."""
    ask, tgt = pdf[pdf["_side"] == 1], pdf[pdf["_side"] == 0]
    if not len(ask) or not len(tgt):
        return
    x, y = np.vstack(ask["_u"].to_numpy()), np.vstack(tgt["_u"].to_numpy())
    ask, tgt = ask.drop(columns="_u"), tgt.drop(columns="_u")
    for i in range(0, len(ask), TILE):
        some = ask.iloc[i:i + TILE]
        for j in range(0, len(tgt), TILE):
            other = tgt.iloc[j:j + TILE]
            sims = x[i:i + TILE] @ y[j:j + TILE].T
            same = some["_same"].to_numpy(bool)[:, None] & (some["_id"].to_numpy()[:, None] >= other["_id"].to_numpy()[None, :])
            yield some, other, sims, (sims > thr) & ~same


def _scored(tile: Callable, columns: list[str]) -> Callable:
    """A group's rows from ``tile(query rows, target rows, similarities, mask)`` on each of its tiles."""
    def score(pdf: pd.DataFrame, thr: float) -> pd.DataFrame:
        out = [tile(*t) for t in _tiles(pdf, thr) if t[3].any()]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in columns})
    return score


def _grouped(df: DataFrame, threshold: float, score: Callable, out_schema: str, payload: dict[str, str], blocks, block_rows) -> DataFrame:
    """Store the slim rows once in the shared checkpoint folder, deal them, and score every group."""
    ensure_checkpoint_dir(df.sparkSession)
    groups = candidate_groups(df.checkpoint(), threshold, payload, blocks, block_rows)
    return groups.groupBy(*_GROUP).applyInPandas(score, out_schema)


def _unit(vec: str, normalize: bool):
    return (V.l2_normalize(vec) if normalize else F.col(vec)).alias("_u")


def cosine_pairs(df: DataFrame, threshold: float, id_col: str = "doc_id", vec: str = "v", blocks: int | None = None,
                 block_rows: int = DEFAULT_BLOCK_ROWS, normalize: bool = True) -> DataFrame:
    """E5: (id_a < id_b, sim) for every pair with cosine strictly above ``threshold``."""
    thr = float(threshold)

    def pairs(ask, tgt, sims, hit):
        i, j = np.nonzero(hit)
        x, y = ask["_id"].to_numpy()[i], tgt["_id"].to_numpy()[j]
        return pd.DataFrame({"id_a": np.minimum(x, y), "id_b": np.maximum(x, y), "sim": sims[i, j]})

    tiled = _scored(pairs, ["id_a", "id_b", "sim"])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return tiled(pdf, thr)

    base = df.select(F.col(id_col).cast("long").alias("_id"), _unit(vec, normalize))
    return _grouped(base, thr, score, PAIR_SCHEMA, {}, blocks, block_rows)


def best_neighbours(df: DataFrame, threshold: float, id_col: str = "doc_id", vec: str = "v",
                    wc_col: str = "word_count", blocks: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
                    normalize: bool = True) -> DataFrame:
    """For every row with at least one neighbour (cosine > threshold): its best neighbour by (word count desc,
    id asc) -> (id, best_wc, best_id).  A group returns one row per row, so m copies cost O(m) output, not m^2/2."""
    thr, none = float(threshold), np.iinfo(np.int64).max

    def ranked(ask, tgt, _, hit):
        out = []
        for rows, cols, h in ((ask, tgt, hit), (tgt, ask, hit.T)):
            has = h.any(axis=1) if h.size else np.zeros(len(rows), bool)
            if has.any():
                wc, ids, h = cols["_x"].to_numpy(np.int64), cols["_id"].to_numpy(np.int64), h[has]
                top = np.where(h, wc[None, :], np.iinfo(np.int64).min).max(axis=1)
                first = np.where(h & (wc[None, :] == top[:, None]), ids[None, :], none).min(axis=1)
                out.append(pd.DataFrame({"id": rows["_id"].to_numpy()[has], "best_wc": top, "best_id": first}))
        return pd.concat(out, ignore_index=True)

    tiled = _scored(ranked, ["id", "best_wc", "best_id"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return tiled(pdf, thr)

    base = df.select(F.col(id_col).cast("long").alias("_id"), _unit(vec, normalize), F.col(wc_col).cast("long").alias("_x"))
    per_group = _grouped(base, thr, best, BEST_SCHEMA, {"_x": "long"}, blocks, block_rows)
    b = per_group.groupBy("id").agg(F.max(F.struct("best_wc", (F.lit(0) - F.col("best_id")).alias("nid"))).alias("b"))
    return b.select("id", F.col("b.best_wc").alias("best_wc"), (F.lit(0) - F.col("b.nid")).alias("best_id"))


def neighbour_sum(df: DataFrame, threshold: float, value_col: str, id_col: str = "doc_id", vec: str = "v",
                  blocks: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(id, value): the sum of ``value_col`` over each row's neighbours (itself excluded); rows without any are absent."""
    thr = float(threshold)

    def sums(ask, tgt, _, hit):
        x, y = ask["_x"].to_numpy(np.int64), tgt["_x"].to_numpy(np.int64)
        out = pd.DataFrame({"id": np.r_[ask["_id"].to_numpy(np.int64), tgt["_id"].to_numpy(np.int64)],
                            "value": np.r_[hit @ y, hit.T @ x].astype(np.int64)})
        return out[out["value"] > 0]

    tiled = _scored(sums, ["id", "value"])

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        return tiled(pdf, thr).groupby("id", as_index=False)["value"].sum()

    base = df.select(F.col(id_col).cast("long").alias("_id"), _unit(vec, True), F.col(value_col).cast("long").alias("_x"))
    part = _grouped(base, thr, reduce, REDUCE_SCHEMA, {"_x": "long"}, blocks, block_rows)
    return part.groupBy("id").agg(F.sum("value").alias("value"))


def core_links(df: DataFrame, threshold: float, core_col: str, id_col: str = "doc_id", vec: str = "v",
               blocks: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(a, b, core): for core rows a spanning forest of the neighbour graph of each tile (core = true: a and b are
    connected), and every link of a row that is not core to a core row (core = false: a is the row, b the core row).

    A group of m near copies costs m links, not m^2/2: a tile's core rows are labelled inside the task.
    """
    thr = float(threshold)

    def linked(ask, tgt, _, hit):
        qi, ti = ask["_id"].to_numpy(np.int64), tgt["_id"].to_numpy(np.int64)
        qc, tc = ask["_x"].to_numpy(np.int64) > 0, tgt["_x"].to_numpy(np.int64) > 0
        both = hit & qc[:, None] & tc[None, :]
        big = np.iinfo(np.int64).max
        lq, lt = qi.copy(), ti.copy()
        while both.any():
            # a row may stand on both sides: give both its labels the smaller one
            order = np.argsort(np.r_[qi, ti], kind="stable")
            ids, lab = np.r_[qi, ti][order], np.r_[lq, lt][order]
            head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            low = np.repeat(np.minimum.reduceat(lab, head), np.diff(np.r_[head, len(ids)]))
            merged = np.empty_like(low)
            merged[order] = low
            mq, mt = merged[:len(qi)], merged[len(qi):]
            nq = np.minimum(mq, np.where(both, mt[None, :], big).min(axis=1))
            nt = np.minimum(mt, np.where(both, nq[:, None], big).min(axis=0))
            if (nq == lq).all() and (nt == lt).all():
                break
            lq, lt = nq, nt
        rows = [pd.DataFrame({"a": np.r_[qi, ti], "b": np.r_[lq, lt], "core": True})]
        rows[0] = rows[0][rows[0]["a"] != rows[0]["b"]]
        for x, y, h in ((qi, ti, hit & ~qc[:, None] & tc[None, :]), (ti, qi, (hit & qc[:, None] & ~tc[None, :]).T)):
            i, j = np.nonzero(h)
            rows.append(pd.DataFrame({"a": x[i], "b": y[j], "core": False}))
        return pd.concat(rows, ignore_index=True)

    tiled = _scored(linked, ["a", "b", "core"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        return tiled(pdf, thr).drop_duplicates()

    base = df.select(F.col(id_col).cast("long").alias("_id"), _unit(vec, True), F.col(core_col).cast("long").alias("_x"))
    return _grouped(base, thr, links, LINK_SCHEMA, {"_x": "long"}, blocks, block_rows)


def stacked_models(models: DataFrame, id_col: str = "doc_id", model_col: str = "model", vec: str = "v") -> DataFrame:
    """One row per document: the unit vectors of all its models, concatenated in model order, / sqrt(M).

    dot(stacked_i, stacked_j) = mean over models of cos_m(i, j), exactly.
    """
    per = models.select(id_col, model_col, V.l2_normalize(vec).alias("_u"))
    g = per.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(model_col).alias("m"), "_u"))).alias("_mu"))
    flat = F.flatten(F.transform("_mu", lambda s: s["_u"]))
    return g.select(id_col, V.scale(flat, F.lit(1.0) / F.sqrt(F.size("_mu").cast("double"))).alias("v"))


def ensemble_pairs(models: DataFrame, threshold: float, id_col: str = "doc_id", model_col: str = "model",
                   vec: str = "v", blocks: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Pairs whose similarity averaged over the models is above ``threshold`` (averaged before thresholding)."""
    st = stacked_models(models, id_col, model_col, vec)
    return cosine_pairs(st, threshold, id_col=id_col, vec="v", blocks=blocks, block_rows=block_rows, normalize=False)
