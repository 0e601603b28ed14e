"""Hierarchical density clustering (F6): Euclidean, minimum cluster size, excess-of-mass selection, noise = -1.

Everything is a Spark job over tables of rows, edges or clusters; only bounded numbers (cells, one row a task) reach the
driver.

1. *Neighbours.*  At most ``CELLS`` pivots cut the rows into cells.  A query row visits only cells that the triangle
   inequality cannot exclude: distance to the pivot minus the cell's radius at most the row's search bound.  Cells are cut
   into groups of at most ``GROUP_ROWS`` targets and as many queries.  A search that could skip less than three pairs in
   four takes all rows as one cell, cut into groups that grow with the rows up to ``GROUP_BYTES``: a row is then copied a
   fixed number of times, not once per cell.  Groups are searched in tiles of ``ASK`` by ``SEEN`` rows, small enough for a
   core's cache: a matrix product gives squares that are only compared with the row's bound, and the few pairs within it
   are measured from their differences, the same from either side.  A first search inside the own cell gives every row a
   bound, the second is exact: the core distance is the distance to the ``min_samples``-th nearest row, itself included.
2. *Minimum spanning tree* of the mutual reachability max(core a, core b, distance), by Borůvka rounds: every component
   takes its lightest outgoing edge (ties: smaller ids); the largest waits to be chosen by the others, which merge all the
   same.  Neighbour lists answer most; only rows whose unseen neighbours could be lighter than their component's best known
   edge search, within that bound.
3. *Dendrogram.*  The edges a round contracts lie on chains: an edge belongs to the chain below the first edge, in round
   order, that leaves its component and is heavier.  So the merge order is known without running through all edges one by
   one: an edge's component size is a running sum along its chain, chains of one round are independent, and there are as
   many rounds as in 2.  Running sums are taken over ranges, so a chain may span tasks.
4. *Condensed tree.*  An edge of a component with at least ``min_cluster_size`` rows bears a cluster, absorbs the smaller
   side into a cluster, or joins two clusters.  A cluster's stability is the sum over its leaving rows of 1/w at which they
   leave less 1/w at which it was born; clusters are selected from the leaves up (a cluster stands if it is at least as
   stable as its selected descendants together; never the root), and rows take the selected cluster above them.  A cluster
   comes after its descendants in merge order, so ranges of at most ``BLOCK`` clusters are settled in one pass each; what
   waits for another range goes on in the next round: as many rounds as ranges at most, however deep the tree.

Copies of a vector collapse to the smallest id before 1; they come back as edges to it that weigh its core distance, which
no other edge of theirs undercuts, so a third of all rows alike costs linear work.

Edge cases.  Rows with a null vector or id are left out; with fewer than ``min_samples`` or ``min_cluster_size`` rows, or a
single cluster, all is noise.  Equal weights are ordered by copies first, then by ids.  Distances below ``LEAST`` count as
LEAST, so 1/w stays finite.  Labels are the smallest id of the cluster's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

CELLS = 256
GROUP_ROWS = 2048
GROUP_BYTES = 24 << 20
ASK, SEEN = 256, 2048   # rows of a tile
BLOCK = 1 << 18         # clusters settled in one task
LEAST = 1e-9
_SLACK = 1e-9           # distances are computed in floating point
_INF = math.inf


def kept(df: DataFrame) -> DataFrame:
    """Written once below the shared checkpoint folder and read back: cuts lineage, and the size estimate of a loop's tables
    stays that of their files (a checkpoint's estimate would multiply with every join of every round)."""
    path = scratch_path(df.sparkSession, "hierarchy")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact differences, one target at a time where it matters: equal rows have distance 0."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    d = np.sqrt(np.maximum(sq, 0.0))
    near = np.argwhere(sq < 1e-6 * ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]))
    for lo in range(0, len(near), 1 << 16):                  # cancellation: recompute from differences
        i, j = near[lo:lo + (1 << 16)].T
        d[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
    return d


def _stack(col) -> np.ndarray:
    return np.vstack(col.to_numpy())


def _measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (x[i], y[j]) from their differences: a pair has the same distance wherever it is measured."""
    d = np.empty(len(i))
    step = max(1, (1 << 20) // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        at = slice(lo, lo + step)
        d[at] = np.sqrt(((x[i[at]] - y[j[at]]) ** 2).sum(1))
    return d


def _tiles(x: np.ndarray, y: np.ndarray):
    """(lo, hi, lo of y, squares, slack of a row's squares) of every tile; the squares' error is within the slack."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 1e-12 * (xx + yy.max())
    for lo in range(0, len(x), ASK):
        hi = min(lo + ASK, len(x))
        for at in range(0, len(y), SEEN):
            sq = x[lo:hi] @ y[at:at + SEEN].T
            sq *= -2.0
            sq += xx[lo:hi, None]
            sq += yy[None, at:at + SEEN]
            yield lo, hi, at, sq, slack[lo:hi]


def _within(bound: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Squares beyond this are farther than the bound, whatever the error."""
    return bound * bound * (1 + 1e-12) + slack


class Cells:
    """Pivots, radii and sizes of the cells: at most CELLS rows."""

    def __init__(self, points: DataFrame, cells: int):
        self.spark = points.sparkSession
        rows = points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells).select("v").collect()
        self.pivots = np.unique(np.array([r["v"] for r in rows], float), axis=0)
        pivots = self.pivots

        def extent(batches):
            for pdf in batches:
                d = _distances(_stack(pdf["v"]), pivots)
                own = d.argmin(axis=1)
                yield pd.DataFrame({"c": own.astype(np.int32), "r": d[np.arange(len(d)), own]})

        found = points.select("v").mapInPandas(extent, "c int, r double").groupBy("c").agg(F.max("r").alias("r"), F.count("*").alias("n"))
        self.radius, self.size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for r in found.collect():
            self.radius[r["c"]], self.size[r["c"]] = r["r"], r["n"]

    def search(self, targets: DataFrame, queries: DataFrame, payload: dict[str, str], fn: Callable, schema: str, own_only: bool = False) -> DataFrame:
        """``fn(queries, targets, (x, y))`` on every group of query rows and the targets they have to see; x and y are their
        vectors.

        Both tables have (id, v, payload); queries also ``bound``: rows farther than that need not be seen.
        """
        pivots, radius, size = self.pivots, self.radius, self.size
        cut = np.maximum(1, -(-size // GROUP_ROWS))
        names = list(payload)

        def visits(x, bound):
            d = _distances(x, pivots)
            if own_only:
                return np.arange(len(pivots))[None, :] == d.argmin(axis=1)[:, None]
            return (d - radius[None, :] <= bound[:, None] + _SLACK) & (size > 0)[None, :]

        def count(batches):
            for pdf in batches:
                n = visits(_stack(pdf["v"]), pdf["bound"].to_numpy()).sum(axis=0)
                yield pd.DataFrame({"c": np.r_[np.flatnonzero(n), len(pivots)].astype(np.int32), "n": np.r_[n[n > 0], len(pdf)]})

        asked = np.zeros(len(pivots) + 1, np.int64)             # the last: all rows that ask
        for r in queries.select("v", "bound").mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
            asked[r["c"]] = r["n"]
        asking, asked = int(asked[-1]), asked[:-1]
        shares = -(-asked // GROUP_ROWS)                        # 0: nobody asks
        whole = not own_only and len(pivots) > 1 and 4 * float((asked * size).sum()) > asking * float(size.sum())
        if whole:
            share = -(-max(int(size.sum()), asking) // math.ceil(math.sqrt(4 * self.spark.sparkContext.defaultParallelism)))
            rows = max(GROUP_ROWS, min(GROUP_BYTES // (8 * pivots.shape[1]), share))
            cut, shares = np.array([-(-int(size.sum()) // rows)]), np.array([-(-asking // rows)])

        def owner(x):
            return np.zeros(len(x), int) if whole else _distances(x, pivots).argmin(axis=1)

        def hashed(ids):
            return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

        def frame(pdf, at, c, sub, share, side):
            out = pdf.iloc[at]
            bound = out["bound"].to_numpy() if side else np.zeros(len(at))
            return pd.DataFrame({"_c": np.int32(c), "_b": np.asarray(sub, np.int32), "_q": np.asarray(share, np.int32),
                                 "_side": np.int32(side), "id": out["id"].to_numpy(), "v": out["v"].to_numpy(), "bound": bound,
                                 **{k: out[k].to_numpy() for k in names}}, index=range(len(at)))

        def deal_targets(batches):
            for pdf in batches:
                own = owner(_stack(pdf["v"]))
                h = hashed(pdf["id"].to_numpy())
                for c in np.unique(own):
                    at = np.flatnonzero(own == c)
                    for q in range(int(shares[c])):
                        yield frame(pdf, at, c, h[at] % np.uint64(cut[c]), np.full(len(at), q), 0)

        def deal_queries(batches):
            for pdf in batches:
                see = np.ones((len(pdf), 1), bool) if whole else visits(_stack(pdf["v"]), pdf["bound"].to_numpy())
                h = hashed(pdf["id"].to_numpy()) >> np.uint64(9)
                for c in np.flatnonzero(see.any(axis=0)):
                    at = np.flatnonzero(see[:, c])
                    for b in range(int(cut[c])):
                        yield frame(pdf, at, c, np.full(len(at), b), h[at] % np.uint64(max(1, shares[c])), 1)

        dealt = "_c int, _b int, _q int, _side int, id long, v array<double>, bound double" + "".join(f", {k} {t}" for k, t in payload.items())

        def group(pdf):
            ask, seen = pdf[pdf["_side"] == 1], pdf[pdf["_side"] == 0]
            if not len(ask) or not len(seen):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return fn(ask.drop(columns="v"), seen.drop(columns="v"), (_stack(ask["v"]), _stack(seen["v"])))

        rows = targets.select("id", "v", *names).mapInPandas(deal_targets, dealt).unionByName(
            queries.select("id", "v", "bound", *names).mapInPandas(deal_queries, dealt))
        return rows.groupBy("_c", "_b", "_q").applyInPandas(group, schema)


def neighbours(points: DataFrame, cells: Cells, m: int) -> DataFrame:
    """(id, near, core, far): the m nearest points as (d, id, mult) in order, itself included; the distance within which m
    rows lie, copies counted; and the least distance of a point that is not listed."""

    def nearest(ask, seen, vectors):
        x, y = vectors
        me, ids, mult = ask["id"].to_numpy(), seen["id"].to_numpy(), seen["mult"].to_numpy()
        bound, none = ask["bound"].to_numpy().copy(), np.zeros(0, np.int64)
        out, held = [], (none, none, np.zeros(0))               # of the rows lo to hi: row, target and distance, nearest first
        for lo, hi, at, sq, slack in _tiles(x, y):
            held = held if at else (none, none, np.zeros(0))
            limit, new = _within(bound[lo:hi], slack), np.flatnonzero(np.isinf(bound[lo:hi]))
            if len(new) and sq.shape[1] > m:
                limit[new] = np.partition(sq[new], m - 1, axis=1)[:, m - 1] + 2 * slack[new]
            i, j = np.nonzero(sq <= limit[:, None])
            i, j = i + lo, j + at
            i, j, d = (np.concatenate(p) for p in zip(held, (i, j, _measured(x, y, i, j))))
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            full = nth == m - 1
            bound[i[full]] = np.minimum(bound[i[full]], d[full])
            held = i[nth < m], j[nth < m], d[nth < m]
            if at + SEEN >= len(y):
                out.append(held)
        i, j, d = (np.concatenate(p) for p in zip(*out))
        return pd.DataFrame({"id": me[i], "d": d, "q": ids[j], "n": mult[j]})

    def lists(found):
        near = F.slice(F.sort_array(F.collect_list(F.struct("d", "q", "n"))), 1, m)
        return found.groupBy("id").agg(near.alias("near"))

    schema = "id long, d double, q long, n long"
    bound = F.expr(f"if(size(near) >= {m}, near[{m - 1}].d, double('Infinity'))")
    local = lists(cells.search(points, points.withColumn("bound", F.lit(_INF)), {"mult": "long"}, nearest, schema, own_only=True))
    asked = points.join(local.select("id", bound.alias("bound")), "id")
    near = lists(cells.search(points, asked.transform(kept), {"mult": "long"}, nearest, schema))
    core = F.expr(f"""aggregate(near, struct(0L as n, double('Infinity') as d),
        (a, x) -> if(a.n >= {m}, a, struct(a.n + x.n as n, if(a.n + x.n >= {m}, x.d, a.d) as d)), a -> a.d)""")
    return near.select("id", "near", core.alias("core"), bound.alias("far")).transform(kept)


def _edge(w, a, b):
    return F.struct(w.alias("w"), F.lit(1).alias("kind"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def spanning_rounds(points: DataFrame, cells: Cells, near: DataFrame) -> list[DataFrame]:
    """Boruvka rounds; round r is (comp, w, kind, a, b, next): the lightest edge that leaves each component (nulls for the
    largest, which takes none after round 0), and the component that its points belong to afterwards.  Round 0 starts from single points (comp = id); a point with copies
    takes the edge to its first copy (kind 0) there."""
    known = points.join(near.select("id", "core", "far"), "id").transform(kept)
    cores = known.select(F.col("id").alias("q"), F.col("core").alias("qc"))
    listed = near.select("id", "core", F.explode("near").alias("x")).where("x.q != id").select("id", "core", "x.q", "x.d")
    listed = listed.join(cores, "q").select("id", "q", F.greatest("core", "qc", "d", F.lit(LEAST)).alias("w")).transform(kept)
    comp = known.select("id", F.col("id").alias("comp"))
    rounds: list[DataFrame] = []

    def lightest(ask, seen, vectors):
        x, y = vectors
        comps, mine = np.unique(ask["comp"].to_numpy(), return_inverse=True)
        me, core, comp = (ask[c].to_numpy() for c in ("id", "core", "comp"))
        other, ocore, ocomp = (seen[c].to_numpy() for c in ("id", "core", "comp"))
        best = np.full(len(comps), _INF)                        # of each component so far
        np.minimum.at(best, mine, ask["bound"].to_numpy())
        out, held = [], []                                      # edges of the rows lo to hi: component, weight, smaller and larger id

        def weigh(i, j):
            return np.maximum(np.maximum(_measured(x, y, i, j), core[i]), np.maximum(ocore[j], LEAST))

        def least(edges):
            c, w, low, high = (np.concatenate(p) for p in zip(*edges))
            order = np.lexsort((high, low, w, c))               # of equal weights the pair with the smaller ids
            first = order[np.flatnonzero(np.diff(c[order], prepend=-1))]
            return c[first], w[first], low[first], high[first]

        for lo, hi, at, sq, slack in _tiles(x, y):
            new = np.flatnonzero(np.isinf(best[mine[lo:hi]]))
            if len(new):                                        # any edge is a bound
                far = np.where(comp[lo + new, None] == ocomp[None, at:at + SEEN], _INF, sq[new])
                near = far.argmin(axis=1)
                ok = np.isfinite(far[np.arange(len(new)), near])
                np.minimum.at(best, mine[lo + new[ok]], weigh(lo + new[ok], at + near[ok]))
            i, j = np.nonzero(sq <= _within(best[mine[lo:hi]], slack)[:, None])
            i, j = i + lo, j + at
            apart = comp[i] != ocomp[j]
            i, j = i[apart], j[apart]
            w = weigh(i, j)
            np.minimum.at(best, mine[i], w)
            low, high = np.minimum(me[i], other[j]), np.maximum(me[i], other[j])
            held.append((mine[i], w, low, high))
            if at + SEEN >= len(y) or len(i) > 1 << 16:
                held = [least(held)]
            if at + SEEN >= len(y):
                out, held = out + held, []
        c, w, low, high = least(out)
        return pd.DataFrame({"comp": comps[c], "w": w, "a": low, "b": high})

    while True:
        rows = known.join(comp, "id").transform(kept)
        largest = rows.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect() if rounds else []
        if rounds and len(largest) < 2:
            return rounds
        rest = F.col("comp") != largest[0]["comp"] if rounds else F.lit(True)
        free = rows.where(rest if rounds else "mult = 1")       # with copies: the first round's edge is known
        mine = comp.select("id", "comp")
        pairs = (listed.join(mine, "id").join(mine.select(F.col("id").alias("q"), F.col("comp").alias("qcomp")), "q")
                 .where("comp != qcomp").where(rest).select("comp", _edge(F.col("w"), F.col("id"), F.col("q")).alias("e")))
        first = pairs.unionByName(_pivot_edges(rows, cells, rest)).groupBy("comp").agg(F.min("e").alias("e")).transform(kept)
        asked = free.join(first.select("comp", F.col("e.w").alias("bound")), "comp", "left")
        asked = asked.withColumn("bound", F.coalesce("bound", F.lit(_INF))).where(F.greatest("core", "far") <= F.col("bound"))
        more = cells.search(rows, asked.transform(kept), {"core": "double", "comp": "long"}, lightest,
                            "comp long, w double, a long, b long")
        best = first.unionByName(more.select("comp", _edge(F.col("w"), F.col("a"), F.col("b")).alias("e")))
        best = best.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*")
        if not rounds:
            alike = rows.where("mult > 1").select(F.col("id").alias("comp"), F.greatest("core", F.lit(LEAST)).alias("w"),
                                                  F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("copy").alias("b"))
            best = best.join(alike.select("comp"), "comp", "left_anti").unionByName(alike)
        if rounds:
            waits = best.sparkSession.createDataFrame([(largest[0]["comp"], None, None, None, None)], best.schema)
            best = best.unionByName(waits)
        best = best.transform(kept)
        after = _contract(best, comp)
        rounds.append(best.join(after, "comp").transform(kept))
        comp = comp.join(after, "comp").select("id", F.col("next").alias("comp")).transform(kept)


def _pivot_edges(rows: DataFrame, cells: Cells, asking) -> DataFrame:
    """(comp, e): each asking row's lightest edge to a pivot of another component, a first bound for its component's search."""
    at = {tuple(p): i for i, p in enumerate(cells.pivots.tolist())}

    def own(batches):
        for pdf in batches:
            i = [at.get(tuple(v)) for v in map(list, pdf["v"])]
            keep = [k is not None for k in i]
            yield pdf[keep].assign(p=[k for k in i if k is not None])[["p", "id", "core", "comp"]].astype({"p": "int32"})

    held = rows.select("id", "v", "core", "comp").mapInPandas(own, "p int, id long, core double, comp long").toPandas()  # CELLS rows at most
    piv = cells.pivots[held["p"].to_numpy()]
    pid, pcore, pcomp = (held[c].to_numpy() for c in ("id", "core", "comp"))

    def edges(batches):
        for pdf in batches:
            x, core, comp = _stack(pdf["v"]), pdf["core"].to_numpy(), pdf["comp"].to_numpy()
            w = np.where(comp[:, None] == pcomp[None, :], np.inf, np.maximum(_distances(x, piv), pcore[None, :]))
            j = w.argmin(axis=1)
            i = np.flatnonzero(np.isfinite(w[np.arange(len(w)), j]))
            j = j[i]
            w = np.maximum(np.maximum(_measured(x, piv, i, j), core[i]), np.maximum(pcore[j], LEAST))
            yield pd.DataFrame({"comp": comp[i], "w": w, "id": pdf["id"].to_numpy()[i], "q": pid[j]})

    made = rows.where(asking).select("id", "v", "core", "comp").mapInPandas(edges, "comp long, w double, id long, q long")
    return made.select("comp", _edge(F.col("w"), F.col("id"), F.col("q")).alias("e"))


def _contract(best: DataFrame, comp: DataFrame) -> DataFrame:
    """(comp, next): components after joining along the chosen edges.  Every component points to the one its edge reaches
    (to itself if that is a copy or it took none), and pointers are jumped until they stand still; two that chose one edge end in the
    smaller."""
    ends = best.where("kind = 1").select("comp", F.explode(F.array("a", "b")).alias("id"))
    up = (ends.join(comp.withColumnRenamed("comp", "at"), "id").where("at != comp").select("comp", F.col("at").alias("next"))
          .unionByName(best.where("kind = 0 or kind is null").select("comp", F.col("comp").alias("next"))))
    back = up.select(F.col("comp").alias("next"), F.col("next").alias("back"))
    root = F.expr("if(back = comp and comp < next, comp, next)")
    up = up.join(back, "next").select("comp", root.alias("next")).transform(kept)
    while True:
        hop = up.select(F.col("comp").alias("next"), F.col("next").alias("far"))
        new = up.join(hop, "next").select("comp", F.col("far").alias("next"), F.expr("far != next").alias("moved")).transform(kept)
        up = new.select("comp", "next")
        if not new.where("moved").limit(1).count():
            return up


def running(df: DataFrame, key: str, order: list[str], value: str, how: str) -> DataFrame:
    """``df`` with ``before`` and ``after``: what holds before and with each row along ``order`` within ``key`` (a long):
    the running sum, or the last value that is not null, of the long ``value``.  Rows are sorted by ranges of (key, order),
    so a key may span tasks; what a task holds of its first and last key reaches the driver, one row a task."""
    plain = df.columns
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)

    def step(held, x):
        return held if x is None else x if held is None or how == "last" else held + x

    def local(batches):
        part, last, held = TaskContext.get().partitionId(), None, None
        for pdf in batches:
            before, after = [], []
            for k, x in zip(pdf[key].tolist(), pdf[value].tolist()):
                if k != last:
                    last, held = k, None
                before.append(held)
                held = step(held, None if x is None or x != x else int(x))
                after.append(held)
            yield pdf.assign(before=pd.array(before, "Int64"), after=pd.array(after, "Int64"), part=np.int32(part))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", before long, after long, part int"
    done = dealt.mapInPandas(local, schema).transform(kept)
    tops = F.max(F.struct(key, *order, "after")).alias("hi")
    ends = done.groupBy("part").agg(F.min(key).alias("lo"), tops).select("part", "lo", F.col(f"hi.{key}").alias("hi"), "hi.after")
    carry, held = [], None                                      # (key, value) that the next part may go on with
    for r in sorted(ends.collect()):
        if held and held[0] == r["lo"]:
            carry.append((r["part"], *held))
            total = step(held[1], r["after"]) if r["lo"] == r["hi"] else r["after"]
        else:
            total = r["after"]
        held = (r["hi"], total)
    moved = df.sparkSession.createDataFrame(carry, f"part int, _key long, _held long")
    joined = done.join(F.broadcast(moved), "part", "left").withColumn("_held", F.when(F.col("_key") == F.col(key), F.col("_held")))
    if how == "sum":
        fixed = [F.expr(f"if(_held is null, {c}, coalesce({c}, 0) + _held)").alias(c) for c in ("before", "after")]
    else:
        fixed = [F.coalesce(c, "_held").alias(c) for c in ("before", "after")]
    return joined.select(*plain, *fixed)


def dendrogram(points: DataFrame, copies: DataFrame, rounds: list[DataFrame], size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (rank, w, chain, level, n, n_before, attached, cluster, cluster_before) in merge order; (id, rank): each row's
    lightest edge; tops (rank, n, cluster) of the chains below an edge.

    ``cluster`` names the cluster that the component of an edge with ``size`` rows or more belongs to, by the rank of the
    edge where the cluster ends (below: where it is born, or where two clusters join).
    """
    stars = copies.select(F.col("id").alias("comp"), "w", F.lit(0).alias("kind"), F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = stars.drop("comp")
    for r in rounds:
        edges = edges.unionByName(r.where("kind is not null").select("w", "kind", "a", "b"))
    by = ["w", "kind", "a", "b"]
    edges = running(edges.distinct().withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0).cast("long")), "all", by, "one", "sum")
    edges = edges.select("a", "b", "w", F.col("after").alias("rank")).transform(kept)
    ranked = [r.join(edges.drop("w"), ["a", "b"]).select("comp", "rank", "next")
              .unionByName(r.where("kind is null").select("comp", F.lit(None).cast("long").alias("rank"), "next")).transform(kept) for r in rounds]
    lightest = ranked[0].select(F.col("comp").alias("id"), "rank").unionByName(
        stars.join(edges.drop("w"), ["a", "b"]).select(F.col("comp").alias("id"), "rank")).transform(kept)

    # chains: below the first edge, in round order, that leaves the component and is heavier
    starred = stars.join(edges.drop("w"), ["a", "b"]).select("rank", F.col("a").alias("comp"))
    pending = ranked[0].select("rank", F.col("next").alias("comp")).unionByName(
        starred.join(ranked[0].select("comp", "next"), "comp").select("rank", F.col("next").alias("comp"))).distinct()
    chains = None
    for level, r in enumerate(ranked[1:], 1):
        twin = r.groupBy("rank").agg(F.max("comp").alias("high"), F.count("*").alias("sides"))
        out = r.join(twin, "rank", "left").select("comp", F.col("rank").alias("f"), "next", F.expr("if(sides = 2 and comp = high, 1, 0)").alias("side"))
        met = pending.join(out, "comp").transform(kept)
        solved = met.where("f > rank").select("rank", F.expr("f * 2 + side").alias("chain"), F.lit(level).alias("level"))
        chains = solved if chains is None else chains.unionByName(solved)
        pending = met.where("f is null or f < rank").select("rank", F.col("next").alias("comp")).unionByName(
            r.where("rank is not null").select("rank", F.col("next").alias("comp")).distinct()).distinct().transform(kept)
    last = pending.select("rank", F.lit(-1).cast("long").alias("chain"), F.lit(len(ranked)).alias("level"))
    chains = last if chains is None else chains.unionByName(last)
    single = lightest.groupBy("rank").agg(F.count("*").alias("single"))
    chains = chains.join(edges.select("rank", "w"), "rank").join(single, "rank", "left").withColumn("single", F.coalesce("single", F.lit(0))).transform(kept)

    spark = points.sparkSession
    tops = spark.createDataFrame([], "rank long, n long, cluster long")
    done = None
    for level in range(1, len(ranked) + 1):
        hung = tops.groupBy("rank").agg(F.sum("n").alias("hung"), F.sort_array(F.collect_list(F.struct("n", "cluster")), False).alias("attached"))
        here = chains.where(F.col("level") == level).join(hung, "rank", "left")
        here = here.withColumn("add", F.col("single") + F.coalesce("hung", F.lit(0)))
        flat = here.select("rank", "w", "chain", "level", "add", F.expr("get(attached, 0).n").alias("n1"), F.expr("get(attached, 0).cluster").alias("c1"),
                           F.expr("get(attached, 1).n").alias("n2"), F.expr("get(attached, 1).cluster").alias("c2"))
        sized = running(flat, "chain", ["rank"], "add", "sum").withColumnRenamed("after", "n").withColumn("n_before", F.coalesce("before", F.lit(0))).drop("before")
        big = (F.col("n_before") >= size).cast("int") + F.coalesce((F.col("n1") >= size).cast("int"), F.lit(0)) + F.coalesce((F.col("n2") >= size).cast("int"), F.lit(0))
        sized = sized.withColumn("big", big)
        named = F.expr(f"case when n < {size} then null when big != 1 then rank when n_before >= {size} then null else c1 end")
        sized = running(sized.withColumn("named", named), "chain", ["rank"], "named", "last")
        sized = sized.withColumnRenamed("before", "cluster_before").withColumnRenamed("after", "cluster").transform(kept)
        done = sized if done is None else done.unionByName(sized)
        top = sized.where("chain >= 0").groupBy("chain").agg(F.max(F.struct("rank", "n", "cluster")).alias("x"))
        tops = tops.unionByName(top.select(F.expr("chain div 2").alias("rank"), "x.n", "x.cluster")).transform(kept)
    return done.transform(kept), lightest, tops


def cluster_tree(edges: DataFrame, size: int) -> DataFrame:
    """(cluster, parent, stability): the condensed tree; the root's parent is null."""
    large = edges.where(F.col("n") >= size).withColumn("lam", 1 / F.col("w"))
    leaving = F.expr(f"if(big = 1, n - if(n_before >= {size}, n_before, n1), n)")
    joins = large.where("big = 2").select(F.col("rank").alias("parent"), F.col("lam").alias("born"), F.explode(F.array_compact(F.array(
        F.expr(f"if(n_before >= {size}, cluster_before, null)"), F.expr(f"if(n1 >= {size}, c1, null)"),
        F.expr(f"if(n2 >= {size}, c2, null)")))).alias("cluster"))
    # row by row, so rows that leave where the cluster was born add exactly nothing
    stays = F.sum(leaving * (F.col("lam") - F.coalesce("born", F.lit(0.0))))
    tree = large.join(joins, "cluster", "left").groupBy("cluster").agg(F.max("parent").alias("parent"), stays.alias("stability"))
    return tree.transform(kept)


def _by_range(df: DataFrame, blocks: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each of ``blocks`` ranges of clusters, in merge order."""
    def run(batches):
        got = list(batches)
        if got:
            yield fn(pd.concat(got, ignore_index=True).sort_values("cluster", ignore_index=True))

    return df.repartitionByRange(blocks, "cluster").mapInPandas(run, schema).transform(kept)


def selected(tree: DataFrame) -> DataFrame:
    """(cluster, chosen): the selected cluster at or above each cluster; null where there is none.

    From the leaves up a range settles every cluster whose descendants are in it or settled before; then from the root down
    a range hands on the topmost standing cluster."""
    blocks = -(-tree.count() // BLOCK)
    if not blocks:
        return tree.select("cluster", F.lit(None).cast("long").alias("chosen"))
    open_ = tree.withColumn("kids", F.lit(0.0)).join(
        tree.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("wait")), "cluster", "left")
    open_ = open_.withColumn("wait", F.coalesce("wait", F.lit(0)))

    def parents(pdf, col):
        at = {c: i for i, c in enumerate(pdf["cluster"].tolist())}
        return [at.get(int(p), -1) if p == p and p is not None else -2 for p in pdf[col].tolist()]       # -1: in another range

    def settle(pdf):
        up, own = parents(pdf, "parent"), pdf["stability"].tolist()
        kids, wait = pdf["kids"].tolist(), pdf["wait"].tolist()
        worth, stands = [0.0] * len(up), [False] * len(up)
        for i, p in enumerate(up):
            if not wait[i]:
                worth[i], stands[i] = max(own[i], kids[i]), p != -2 and own[i] >= kids[i]
                if p >= 0:
                    kids[p], wait[p] = kids[p] + worth[i], wait[p] - 1
        parent = pd.array([None if p == -2 else int(x) for p, x in zip(up, pdf["parent"].tolist())], "Int64")
        return pd.DataFrame({"cluster": pdf["cluster"], "parent": parent, "stability": own, "kids": kids, "wait": np.array(wait, np.int64),
                             "worth": worth, "stands": stands, "gives": [p == -1 for p in up]})

    settled = None
    while blocks:
        done = _by_range(open_, blocks, settle, "cluster long, parent long, stability double, kids double, wait long, worth double, stands boolean, gives boolean")
        ready = done.where("wait = 0").select("cluster", "parent", "stands")
        settled = ready if settled is None else settled.unionByName(ready)
        left = done.where("wait > 0").count()
        blocks = -(-left // BLOCK)
        given = done.where("wait = 0 and gives").groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("more"), F.count("*").alias("came"))
        open_ = done.where("wait > 0").join(given, "cluster", "left").select(
            "cluster", "parent", "stability", (F.col("kids") + F.coalesce("more", F.lit(0.0))).alias("kids"),
            (F.col("wait") - F.coalesce("came", F.lit(0))).alias("wait"))

    def hand_down(pdf):
        up, own = parents(pdf, "up"), [None if c is None or c != c else int(c) for c in pdf["chosen"].tolist()]
        far = [None if p == -2 else int(x) for p, x in zip(up, pdf["up"].tolist())]
        for i in range(len(up) - 1, -1, -1):
            if up[i] >= 0:                                      # what the parent has, and where it still looks
                far[i] = far[up[i]]
                own[i] = own[i] if own[up[i]] is None else own[up[i]]
        return pd.DataFrame({"cluster": pdf["cluster"], "up": pd.array(far, "Int64"), "chosen": pd.array(own, "Int64")})

    # chosen: the topmost standing cluster between here and up
    at = settled.select("cluster", F.col("parent").alias("up"), F.expr("if(stands, cluster, null)").alias("chosen"))
    at = _by_range(at, -(-tree.count() // BLOCK), hand_down, "cluster long, up long, chosen long")
    while at.where("up is not null").limit(1).count():          # over ranges: pointers are doubled on the way to the root
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("chosen").alias("higher"))
        at = at.join(above, "up", "left").select("cluster", F.col("far").alias("up"), F.coalesce("higher", "chosen").alias("chosen")).transform(kept)
    return at.select("cluster", "chosen")


def density_hierarchy(df: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, id_col: str = "doc_id",
                      vec: str = "v", cells: int = CELLS) -> DataFrame:
    """(id, cluster): the label of every row, noise = -1."""
    size, m = min_cluster_size, min_samples or min_cluster_size
    if size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null").transform(kept)
    noise = rows.select(F.col("id").alias(id_col), F.lit(-1).cast("long").alias("cluster"))
    if rows.limit(max(size, m)).count() < max(size, m):
        return noise
    groups = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("mult")).transform(kept)
    repeated = rows.join(groups.where("mult > 1").withColumnRenamed("id", "rep"), "v").where("id != rep").select("id", "rep").transform(kept)
    copy = repeated.groupBy(F.col("rep").alias("id")).agg(F.min("id").alias("copy"))
    points = groups.join(copy, "id", "left").select("id", "v", "mult", "copy").transform(kept)
    cut = Cells(points, min(cells, 4 * -(-points.count() // GROUP_ROWS)))
    near = neighbours(points, cut, m)
    copies = repeated.join(near.select(F.col("id").alias("rep"), F.greatest("core", F.lit(LEAST)).alias("w")), "rep").transform(kept)
    rounds = spanning_rounds(points, cut, near)
    edges, lightest, _ = dendrogram(points, copies, rounds, size)
    chosen = selected(cluster_tree(edges, size))

    # where the rows of a chain that are not yet in a large component come into one
    entry = edges.where(F.col("n") >= size).groupBy("chain").agg(F.min(F.struct("rank", "cluster"))["cluster"].alias("entry"))
    heads = edges.select("chain", "level").distinct().join(entry, "chain", "left").transform(kept)
    known = heads.where("entry is not null").select("chain", "entry")
    for level in range(len(rounds), 0, -1):
        lost = heads.where((F.col("level") == level) & F.col("entry").isNull() & (F.col("chain") >= 0))
        above = edges.select(F.col("rank").alias("f"), "n", "cluster", F.col("chain").alias("upper"))
        found = (lost.select("chain", F.expr("chain div 2").alias("f")).join(above, "f").join(
            known.select(F.col("chain").alias("upper"), "entry"), "upper", "left")
            .select("chain", F.expr(f"if(n >= {size}, cluster, entry)").alias("entry")))
        known = known.unionByName(found).transform(kept)
    placed = lightest.join(edges.select("rank", "chain", "n", "cluster"), "rank").join(known, "chain", "left")
    placed = placed.select("id", F.expr(f"if(n >= {size}, cluster, entry)").alias("cluster"))
    labelled = placed.join(chosen, "cluster").where("chosen is not null").select("id", "chosen").transform(kept)
    names = labelled.groupBy("chosen").agg(F.min("id").alias("label"))
    named = labelled.join(names, "chosen").select("id", "label")
    return rows.select("id").join(named, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).cast("long").alias("cluster"))
