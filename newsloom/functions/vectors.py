"""Vector column expressions (JVM-side higher-order functions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    """float32 vectors are widened before any arithmetic."""
    return col(v).cast("array<double>")


def let(value, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)``.

    Spark does not hoist loop-invariant work out of lambdas (and CollapseProject inlines projected columns into
    them), so ``transform(v, x -> x / norm(v))`` recomputes the norm per element.  A one-element ``transform``
    evaluates the value once and passes it in as a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def sumsq(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sumsq(a))


def l2_normalize(a) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(F.struct(col(a).alias("v"), norm(a).alias("n")),
               lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector (same as normalising first)."""
    return let(F.struct(dot(a, b).alias("d"), norm(a).alias("na"), norm(b).alias("nb")),
               lambda s: F.when(s["na"] * s["nb"] > 0, s["d"] / (s["na"] * s["nb"])).otherwise(F.lit(0.0)))


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(col(a), lambda x: x * s)


def vector_dim(df: DataFrame, vec: str) -> int:
    """Dimension read from one row (a cheap limited scan); models emit fixed-length vectors."""
    row = df.select(F.size(vec).alias("d")).where(F.col("d") > 0).limit(1).first()
    return int(row["d"]) if row else 0


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "mean", dim: int | None = None) -> DataFrame:
    """Element-wise mean of ``vec`` per key group.

    With a known dimension this is ONE hash aggregate with ``dim`` partial
    averages (map-side combine, no explode, skew-proof).  Without it, the
    generic form explodes positions and averages per (key, pos).
    """
    if dim:
        v = col(vec)
        aggs = [F.avg(v[i]).alias(f"_m{i}") for i in range(dim)]
        g = df.groupBy(*keys).agg(F.min(F.size(v)).alias("_lo"), F.max(F.size(v)).alias("_hi"), *aggs)
        right = F.coalesce((F.col("_lo") == dim) & (F.col("_hi") == dim), F.lit(True))
        mean = F.when(right, F.array(*[F.col(f"_m{i}") for i in range(dim)])).otherwise(
            F.raise_error(F.lit(f"a vector's width is not {dim}")))
        return g.select(*keys, mean.alias(out))
    ex = df.select(*keys, F.posexplode(vec).alias("_pos", "_val"))
    per_dim = ex.groupBy(*keys, "_pos").agg(F.avg("_val").alias("_val"))
    return (per_dim.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_val"))).alias("_pv"))
            .select(*keys, F.transform("_pv", lambda s: s["_val"]).alias(out)))
