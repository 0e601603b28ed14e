"""Area assignment (section J): argmax of similarity to a small, fixed profile table.

The profile table has one row per business area (ten), so it is folded into a
scalar subquery array and every article is scored against it in place: no join,
no shuffle, ties resolved by the first profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .similarity import stacked_models

TIE_DIGITS = 12  # similarities are compared at 12 decimals, so the order of a sum cannot decide a tie


def _profile_array(profiles: DataFrame, ord_col: str, area_col: str, vec: str, normalize: bool):
    u = V.l2_normalize(vec) if normalize else F.col(vec)
    p = profiles.select(F.col(ord_col).cast("int").alias("ord"), F.col(area_col).alias("area"), u.alias("pv"))
    # the profile table is a lookup table (one row per area), so folding it into one value is bounded
    return p.select(F.sort_array(F.collect_list(F.struct("ord", "area", "pv"))).alias("ps")).scalar()


def assign_area(df: DataFrame, profiles: DataFrame, vec: str = "v", out: str = "area", ord_col: str = "ord",
                area_col: str = "area", vec_profile: str = "v", normalize: bool = True) -> DataFrame:
    """Area whose profile vector is most similar (cosine); tie -> first profile (smallest ord)."""
    ps = _profile_array(profiles, ord_col, area_col, vec_profile, normalize)
    u = V.l2_normalize(vec) if normalize else F.col(vec)
    # the article vector is bound once, then scored against every profile
    best = V.let(u, lambda uu: F.array_max(F.transform("_ps", lambda p: F.struct(
        F.round(V.dot(uu, p["pv"]), TIE_DIGITS).alias("sim"), (-p["ord"]).alias("nord"), p["area"].alias("area")))))
    return df.withColumn("_ps", ps).withColumn(out, best["area"]).drop("_ps")


def assign_area_ensemble(models: DataFrame, profile_models: DataFrame, out: str = "area") -> DataFrame:
    """Similarity averaged over the models, then argmax.

    models: (doc_id, model, v); profile_models: (ord, area, model, v).  The mean of per-model cosines equals
    the dot product of the stacked unit vectors, so J2 is J1 on stacked vectors.
    """
    docs = stacked_models(models, "doc_id", "model", "v")
    prof = stacked_models(profile_models.withColumn("_pid", F.col("ord").cast("long")), "_pid", "model", "v")
    names = profile_models.select(F.col("ord").cast("long").alias("_pid"), "ord", "area").distinct()
    prof = prof.join(names, "_pid").select("ord", "area", "v")
    return assign_area(docs, prof, vec="v", out=out, normalize=False)
