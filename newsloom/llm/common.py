"""Shared helpers of the subpackage: stored stages, a join that splits hot keys, small text rules.

Written for jobs that lose executors: every intermediate result that is read twice is a Parquet table below the
folder of ``spark.checkpoint.dir`` (written through Spark's committer), never a cached block or a local file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import scratch_path

# A key is hot when it holds more than 1/HOT_PARTS of all rows, so at most HOT_PARTS - 1 keys can be hot.
HOT_PARTS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def field_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def left_join_skewed(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``; ``right`` has one row per key and in ``count`` the key's rows in ``left``.

    Keys with more than ``total / HOT_PARTS`` rows (fewer than HOT_PARTS keys, whatever the data) are joined by
    broadcast, so no task receives all rows of a hot key; the rest is an ordinary shuffle join.  ``left`` is read
    twice and should be a stored table.  Null keys match nothing and keep null columns.
    """
    payload = [c for c in right.columns if c not in (key, count)]
    is_hot = F.col(count) * F.lit(HOT_PARTS) > F.lit(total)
    hot = right.where(is_hot).select(key, *payload, F.lit(True).alias("__hot"))
    cold = right.where(~is_hot).select(key, *payload)
    tagged = left.join(F.broadcast(hot), key, "left")
    first = tagged.where(F.col("__hot")).drop("__hot")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return first.unionByName(rest.select(*first.columns))


def inner_join_skewed(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` JOIN ``right`` on ``key``, with the same split of hot keys and the same reading of ``count``."""
    payload = [c for c in right.columns if c not in (key, count)]
    is_hot = F.col(count) * F.lit(HOT_PARTS) > F.lit(total)
    hot, cold = (right.where(w).select(key, *payload) for w in (is_hot, ~is_hot))
    first = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return first.unionByName(rest.select(*first.columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
