"""Sources and sinks (section A): CSV / Parquet / JSON / text and ML model writers.

Writers never overwrite what is being read: artefacts go to versioned folders (``v=YYYYMMDD``), and the URL ledger is
append-only, one partition per batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

ARTICLE_SCHEMA = "source string, url string, title string, content string, scraping_date timestamp"
FEEDBACK_SCHEMA = "url string, rating string, timestamp timestamp"
LEDGER_SCHEMA = "url string"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_articles_csv(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA, sep: str = ";") -> DataFrame:
    """A1: header, ``sep``-separated, quoted multi-line content."""
    return (spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """CSV has no nested types: arrays, maps and structs leave as JSON strings."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_articles_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite", compression: str = "none") -> None:
    """A3: header + ``sep`` separator (also ',' variant), nested columns flattened."""
    # the writer trims values by default: keep text exactly as it is
    (flatten_for_csv(df).write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("compression", compression).csv(path))


def read_articles_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A2: processed articles; a missing path gives an empty table (of ``schema`` when given)."""
    try:
        r = spark.read
        if schema:
            r = r.schema(schema)
        return r.parquet(path)
    except AnalysisException as e:
        if _no_path(e):
            return _empty(spark, schema or ARTICLE_SCHEMA)
        raise


def write_articles_parquet(df: DataFrame, path: str, run_date: str, mode: str = "append") -> None:
    """A4: Parquet corpus snapshot partitioned by run date (partition pruning on later reads)."""
    df.withColumn("run_date", F.lit(run_date)).write.mode(mode).partitionBy("run_date").parquet(path)


def append_articles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A5: existing union new, columns aligned by name (missing -> null)."""
    return existing.unionByName(new, allowMissingColumns=True)


def _no_path(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or str(e))


def _ledger_batches(spark: SparkSession, root: str) -> DataFrame:
    """All (url, batch) rows; only a missing folder counts as an empty ledger."""
    try:
        return spark.read.option("header", True).schema(f"{LEDGER_SCHEMA}, batch string").csv(root)
    except AnalysisException as e:
        if _no_path(e):
            return _empty(spark, f"{LEDGER_SCHEMA}, batch string")
        raise


def ledger_before(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The ledger without the batch ``version`` itself, so a replayed batch does not see its own URLs."""
    return _ledger_batches(spark, root).where(F.col("batch") != version).select("url").distinct()


def load_processed_urls(spark: SparkSession, root: str) -> DataFrame:
    """The URL ledger (one column ``url``); missing -> empty."""
    return _ledger_batches(spark, root).select("url").distinct()


def append_processed_urls(spark: SparkSession, root: str, new_urls: DataFrame, version: str) -> DataFrame:
    """Append one partition with the batch's distinct URLs; returns the whole ledger, distinct.

    A batch owns its folder and overwrites it, so a replay changes nothing; no other batch's URLs are rewritten, and
    there is no pointer to lose: a crash in a write leaves that batch's folder without committed files, nothing else.
    """
    new_urls.select("url").distinct().write.mode("overwrite").option("header", True).csv(f"{root}/batch={version}")
    return load_processed_urls(spark, root)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Append (url, rating, timestamp) rows; every part file carries its header, read back with header=True."""
    (feedback.select("url", "rating", F.col("ts").alias("timestamp") if "ts" in feedback.columns else "timestamp")
     .write.mode("append").option("header", True).csv(path))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.option("header", True).schema(FEEDBACK_SCHEMA).csv(path)
    except AnalysisException as e:
        if _no_path(e):
            return _empty(spark, FEEDBACK_SCHEMA)
        raise


def save_cluster_metadata(spark: SparkSession, path: str, model_name: str, model: KMeansModel) -> None:
    """One JSON record per model: name, k, inertia (training cost), centroids (k rows)."""
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    inertia = float(model.summary.trainingCost) if model.hasSummary else None
    spark.createDataFrame([(model_name, len(centers), inertia, centers)],
                          "model_name string, n_clusters int, inertia double, centroids array<array<double>>") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/model={model_name}")


def save_model_version(model, root: str, version: str) -> str:
    """Date-stamped model artefact (MLlib writer)."""
    path = f"{root}/v={version}"
    model.write().overwrite().save(path)
    return path


def save_centroid_version(centroids: DataFrame, root: str, version: str) -> str:
    """A13 for a fit by shared passes: the (cluster, centroid) table that the incremental runs read."""
    path = f"{root}/centroids/v={version}"
    centroids.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_model_version(root: str, version: str) -> KMeansModel:
    return KMeansModel.load(f"{root}/v={version}")


def save_embeddings_version(df: DataFrame, root: str, version: str) -> str:
    """Date-stamped embedding table."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_digest(digests: DataFrame, root: str, run_stamp: str, key: str = "area") -> str:
    """One HTML document per area and run (``<root>/run=<stamp>/<key>=<value>/part-*.txt``)."""
    path = f"{root}/run={run_stamp}"
    digests.select(key, "html").write.mode("overwrite").partitionBy(key).text(path)
    return path


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    # (the text() argument, not an option: text() would reset the option to its own default)
    # the text writer ends every row with a line separator: drop it to get the document back
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("html"), "*").drop("value")
