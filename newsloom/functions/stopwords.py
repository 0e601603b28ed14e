"""Stop-word lists: Spark MLlib's bundled lists.

Spark jobs ask MLlib for them.  The DuckDB oracle, whose SQL is built without a session, reads the same lists from the
MLlib jar beside pyspark.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

LANG_FILES = {"en": "english", "es": "spanish", "fr": "french", "de": "german"}


@functools.lru_cache(maxsize=None)
def stop_words(lang: str) -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(LANG_FILES.get(lang, lang)))


@functools.lru_cache(maxsize=None)
def _jar_stop_words(lang: str) -> tuple[str, ...]:
    import pyspark

    # the driver sees pyspark/jars; a Python worker may import pyspark from a zip, so SPARK_HOME is tried too
    dirs = [os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    if os.environ.get("SPARK_HOME"):
        dirs.append(os.path.join(os.environ["SPARK_HOME"], "jars"))
    jars = [j for d in dirs for j in glob.glob(os.path.join(d, "spark-mllib_*.jar"))]
    name = LANG_FILES.get(lang, lang)
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            path = f"org/apache/spark/ml/feature/stopwords/{name}.txt"
            if path in z.namelist():
                return tuple(w for w in z.read(path).decode("utf-8").split("\n") if w)
    raise FileNotFoundError(f"no stop-word list for {lang}")


def sql_list(lang: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in _jar_stop_words(lang))
    return f"[{words}]"
