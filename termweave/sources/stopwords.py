"""Stopword sources.

The caller's type decides how a list is applied: Python words become a literal
set (``InSet`` inside the token filter); a table of words, of any length, is
anti-joined (``operators.terms.doc_tokens``).  Files are read through Spark, from
any path it can read, and stay a table.
"""

from __future__ import annotations

import functools
import os
import warnings
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import strip_ws

@functools.lru_cache(maxsize=None)
def spark_default(language: str = "french") -> tuple[str, ...]:
    """Spark's bundled stopword list for ``language`` (same words as
    ``StopWordsRemover.loadDefaultStopWords``), read from the MLlib jar so that
    no live session is needed."""
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    name = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
    for jar in sorted(os.listdir(jars)) if os.path.isdir(jars) else []:
        if jar.startswith("spark-mllib_"):
            with zipfile.ZipFile(os.path.join(jars, jar)) as z:
                if name in z.namelist():
                    text = z.read(name).decode("utf-8")
                    return normalise(text.splitlines())
    from pyspark.ml.feature import StopWordsRemover  # needs a live session

    return normalise(StopWordsRemover.loadDefaultStopWords(language))


def normalise(lines) -> tuple[str, ...]:
    """S7 rules: strip, lowercase, drop blanks, de-duplicate (sorted for a
    stable literal)."""
    return tuple(sorted({ln.strip().lower() for ln in lines if ln and ln.strip()}))


def stopwords_table(spark: SparkSession, path: str | None = None,
                    language: str = "french", lines: DataFrame | None = None) -> DataFrame:
    """S7/S8 as a one-column table ``word``.

    From a file, or a table of ``lines`` (column ``value``): one word per line,
    stripped, lower-cased, blanks dropped, distinct.  When there is neither, there is
    nothing at the path or no word is found, the default list is used (S8); any
    other failure to read is raised.
    """
    default = spark.createDataFrame([(w,) for w in spark_default(language)], "word string")
    if lines is None:
        if not path:
            return default
        try:
            lines = spark.read.text(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no stopwords at {path}: the {language} default list is used", stacklevel=2)
            return default
    words = (lines.select(F.lower(strip_ws(F.col("value"))).alias("word"))
             .filter(F.col("word") != "").distinct())
    # default words only when the source gave none (one number, before the plan runs)
    given = words.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return words.unionByName(default.filter(given == 0))
