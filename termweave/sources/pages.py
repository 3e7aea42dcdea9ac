"""Page sources and input predicates (S1-S6) and page sets.

Pages arrive as a table ``(page_id, url, html)`` or as a folder of HTML files;
the HTTP fetch itself is not part of this library.  A page "fails to load"
when its URL is not valid (scheme and network location both present) or its
markup is missing; it then carries ``error`` and empty text and does not stop
the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import content as C
from termweave.session import spread

# Fixed values (must equal the reference's rules):
# - a URL is valid when it has a scheme and a network location
URL_VALID = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
# - error text of a page that could not be read
FETCH_ERROR = "Failed to fetch URL"

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pages`` table, spread over the cluster when under-partitioned."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return spread(df, "page_id")


def read_html_folder(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """S1 for folders: every file becomes ``(url, html)``; ``url`` is the file path."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path))
    return raw.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def url_valid(url: F.Column | str) -> F.Column:
    """Scheme and netloc both non-empty."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(u.rlike(URL_VALID), F.lit(False))


def host(url: F.Column | str) -> F.Column:
    """Network location, lower-cased ('' when invalid)."""
    u = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(u, HOST, 1))


def fetch_status(pages: DataFrame) -> DataFrame:
    """Add ``error`` (null when the page can be read)."""
    bad = ~url_valid("url") | F.col("html").isNull()
    return pages.withColumn("error", F.when(bad, F.lit(FETCH_ERROR)))


def dedupe_by_url(pages: DataFrame) -> DataFrame:
    """One row per URL (the smallest ``page_id`` wins).  Only ids and URLs are
    aggregated; the markup is picked by the unique ``page_id``."""
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id")
    return pages.join(first, "page_id", "left_semi").select("url", "page_id", "html")


def input_ok(entries: DataFrame) -> DataFrame:
    """S3 per set over ``(set_id, ord, url)`` entries: target non-empty and
    starting with 'http', at least one competitor, all competitors 'http'."""
    http = F.coalesce(F.col("url").startswith("http"), F.lit(False))
    is_t = F.col("ord") == 0
    return entries.groupBy("set_id").agg(
        F.coalesce(F.max(F.when(is_t, http)), F.lit(False)).alias("target_ok"),
        F.count_if(~is_t).alias("competitors"),
        F.coalesce(F.bool_and(F.when(~is_t, http)), F.lit(True)).alias("competitors_ok"),
    ).withColumn("runnable", F.col("target_ok") & (F.col("competitors") >= 1) & F.col("competitors_ok"))


def comparable_sets(loaded: DataFrame, min_pages: int = 2) -> DataFrame:
    """Sets with at least ``min_pages`` distinct URLs read successfully."""
    ok = loaded.filter(F.col("error").isNull())
    return ok.groupBy("set_id").agg(F.countDistinct("url").alias("loaded")).filter(
        F.col("loaded") >= min_pages)


def content_with_status(pages: DataFrame, sep: str = "") -> DataFrame:
    """S4 + P1-P9 in one pass: content rows for readable pages; the others have
    ``error``, ``all_text = ''`` and no content."""
    status = fetch_status(pages)
    readable = status.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    out = C.page_content(readable, keep=("page_id", "url", "error"), sep=sep)
    return out.withColumn("all_text", F.coalesce("all_text", F.lit("")))
