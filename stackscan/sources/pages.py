"""Page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.operators.evidence import with_page_inputs


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of crawled pages: ``page_id``, ``url``, ``html`` and any crawler columns.

    Matching is bound by CPU. For few large files lower ``spark.sql.files.maxPartitionBytes`` or
    raise ``spark.sql.files.minPartitionNum``: the read is split finer and no page is shuffled.
    """
    return with_page_inputs(spark.read.format(fmt).load(path))


def with_site(pages: DataFrame) -> DataFrame:
    """Add the site a page belongs to: its host without ``www.``."""
    return pages.withColumn("site", urls.root_host(F.col("url")))
