"""Result documents and the scan store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str) -> None:
    """Scan documents as JSON lines."""
    documents.write.mode("overwrite").json(path)


def document_json(documents: DataFrame) -> DataFrame:
    """Scan documents as one JSON string each."""
    return documents.select("site", F.to_json(F.struct(*documents.columns)).alias("document"))


def scan_rows(documents: DataFrame) -> DataFrame:
    """One row per scan for the store."""
    return documents.select(
        "url", "final_url", "timestamp", "technologies", F.col("inferred_stack").alias("stack"), "scanned_pages",
        F.struct("response_code").alias("meta"), F.to_date("timestamp").alias("scan_date"))


def detected_rows(documents: DataFrame) -> DataFrame:
    """One row per scan and detected technology for the store."""
    rows = documents.select("url", "timestamp", F.explode("technologies").alias("t"))
    return rows.select(
        "url", "timestamp", F.col("t.name").alias("tech"), "t.confidence", "t.categories", "t.version",
        "t.is_higher_ed", F.to_date("timestamp").alias("scan_date"))


def error_rows(scans: DataFrame) -> DataFrame:
    """Failed scans for the store."""
    return scans.filter("error is not null").select("url", "timestamp", "error", F.to_date("timestamp").alias("scan_date"))


def append_store(rows: DataFrame, store: str, table: str, batch: str | None = None) -> None:
    """Add rows to a table of the store, partitioned by scan date.

    With a ``batch`` name the rows lie in a partition of their own, which the same batch replaces
    when it is run again; so a retried job adds its rows once.
    """
    if batch is None:
        rows.write.mode("append").partitionBy("scan_date").parquet(f"{store}/{table}")
    else:
        (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch", "scan_date").parquet(f"{store}/{table}"))
