"""CSV ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackscan.model import LEDGER_COLUMNS, REFERENCE_LEDGER_COLUMNS


#: Rows in one file: a file with line breaks in its cells is read by one task.
FILE_ROWS = 100_000


def read_ledger(spark: SparkSession, path: str, columns: tuple[str, ...] = LEDGER_COLUMNS) -> DataFrame:
    """A quoted CSV ledger; quoted cells may hold commas, doubled quotes and line breaks."""
    schema = ", ".join(f"{c} string" for c in columns)
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", True).csv(path).fillna("", list(columns)))


def read_reference_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path, REFERENCE_LEDGER_COLUMNS)


def write_ledger(rows: DataFrame, path: str, columns: tuple[str, ...] = LEDGER_COLUMNS) -> None:
    """A quoted CSV ledger in files of at most ``FILE_ROWS`` rows, so that no task reads the whole."""
    (rows.select(*columns).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("quote", '"')
     .option("escape", '"').option("emptyValue", "").csv(path))
