"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space between words, as a regex class; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder, so that lost executors do not cost its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into a fresh shared folder and read again."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text without other letters takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def salt_of(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def join_hot(left: DataFrame, right: DataFrame, key: list[str], by: str, salts: int = 256, how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key, where one key may hold a third of ``left``.

    The rows of a key are first dealt out by a salt taken from ``by``. Only the distinct (key, salt)
    pairs, at most ``salts`` per key, meet the right side; the rows then join those pairs, so no task
    gets a whole key. Null keys match nothing.
    """
    salted = left.withColumn("_salt", salt_of(by, salts))
    spread = salted.select(*key, "_salt").distinct().join(right, key)
    return salted.join(spread, [*key, "_salt"], how).drop("_salt")
