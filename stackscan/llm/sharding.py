"""Sharding: proportional stratified interleaving (DataFrame functions only).

Rows are shuffled within their source by a seeded hash, ranked, and given the fractional rank
(rank - 1/2) / rows of the source. Sorted by it, every stretch of rows holds the sources in the
proportions of the whole; the order is cut into shards of equal length.

Neither ranking gathers a source or the table in one task. A rank is the number of rows in the cells
before a row's own (a running sum over a table of counts, one row per cell) plus the row's number
inside its cell. Cells are slices of the hash or of the fractional rank, ``cells`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.llm.common import kept


def _numbered(rows: DataFrame, within: str, cell: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the place from 0 within the group ``within``, ordered by (cell, order)."""
    celled = rows.withColumn("cell", cell)
    counts = celled.groupBy(within, "cell").agg(F.count("*").alias("n"))
    before = counts.select(F.col(within).alias("at_group"), F.col("cell").alias("at_cell"), (
        F.sum("n").over(Window.partitionBy(within).orderBy("cell")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy(within, "cell").orderBy(*order))
    same = F.col(within).eqNullSafe(F.col("at_group")) & (F.col("cell") == F.col("at_cell"))
    return (celled.withColumn("inner", inner).join(before, same)
            .withColumn(name, F.col("before") + F.col("inner") - 1).drop("cell", "at_group", "at_cell", "before", "inner"))


def stratified_shards(rows: DataFrame, shards: int = 16, stratum: str = "source", order: tuple[str, ...] = ("doc_id", "size", "text_crc32"),
                      seed: int = 7, cells: int = 4096) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Shards differ by one row at most, and each holds every source in proportion, to within about one row
    per source. A null source is a source of its own. ``order`` names the columns that identify a row;
    rows equal in all of them may change places, which changes nothing in the result. Rows are shuffled
    by the hash of ``seed`` and ``order``. Columns named shard or slot are replaced. ``rows`` is written
    once before ranking. ``cells`` bounds the running sums; a cell holds about rows / cells rows, whatever
    the source. An empty table gives an empty result.
    """
    base = kept(rows.drop("shard", "slot").select(
        F.struct("*").alias("row"), F.col(stratum).alias("stratum"), F.struct(*order).alias("ties"),
        F.xxhash64(F.lit(seed), *order).alias("hash")))
    # the upper bits of the signed hash, so that cells follow the order of the hash
    ranked = _numbered(base, "stratum", F.shiftright("hash", 64 - (cells.bit_length() - 1)), ["hash", "ties"], "rank")
    sizes = base.groupBy(F.col("stratum").alias("of")).agg(F.count("*").alias("size"))
    placed = ranked.join(sizes, F.col("stratum").eqNullSafe(F.col("of"))).select(
        "row", "hash", "ties", ((F.col("rank") + F.lit(0.5)) / F.col("size")).alias("fraction"), F.lit(0).alias("all"))
    whole = _numbered(placed, "all", F.floor(F.col("fraction") * cells).cast("int"), ["fraction", "hash", "ties"], "place")
    return _cut(whole, base.count(), shards).select("row.*", "shard", "slot")


def _cut(whole: DataFrame, total: int, shards: int) -> DataFrame:
    """Contiguous shards of total / shards rows, the first total % shards of them one row longer."""
    small, longer = divmod(total, shards)
    edge, place = longer * (small + 1), F.col("place")
    first = place < edge
    shard = F.when(first, F.floor(place / F.lit(small + 1))).otherwise(longer + F.floor((place - edge) / F.lit(max(small, 1))))
    return (whole.withColumn("shard", shard.cast("int"))
            .withColumn("slot", place - F.col("shard") * small - F.least(F.col("shard"), F.lit(longer))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text, null: none, plus 1) and text_crc32 of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
