"""Exact de-duplication: sorted runs of digests merged in a tree (DataFrame functions only).

Going up, every document starts in a leaf run, chosen by a hash of its id. A run holds one entry per
distinct digest: how many documents it stands for and which of them stays. In each round 2**bits runs
of the round before meet in one, and equal entries merge, so an entry of a frequent text is merged
with at most 2**bits others at a time. A round's entries are dealt out by (run, digest): the tree
narrows while the number of tasks stays. Going down, the leaf entries take the result of the root
(at most as many per digest as there are leaves), and the documents that of their leaf entry; no
task ever holds all copies of a text.

An entry is verified, not trusted: entries are equal only if SHA-256, length in bytes and a second,
independent 64-bit hash agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import kept, lower_ascii

ENTRY = ["sha", "n_bytes", "second"]


def digests(docs: DataFrame, leaves: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest columns, leaf run) of every row; a null text counts as empty."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return (docs.select(F.col(id_col).alias("id"), text.alias("t"))
            .select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("long").alias("n_bytes"),
                    F.xxhash64("t").alias("second"), F.pmod(F.xxhash64("id"), F.lit(leaves)).cast("int").alias("run")))


def tree_merge(entries: DataFrame, leaves: int, bits: int, keep: str) -> DataFrame:
    """One entry (digest columns, keep_id, group_size) per distinct text.

    ``entries`` has (run, digest columns, id). Rows without an id never stay while another row does.
    """
    pick = {"largest": F.max, "smallest": F.min}[keep]
    runs = entries.groupBy("run", *ENTRY).agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    width = leaves
    while width > 1:
        width = -(-width // 2**bits)
        runs = (runs.withColumn("run", F.shiftright("run", bits)).groupBy("run", *ENTRY)
                .agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                leaves: int = 256, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the ``keep`` ("largest" or "smallest") id stays. Rows that repeat an id and a text count as
    copies, and all rows with the id that stays are marked as kept. Rows without an id are kept only if
    their whole group has none. ``leaves`` must be a power of 2**bits; it bounds how many entries of one
    text meet in one task on the way down. An empty table gives an empty result.
    """
    found = kept(digests(docs, leaves, id_col, text_col))
    root = tree_merge(found, leaves, bits, keep)
    leaf = found.select("run", *ENTRY).distinct().join(root, ENTRY)
    return found.join(leaf, ["run", *ENTRY]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one row of each group of equal texts.

    Only the ids and digests of dropped rows travel to the documents. Rows that repeat id and text stay once.
    """
    found = exact_dedup(docs, id_col, text_col, keep)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone"), F.col("text_sha256").alias("gone_sha")).distinct()
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    rest = rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    return rest.dropDuplicates(["id", "sha"]).select("row.*")
