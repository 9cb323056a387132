"""Small tables for the tests, and the given ones."""

from pyspark.sql import types as T

from stackscan.llm.common import table

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside, as extra columns of the input.
CLASHING = ("row", "kept", "shard", "slot", "h", "words", "units", "id", "sha", "score", "component_id", "sequence_id", "offset", "removed", "rank", "group_size")

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
SPACED = "a  b\t\n  c   d \x0b e\x0c f"


def edge_rows() -> list[tuple]:
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t\n ", None, None, 3), (4, LONG, "en", "s", len(LONG)),
            (5, "one", "en", "s", 3), (6, SPACED, "de", "t", 5), (None, "no id at all here, six words", "en", "s", 1), (None, None, None, None, None),
            (7, "same words in two rows of this table. " * 20, "en", "s", 1), (8, "same words in two rows of this table. " * 20, "en", "t", 1),
            (9, "Row that repeats", "fr", "s", 1), (9, "Row that repeats", "fr", "s", 1), (9, "row THAT repeats", "fr", "s", 1),
            (10, "日本語のテキスト 😀 é́ \xa0 x", "ja", "u", 9), (11, "x" * 5000, "en", "s", 1), (-5, "Negative id.", "en", "s", 1)]
    return rows


def edge_docs(spark, clashing: bool = True):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    if clashing:
        from pyspark.sql import functions as F
        docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf: str = SF):
    return table(spark, sf, "documents")
