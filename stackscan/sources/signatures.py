"""Signature files (S1, S2) and the compiled form the matchers use."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.functions.categories import category_names
from stackscan.functions.columns import union_all, unnest
from stackscan.functions.regex import literal_conditions, strip_suffix, to_spark_regex
from stackscan.model import FIELDS, KINDS, PATTERN_FILE_RECORD, SIGNATURE_SCHEMA, TECHNOLOGY_SCHEMA
from stackscan.operators.candidates import WANTED, entry_conditions, key_trigger, write_patterns

log = logging.getLogger(__name__)


def parse_signature_text(files: DataFrame) -> DataFrame:
    """Technology records of signature files given as text: ``file_ord``, ``file``, ``value``."""
    techs = F.from_json("value", f"map<string,{PATTERN_FILE_RECORD}>")
    return unnest(files, ["file_ord", "file"], F.map_entries(techs), "entry", "pos").select(
        "file_ord", "file", "pos", F.col("entry.key").alias("tech"), F.col("entry.value").alias("record"),
        (F.col("file_ord") * F.lit(1 << 32) + F.col("pos")).alias("tech_ord"),
    ).filter(~F.col("tech").startswith("_"))


def read_signature_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per technology record and file, in file order; unreadable files are skipped."""
    frames = [spark.createDataFrame([], "file_ord int, file string, value string")]
    for file_ord, path in enumerate(paths):
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as err:
            log.warning("signature file skipped: %s (%s)", path, err.getCondition())
            continue
        frames.append(text.select(F.lit(file_ord).alias("file_ord"),
                                  F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file"), "value"))
    return parse_signature_text(union_all(frames))


def resolve_overrides(records: DataFrame) -> DataFrame:
    """Keep the whole record of the last file that names a technology.

    A technology keeps the place of its first appearance, which decides ties later.
    """
    kept = F.struct("file_ord", "file", "pos", "record")
    return records.groupBy("tech").agg(
        F.max_by(kept, F.struct("file_ord", "pos")).alias("kept"), F.min("tech_ord").alias("tech_ord"),
    ).select("tech", "tech_ord", "kept.*")


def merge_custom(upstream: DataFrame, custom: DataFrame) -> DataFrame:
    """Upstream records overlaid with custom ones; custom records win."""
    tagged = union_all([upstream.withColumn("priority", F.lit(0)),
                        custom.withColumn("priority", F.lit(1))])
    kept = F.struct("file_ord", "file", "pos", "record", "tech_ord")
    return tagged.groupBy("tech").agg(
        F.max_by(kept, F.struct("priority", "file_ord", "pos")).alias("kept")).select("tech", "kept.*")


def _list_items(text: Column) -> Column:
    """Items of a JSON array of words and ids, as strings."""
    items = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|-?[0-9]+)'), F.lit(1))
    return F.when(text.startswith("["), F.transform(items, lambda x: F.regexp_replace(x, '^"|"$', "")))


def technologies(records: DataFrame) -> DataFrame:
    """One row per technology, with the fields no signature row repeats."""
    r = F.col("record")
    cats = F.coalesce(_list_items(r["categories"]), _list_items(r["cats"]))
    ids = F.coalesce(_list_items(r["cats"]), _list_items(r["categories"]))
    return records.select(
        "tech", "tech_ord", "file", "file_ord", r["description"].alias("description"),
        cats.alias("categories"), ids.alias("listed_categories"),
        F.filter(F.transform(ids, lambda x: x.try_cast("int")), lambda x: x.isNotNull()).alias("category_ids"),
        F.coalesce(r["higher_ed"], F.lit(False)).alias("higher_ed"),
        r["confidence"].alias("base_confidence"), r["website"].alias("website"),
        r["_legacy_names"].alias("legacy_names"), r["signal_polarity"].alias("signal_polarity"),
        r["html"].isNotNull().alias("has_html"),
        F.coalesce(r["scripts"], r["scriptSrc"]).isNotNull().alias("has_scripts"),
        r["headers"].isNotNull().alias("has_headers"), r["js"].isNotNull().alias("has_js"),
    )


def _list_kind(kind: str, patterns: Column, field: Column) -> Column:
    label = KINDS[kind][2]
    return F.transform(F.coalesce(patterns, F.array().cast("array<string>")), lambda p, i: F.struct(
        field.alias("field"), F.lit(kind).alias("kind"), i.alias("ord"), F.lit(None).cast("string").alias("key"),
        p.alias("pattern"), F.concat(F.lit(f"{label}: "), p).alias("label")))


def _map_kind(kind: str, field: str, patterns: Column, lower_key: bool, value_in_label: bool) -> Column:
    label = KINDS[kind][2]
    entries = F.coalesce(F.map_entries(patterns), F.array().cast("array<struct<key:string,value:string>>"))

    def row(e: Column, i: Column) -> Column:
        value = F.coalesce(e["value"], F.lit(""))
        text = F.concat(F.lit(f"{label}: "), e["key"])
        return F.struct(
            F.lit(field).alias("field"), F.lit(kind).alias("kind"), i.alias("ord"),
            (F.lower(e["key"]) if lower_key else e["key"]).alias("key"), value.alias("pattern"),
            (F.concat(text, F.lit("="), value) if value_in_label else text).alias("label"))
    return F.transform(entries, row)


def signatures(records: DataFrame) -> DataFrame:
    """One row per testable pattern."""
    r = F.col("record")
    script_field = F.when(r["scripts"].isNotNull(), "scripts").otherwise("scriptSrc")
    parts = F.concat(
        _list_kind("html", r["html"], F.lit("html")),
        _list_kind("script", F.coalesce(r["scripts"], r["scriptSrc"]), script_field),
        _list_kind("network", r["network"], F.lit("network")),
        _map_kind("header", "headers", r["headers"], True, True),
        _map_kind("meta", "meta", r["meta"], True, True),
        _map_kind("dom", "dom", r["dom"], False, True),
        _map_kind("js", "js", r["js"], False, False),
        _map_kind("cookie", "cookies", r["cookies"], False, False),
    )
    rows = unnest(records, ["tech", "tech_ord", "file"], parts, "s")
    return with_weights(rows.select("tech", "tech_ord", "file", "s.*"))


def with_weights(rows: DataFrame) -> DataFrame:
    """Add the kind's order and weight to signature rows."""
    kind = F.col("kind")
    kind_ord = weight = F.lit(None).cast("int")
    for name, (position, points, _) in KINDS.items():
        kind_ord = F.when(kind == name, position).otherwise(kind_ord)
        weight = F.when(kind == name, points).otherwise(weight)
    return rows.withColumn("kind_ord", kind_ord).withColumn("weight", weight).select(
        *[c.split()[0] for c in SIGNATURE_SCHEMA.split(", ")])


def load_library(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Technologies and signatures of an ordered list of signature files."""
    records = resolve_overrides(read_signature_files(spark, paths))
    return technologies(records), signatures(records)


#: Kinds whose patterns are searched for in a text; the others look up a key.
TEXT_KINDS = ("html", "script", "network")


@dataclass
class Library:
    """A checked signature library: its valid signatures as a table in library order, with what a
    detection tells about their technology and what makes them candidates; and the rejects."""

    technologies: DataFrame
    patterns: DataFrame
    rejected: DataFrame
    kinds: set[str] = field(default_factory=set)


def valid_regex(pattern: Column) -> Column:
    """Whether Spark's regex engine accepts a pattern. A single bad one would fail a whole job."""
    engine = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return engine.isNotNull()


def prepare_signatures(signatures: DataFrame) -> DataFrame:
    """Signatures with Spark's form of the pattern, its literals, and whether it is valid."""

    @F.pandas_udf(f"regex string, wanted {WANTED}, exact boolean")
    def translate(kinds: pd.Series, keys: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, key, pattern in zip(kinds, keys, patterns):
            plain = strip_suffix(pattern or "")
            if kind in TEXT_KINDS:
                branches, exact = literal_conditions(plain)
                wanted = [{"where": kind, "terms": [list(t) for t in terms]} for terms in branches] or [{"where": kind, "terms": []}]
            elif kind == "js":
                wanted, exact = [{"where": "key", "terms": [[key_trigger(kind, key or "")]]}], False
            else:
                wanted, exact = entry_conditions(kind, key or "", literal_conditions(plain)[0]), False
            rows.append((to_spark_regex(plain), wanted, exact))
        return pd.DataFrame(rows, columns=["regex", "wanted", "exact"])

    prepared = signatures.withColumn("_t", translate("kind", "key", "pattern")).select("*", "_t.regex", "_t.wanted", "_t.exact").drop("_t")
    return prepared.withColumn("valid", (F.col("kind") == "js") | valid_regex(F.col("regex")))


def rejected_signatures(prepared: DataFrame) -> DataFrame:
    """Signatures set aside because their pattern is no regular expression."""
    return prepared.filter(~F.col("valid")).select(
        "tech", "file", "kind", "key", "pattern", F.lit("invalid regular expression").alias("reason"))


def compile_library(technologies: DataFrame, signatures: DataFrame) -> Library:
    """Check every pattern and write the valid ones in library order, ready for matching.

    The library stays a table: it is written by Spark and read by the workers that match, so the
    driver holds nothing that grows with it.
    """
    prepared = prepare_signatures(signatures)
    known = technologies.select(
        "tech", category_names(F.col("categories")).alias("categories"), F.coalesce("higher_ed", F.lit(False)).alias("is_higher_ed"),
        F.coalesce("description", F.lit("")).alias("description")).dropDuplicates(["tech"])
    rows = prepared.filter("valid").drop("pattern").withColumnRenamed("regex", "pattern").withColumn("place", F.col("ord")).join(known, "tech", "left").select(
        "tech", "kind", "key", "pattern", "weight", "label", "exact", "wanted", "categories", "is_higher_ed", "description",
        "tech_ord", "kind_ord", "place")
    patterns = write_patterns(rows, ["tech_ord", "tech", "kind_ord", "place"], "ord")
    kinds = {r["kind"] for r in patterns.select("kind").distinct().collect()}
    return Library(technologies, patterns, rejected_signatures(prepared), kinds)


def signature_rows(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Technologies and signatures from (tech, kind, key, pattern) tuples, in list order.

    For small hand-written libraries; anything larger belongs in a signature file.
    """
    techs: dict[str, int] = {}
    counts: dict[tuple, int] = {}
    out = []
    for tech, kind, key, pattern in rows:
        techs.setdefault(tech, len(techs))
        ordinal = counts.get((tech, kind), 0)
        counts[tech, kind] = ordinal + 1
        text = pattern if key is None else (f"{key}={pattern}" if kind in ("header", "meta", "dom") else key)
        lookup = key.lower() if kind in ("header", "meta") else key
        out.append((tech, techs[tech], "custom.json", FIELDS[kind], kind, KINDS[kind][0], ordinal, lookup, pattern,
                    KINDS[kind][1], f"{KINDS[kind][2]}: {text}"))
    tech_rows = [(t, o, "custom.json", 0, "", None, None, None, False, None, None, None, None,
                  False, False, False, False) for t, o in techs.items()]
    return (spark.createDataFrame(tech_rows, TECHNOLOGY_SCHEMA),
            spark.createDataFrame(out, SIGNATURE_SCHEMA))
