"""Labelled evidence snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.model import SNAPSHOT_SCHEMA

# Characters of a cookie value and of a probe body kept in a snapshot.
COOKIE_CHARS = 64
BODY_CHARS = 512


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """``<folder>/<technology>/*.json`` with the HTML of the companion files.

    A record's ``html_file`` names its companion; its last two parts, technology folder and file,
    find it below ``folder``. Files that do not parse are skipped; a missing companion gives empty
    HTML. ``ord`` is the path, which orders the snapshots. The folders are what Spark is given, not the
    files: those it lists folder by folder, instead of one by one as so many tables.
    """
    def place(path: Column) -> Column:
        return F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)

    schema = f"{SNAPSHOT_SCHEMA}, _corrupt string"
    parsed = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*/", pathGlobFilter="*.json")
        .withColumn("path", F.input_file_name()))
    good = parsed.filter("_corrupt is null and technology is not null").drop("_corrupt")
    html = spark.read.text(f"{folder}/*/", wholetext=True, pathGlobFilter="*.html").select(
        place(F.input_file_name()).alias("place"), F.col("value").alias("html"))
    joined = good.withColumn("place", place(F.col("html_file"))).join(html, "place", "left")
    return joined.withColumns({"html": F.coalesce("html", F.lit("")), "ord": F.col("path")}).drop("place")


def write_files(files: DataFrame, folder: str) -> None:
    """The ``text`` of every row as the file ``path`` below ``folder``, which all executors share.

    A file is written under a hidden name and moved into place when it is complete: a lost task leaves
    no half file, and its next attempt replaces what is there. Rows without a text make no file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                place, name = f"{root}/{path}".rsplit("/", 1)
                hidden = f"{place}/.{name}-{uuid.uuid4().hex}"
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                with store.open_output_stream(hidden) as out:
                    out.write(text.encode())
                store.move(hidden, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    files.select("path", "text").filter("text is not null").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def snapshot_rows(captures: DataFrame, min_confidence: int = 30) -> DataFrame:
    """Snapshot rows from captured pages, with long values cut.

    ``captures`` holds the evidence columns, ``technology``, ``final_url``, ``captured_at``,
    ``response_status``, ``probe_results`` and ``matched_patterns``.
    """
    own = F.exists("matched_patterns", lambda m: (F.lower(m["name"]) == F.lower("technology"))
                   & (m["confidence"] >= min_confidence))
    dom = F.struct(F.col("dom.title").alias("title"), F.col("dom.body_classes").alias("bodyClasses"),
                   F.col("dom.body_id").alias("bodyId"), F.col("dom.head_content").alias("headContent"),
                   F.col("has_elements").alias("hasElements"), F.col("js_objects").alias("jsObjects"))
    cookies = F.transform("cookies", lambda c: F.struct(
        c["name"].alias("name"), F.substring(c["value"], 1, COOKIE_CHARS).alias("value"), c["domain"].alias("domain")))
    probes = F.transform_values("probe_results", lambda k, p: F.struct(
        p["url"].alias("url"), p["status"].alias("status"),
        F.when(p["redirect_to"] != p["url"], p["redirect_to"]).alias("redirect_to"),
        F.substring(p["body_excerpt"], 1, BODY_CHARS).alias("body_excerpt")))
    stem = F.concat(urls.tech_slug(F.col("technology")), F.lit("/"), urls.host_slug(F.col("url")))
    return captures.select(
        "technology", "url", "final_url", "captured_at", "response_status", F.concat(stem, F.lit(".html")).alias("html_file"),
        F.struct("headers", "scripts", "meta", cookies.alias("cookies"), dom.alias("dom"), "api_endpoints",
                 "version_info").alias("evidence"),
        probes.alias("probe_results"), "matched_patterns",
        F.coalesce(own, F.lit(False)).alias("target_tech_matched"), "html")


def write_snapshots(rows: DataFrame, folder: str) -> None:
    """Evidence as JSON per technology, HTML in a table of its own beside it."""
    slug = urls.tech_slug(F.col("technology"))
    rows.drop("html").withColumn("tech_slug", slug).write.mode("append").partitionBy("tech_slug").json(f"{folder}/evidence")
    rows.select("html_file", "captured_at", "html", slug.alias("tech_slug")).write.mode("append").partitionBy("tech_slug").parquet(f"{folder}/html")


def read_snapshot_table(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots written by ``write_snapshots``."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).json(f"{folder}/evidence")
    html = spark.read.parquet(f"{folder}/html").select("html_file", "captured_at", "html")
    return rows.join(html, ["html_file", "captured_at"], "left").withColumns({
        "html": F.coalesce("html", F.lit("")), "ord": F.concat_ws("#", "html_file", F.col("captured_at").cast("string"))})
