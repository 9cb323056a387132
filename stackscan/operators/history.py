"""Questions over a store of past scans (H1-H8).

``scans`` has a row per scan (``url``, ``timestamp``), ``detected`` a row per scan and
technology (``url``, ``timestamp``, ``tech`` ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions.columns import unnest


def due_urls(worklist: DataFrame, scans: DataFrame, now: Column, ttl: str = "24 HOURS") -> DataFrame:
    """Worklist URLs without a scan inside the time to live (H1)."""
    recent = scans.filter(F.col("timestamp") >= now - F.expr(f"INTERVAL {ttl}")).select("url").distinct()
    return worklist.join(recent, "url", "left_anti")


def technology_stats(detected: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Per technology: detections, distinct URLs, last seen, latest attributes (H2).

    The set of URLs grows with the data, so it is kept as rows (``technology_urls``), not as an
    array of one row.
    """
    by_url = detected.groupBy("tech", "url").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"),
        *[F.max_by(a, "timestamp").alias(a) for a in attributes])
    return by_url.groupBy("tech").agg(
        F.sum("n").alias("detection_count"), F.count("*").alias("url_count"),
        F.max("last").alias("last_seen"), *[F.max_by(a, "last").alias(a) for a in attributes])


def technology_urls(detected: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """The URLs each technology was seen on, with detections, last sighting and the attributes of
    the latest detection (H2)."""
    return detected.groupBy("tech", "url").agg(
        F.count("*").alias("detections"), F.max("timestamp").alias("last_seen"),
        *[F.max_by(a, "timestamp").alias(a) for a in attributes])


def sum_technology_urls(parts: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """``technology_urls`` from several of them put together (H2)."""
    return parts.groupBy("tech", "url").agg(
        F.sum("detections").alias("detections"), F.max("last_seen").alias("last_seen"),
        *[F.max_by(a, "last_seen").alias(a) for a in attributes])


def merge_technology_urls(old: DataFrame, new: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Running form of ``technology_urls`` plus that of newly arrived detections (H2)."""
    return sum_technology_urls(old.unionByName(new), attributes)


def stats_from_urls(tech_urls: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Technology statistics from the per-URL rows, with the latest attributes (H2)."""
    return tech_urls.groupBy("tech").agg(
        F.sum("detections").alias("detection_count"), F.count("*").alias("url_count"),
        F.max("last_seen").alias("last_seen"), *[F.max_by(a, "last_seen").alias(a) for a in attributes])


def last_scans(scans: DataFrame, limit: int = 10, tie: str = "scan_id") -> DataFrame:
    """The latest scans of every URL, newest first (H3). Map tasks already keep only ``limit``."""
    w = Window.partitionBy("url").orderBy(F.desc("timestamp"), F.desc(tie))
    return scans.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= limit)


def top_technologies(stats: DataFrame, limit: int = 50) -> DataFrame:
    """Technologies with the most detections (H4)."""
    return stats.orderBy(F.desc("detection_count"), "tech").limit(limit)


def scan_changes(scans: DataFrame, now: Column, days: int = 30, tie: str = "scan_id") -> DataFrame:
    """Technologies added or removed between a URL's last two scans in range (H5).

    ``scans`` carries ``technologies``, the names found; URLs with one scan give no rows.
    """
    ranged = scans.filter(F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS"))
    last_two = last_scans(ranged, 2, tie).select("url", "recency", "timestamp", "technologies")
    names = lambda n: F.max_by("technologies", F.when(F.col("recency") == n, F.lit(1)))
    pairs = last_two.groupBy("url").agg(
        F.max("timestamp").alias("timestamp"), names(1).alias("latest"), names(2).alias("previous"),
        F.count("*").alias("n")).filter("n = 2")
    changes = F.concat(
        F.transform(F.array_except("latest", "previous"), lambda t: F.struct(F.lit("added").alias("type"), t.alias("technology"))),
        F.transform(F.array_except("previous", "latest"), lambda t: F.struct(F.lit("removed").alias("type"), t.alias("technology"))))
    return unnest(pairs, ["url", "timestamp"], changes, "c").select("url", "c.*", "timestamp")


def change_sets(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, removed and unchanged technologies of URLs present in both scans (H6).

    Inputs have a row per (url, tech). They are united and grouped rather than joined, so the
    rows of a frequent URL or technology are combined before the shuffle.
    """
    both = previous.select("url", "tech", F.lit(1).alias("side")).unionByName(
        current.select("url", "tech", F.lit(2).alias("side")))
    per_tech = both.groupBy("url", "tech").agg(F.bit_or("side").alias("sides"))
    # A URL has at most one row per technology here, so its window is bounded by the library.
    scanned = F.bit_or("sides").over(Window.partitionBy("url"))
    status = F.when(F.col("sides") == 3, "unchanged").when(F.col("sides") == 2, "added").otherwise("removed")
    return per_tech.withColumn("scanned", scanned).filter("scanned = 3").select("url", "tech", status.alias("change"))


def active_sites(websites: DataFrame) -> DataFrame:
    """Sites to scan periodically (H7)."""
    return websites.filter("active").select("url")


def state_counts(jobs: DataFrame, state: str = "state") -> DataFrame:
    """Jobs per state and, under ``total``, all of them (H8)."""
    rolled = jobs.rollup(state).agg(F.count("*").alias("jobs"), F.grouping(state).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(state)).alias("state"), "jobs")
