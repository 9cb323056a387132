"""Registered queries: scan history and streaming jobs (H, T).

Events are read as scans: a user is a URL, an event type a technology.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.operators import history
from stackscan.plans import demo
from stackscan.streaming import jobs



def _now() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _as_detected(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("scan_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k")).alias("tech"), "props",
        F.col("value").cast("int").alias("confidence"))


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    return _as_detected(spark.read.parquet(f"{sf}/events.parquet"))


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    """One scan per URL and day with the set of technologies seen."""
    kind = F.split_part("tech", F.lit("-"), F.lit(1))
    return _detected(spark, sf).groupBy("url", F.to_date("timestamp").alias("day")).agg(
        F.array_sort(F.collect_set(kind)).alias("technologies"), F.max("timestamp").alias("timestamp"),
        F.min("scan_id").alias("scan_id"))


def due_urls(spark: SparkSession, sf: str) -> DataFrame:
    worklist = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("u"), (F.col("c_custkey") % 200).cast("string")).alias("url")).distinct()
    scans = _detected(spark, sf)
    return history.due_urls(worklist, scans, F.lit(scans.agg(F.max("timestamp")).first()[0]))


def technology_stats(spark: SparkSession, sf: str) -> DataFrame:
    return history.technology_stats(_detected(spark, sf), ("props",))


def technology_urls(spark: SparkSession, sf: str) -> DataFrame:
    return history.technology_urls(_detected(spark, sf))


def technology_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the first half of the events, brought up to date with the second."""
    rows = _detected(spark, sf)
    old, new = rows.filter("scan_id % 2 = 0"), rows.filter("scan_id % 2 = 1")
    props = ("props",)
    merged = history.merge_technology_urls(history.technology_urls(old, props), history.technology_urls(new, props), props)
    return history.stats_from_urls(merged, props)


def last_scans(spark: SparkSession, sf: str) -> DataFrame:
    return history.last_scans(_detected(spark, sf)).select("url", "scan_id", "recency")


def top_technologies(spark: SparkSession, sf: str) -> DataFrame:
    return history.top_technologies(history.technology_stats(_detected(spark, sf)))


def scan_changes(spark: SparkSession, sf: str) -> DataFrame:
    return history.scan_changes(_scans(spark, sf), _now())


def change_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _detected(spark, sf)
    return history.change_sets(rows.filter(F.col("timestamp") < _now()), rows.filter(F.col("timestamp") >= _now()))


def active_sites(spark: SparkSession, sf: str) -> DataFrame:
    sites = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("url"), (F.col("c_acctbal") > 0).alias("active"))
    return history.active_sites(sites)


def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    return history.state_counts(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus")


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}*.parquet")


def _table(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over everything there is and read the table it wrote."""
    folder = jobs.shared_folder(spark)
    jobs.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_detect(spark: SparkSession, sf: str) -> DataFrame:
    pages = demo.decorate(_stream(spark, sf, "pages"))
    found = jobs.detect_stream(pages, demo.library(spark), ["page_id"], demo.CONFIG)
    return _table(spark, found.select("page_id", "rank", "tech", "confidence", "version"))


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    found = _as_detected(_stream(spark, sf, "events")).withColumn("tech", F.split_part("tech", F.lit("-"), F.lit(1)))
    folder = jobs.shared_folder(spark)
    jobs.run_updates(jobs.daily_rollup(found, site="url"), f"{folder}/days", f"{folder}/checkpoint").awaitTermination()
    rolled = jobs.current_rows(spark, f"{folder}/days", ["day", "url", "tech"])
    return rolled.select(F.col("day").cast("date").alias("day"), "url", "tech", "confidence", "pages")


def stream_first_scans(spark: SparkSession, sf: str) -> DataFrame:
    accepted = _table(spark, jobs.first_scans(_as_detected(_stream(spark, sf, "events"))))
    return accepted.select("url", F.unix_micros("timestamp").alias("at_us"))


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    folder = jobs.shared_folder(spark)
    _scans(spark, sf).write.parquet(f"{folder}/scans")
    scans = spark.readStream.schema(_scans(spark, sf).schema).parquet(f"{folder}/scans")
    events = _table(spark, jobs.change_stream(scans.drop("day")))
    return events.select("url", F.unix_micros("timestamp").alias("at_us"), "type", "technology")


def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    folder = jobs.shared_folder(spark)
    jobs.maintain_stats(_as_detected(_stream(spark, sf, "events")), f"{folder}/stats", f"{folder}/checkpoint", ("props",)).awaitTermination()
    return history.stats_from_urls(jobs.running_urls(spark, f"{folder}/stats", ("props",)), ("props",))


QUERIES = {f.__name__: f for f in (
    due_urls, technology_stats, technology_urls, technology_upsert, last_scans, top_technologies, scan_changes, change_sets,
    active_sites, state_counts, stream_detect, stream_daily, stream_first_scans, stream_changes, stream_stats)}

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
DETECTED_SQL = """detected AS (SELECT event_id AS scan_id, 'u' || user_id AS url, ts AS timestamp, event_type AS kind,
  event_type || '-' || json_extract_string(props, '$.k') AS tech, props, CAST(trunc(value) AS INTEGER) AS confidence FROM events)"""
_STATS = "SELECT tech, count(*) AS detection_count, count(DISTINCT url) AS url_count, max(timestamp) AS last_seen"
SCANS_SQL = f"""{DETECTED_SQL}, scans AS (SELECT url, CAST(timestamp AS DATE) AS day, list_sort(list(DISTINCT kind)) AS technologies, max(timestamp) AS timestamp,
  min(scan_id) AS scan_id FROM detected GROUP BY 1, 2)"""


def oracles() -> dict[str, str]:
    d, s = f"WITH {DETECTED_SQL}", f"WITH {SCANS_SQL}"
    diff = "list_filter({a}, lambda x: NOT list_contains({b}, x))"
    changes = lambda at: (
        f"SELECT url, {at}, 'added' AS type, unnest({diff.format(a='technologies', b='previous')}) AS technology FROM pairs "
        f"UNION ALL SELECT url, {at}, 'removed', unnest({diff.format(a='previous', b='technologies')}) FROM pairs")
    stats = f"{d} {_STATS} FROM detected GROUP BY tech"
    latest = f"{d} {_STATS}, arg_max(props, timestamp) AS props FROM detected GROUP BY tech"
    return {
        "due_urls": f"""{d} SELECT DISTINCT 'u' || (c_custkey % 200) AS url FROM customer WHERE 'u' || (c_custkey % 200) NOT IN (
  SELECT url FROM detected WHERE timestamp >= (SELECT max(timestamp) FROM detected) - INTERVAL 24 HOURS)""",
        "technology_stats": latest,
        "technology_urls": f"{d} SELECT tech, url, count(*) AS detections, max(timestamp) AS last_seen FROM detected GROUP BY tech, url",
        "technology_upsert": latest, "stream_stats": latest,
        "last_scans": f"""{d} SELECT * FROM (SELECT url, scan_id, CAST(row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, scan_id DESC) AS INTEGER) AS recency
  FROM detected) WHERE recency <= 10""",
        "top_technologies": f"{stats} ORDER BY detection_count DESC, tech LIMIT 50",
        "scan_changes": f"""{s}, ranged AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, scan_id DESC) AS rn,
  lag(technologies) OVER (PARTITION BY url ORDER BY timestamp, scan_id) AS previous FROM scans WHERE timestamp >= {_NOW} - INTERVAL 30 DAYS),
pairs AS (SELECT * FROM ranged WHERE rn = 1 AND previous IS NOT NULL) {changes('timestamp')}""",
        "change_sets": f"""{d}, sides AS (SELECT url, tech, bool_or(timestamp < {_NOW}) AS before, bool_or(timestamp >= {_NOW}) AS after FROM detected GROUP BY url, tech),
known AS (SELECT url FROM sides GROUP BY url HAVING bool_or(before) AND bool_or(after))
SELECT url, tech, CASE WHEN before AND after THEN 'unchanged' WHEN after THEN 'added' ELSE 'removed' END AS change FROM sides SEMI JOIN known USING (url)""",
        "active_sites": "SELECT c_name AS url FROM customer WHERE c_acctbal > 0",
        "state_counts": "SELECT o_orderstatus AS state, count(*) AS jobs FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders",
        "stream_detect": f"WITH {demo.detections_sql()} SELECT page_id, rank, tech, confidence, version FROM det",
        "stream_daily": f"""{d} SELECT CAST(timestamp AS DATE) AS day, url, kind AS tech, max(confidence) AS confidence, count(*) AS pages
FROM detected GROUP BY 1, 2, 3""",
        "stream_first_scans": f"""WITH RECURSIVE {DETECTED_SQL}, accepted AS (
  SELECT url, min(timestamp) AS at_ts FROM detected GROUP BY url
  UNION ALL
  SELECT url, at_ts FROM (SELECT a.url, (SELECT min(d.timestamp) FROM detected d WHERE d.url = a.url AND d.timestamp >= a.at_ts + INTERVAL 24 HOURS) AS at_ts FROM accepted a) WHERE at_ts IS NOT NULL
) SELECT url, epoch_us(at_ts) AS at_us FROM accepted""",
        "stream_changes": f"""{s}, pairs AS (SELECT * FROM (SELECT *, lag(technologies) OVER (PARTITION BY url ORDER BY timestamp, scan_id) AS previous FROM scans) WHERE previous IS NOT NULL)
{changes('epoch_us(timestamp) AS at_us')}""",
    }
