"""Streams over several micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from stackscan.operators import history
from stackscan.streaming import jobs

HOUR = 3600
START = 400_000 * HOUR


def write_batches(spark, folder, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_seconds(F.col("at") + START)).drop("at").coalesce(1).write.mode(
            "append").parquet(folder)


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, frame, folder):
    jobs.run_to_table(frame, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(f"{folder}/out").collect()


def test_first_scans_keep_their_distance(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_batches(spark, folder, "url string, at long", [("u", 0), ("u", 2 * HOUR), ("v", 0)],
                  [("u", 25 * HOUR), ("u", 26 * HOUR), ("u", 50 * HOUR), ("v", 25 * HOUR)])
    rows = run(spark, jobs.first_scans(stream(spark, folder)), str(tmp_path))
    assert sorted((r.url, int(r.timestamp.timestamp() - START) // HOUR) for r in rows) == [("u", 0), ("u", 25), ("u", 50), ("v", 0), ("v", 25)]


def test_changes_against_the_last_seen_set(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_batches(spark, folder, "scan_id long, url string, at long, technologies array<string>",
                  [(1, "u", 0, ["a"]), (2, "u", HOUR, ["a", "b"])], [(3, "u", 2 * HOUR, ["b"]), (4, "v", 2 * HOUR, ["z"])])
    rows = run(spark, jobs.change_stream(stream(spark, folder)), str(tmp_path))
    assert sorted((r.url, int(r.timestamp.timestamp() - START) // HOUR, r.type, r.technology) for r in rows) == [
        ("u", 1, "added", "b"), ("u", 2, "removed", "a")]


def test_statistics_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_batches(spark, folder, "tech string, url string, at long", [("a", "u", 1), ("a", "v", 2)], [("a", "u", 3), ("b", "u", 4)])
    store = str(tmp_path / "store")
    jobs.maintain_stats(stream(spark, folder), store, str(tmp_path / "cp")).awaitTermination(120)
    got = history.stats_from_urls(jobs.running_urls(spark, store)).collect()
    want = history.technology_stats(spark.read.parquet(folder)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_changes_of_a_url_with_many_scans_in_one_batch(spark, tmp_path):
    folder, n = str(tmp_path / "in"), 300_000
    names = F.when(F.col("id") % 1000 < 500, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    spark.range(n).select(
        (n - F.col("id")).alias("scan_id"), F.lit("u").alias("url"), F.timestamp_seconds(F.lit(START) + F.col("id")).alias("timestamp"),
        F.when(F.col("id") == 0, F.lit(None)).otherwise(names).alias("technologies")).repartition(4, "scan_id").write.parquet(folder)
    frame = jobs.change_stream(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))
    rows = run(spark, frame, str(tmp_path))
    got = sorted((int(r.timestamp.timestamp()) - START, r.type, r.technology) for r in rows)
    turns = [(i, kind, name) for i in range(500, n, 500) for kind, name in ((("added", "c"), ("removed", "a")) if i % 1000 else (("added", "a"), ("removed", "c")))]
    assert got == [(1, "added", "a"), (1, "added", "b"), *turns]
