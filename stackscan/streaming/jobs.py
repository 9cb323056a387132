"""Continuous scanning as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackscan.model import ScanConfig
from stackscan.operators.evidence import extract_evidence
from stackscan.operators.history import sum_technology_urls, technology_urls
from stackscan.operators.match import detect
from stackscan.sources.signatures import Library

CHANGE = "url string, timestamp timestamp, type string, technology string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or under the
    warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stackscan-{uuid.uuid4().hex}"


def detect_stream(pages: DataFrame, library: Library, ids: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Detections on arriving pages (T1): the batch plan has no shuffle and no state, so it
    serves streams unchanged."""
    return detect(extract_evidence(pages, config), library, ids, config)


def daily_rollup(detections: DataFrame, delay: str = "1 day", site: str = "site") -> DataFrame:
    """Best confidence per day, site and technology.

    Written with ``append`` a day appears once the watermark has passed it; with ``run_updates``
    every day is there at once, the open ones as far as they have come.
    """
    return (
        detections.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 day").alias("day"), site, "tech")
        .agg(F.max("confidence").alias("confidence"), F.count("*").alias("pages"))
        .select(F.col("day.start").alias("day"), site, "tech", "confidence", "pages"))


def run_updates(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Process everything available in ``update`` mode: every micro-batch writes the rows it has
    changed under its batch id, and writes them again if it is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_rows(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """The last state of every key of a table written by ``run_updates``."""
    rows = spark.read.parquet(store)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def _expire(state: GroupState, last_us: int, keep_seconds: int) -> None:
    """Let a URL's state go when event time has passed its last scan by ``keep_seconds``."""
    state.setTimeoutTimestamp(max(last_us // 1000 + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))


def _accept(ttl_seconds: int):
    """State function: which of one URL's scans keep the distance to the last accepted one."""

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([b["timestamp"].to_numpy("datetime64[us]") for b in batches])).astype("int64")
        step, accepted = ttl_seconds * 1_000_000, []
        due = state.get[0] + step if state.exists else times[0]
        position = np.searchsorted(times, due)
        while position < len(times):
            accepted.append(int(times[position]))
            position = np.searchsorted(times, times[position] + step)
        if accepted:
            state.update((accepted[-1],))
            _expire(state, accepted[-1], ttl_seconds)
            yield pd.DataFrame({"url": key[0], "timestamp": np.array(accepted, dtype="datetime64[us]")})
        elif state.exists:
            _expire(state, state.get[0], ttl_seconds)

    return accept


def first_scans(scans: DataFrame, ttl_seconds: int = 24 * 3600, delay: str = "1 hour") -> DataFrame:
    """Scans of a URL that come at least the time to live after its last accepted scan.

    The state of a URL is one time stamp, dropped once the time to live has passed. Scans that
    come later than ``delay`` are dropped. (The built-in de-duplication inside a watermark would
    also drop repeats that come after the time to live but in the same micro-batch.)
    """
    return (
        scans.select("url", "timestamp").withWatermark("timestamp", delay).groupBy("url").applyInPandasWithState(
            _accept(ttl_seconds), "url string, timestamp timestamp", "last long", "append",
            GroupStateTimeout.EventTimeTimeout))


def _compare(keep_seconds: int, rows_at_once: int = 10_000):
    """State function: compare each scan of one URL with the names kept from the scan before.

    Of a scan it keeps when it was, its id, and the number of its set of names, a few bytes; the sets
    themselves are held once each, and events leave in chunks.
    """

    def compare(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers: dict[frozenset, int] = {}
        times, ids, held = [], [], []
        for batch in batches:
            times.append(batch["timestamp"].to_numpy("datetime64[us]"))
            ids.append(batch["scan_id"].to_numpy())
            found = (frozenset(() if names is None else names) for names in batch["technologies"])
            held.append(np.fromiter((numbers.setdefault(names, len(numbers)) for names in found), np.int32, len(batch)))
        order = pd.DataFrame({"t": np.concatenate(times), "id": np.concatenate(ids)}).sort_values(["t", "id"]).index.to_numpy()
        when, which = np.concatenate(times)[order], np.concatenate(held)[order]
        sets = list(numbers)
        # the scans whose set differs from that of the scan before
        changed = np.flatnonzero(np.diff(which)) + 1
        pairs = [(0, frozenset(state.get[0]))] if state.exists else []
        rows = []
        for at, before in chain(pairs, ((i, sets[which[i - 1]]) for i in changed)):
            now = sets[which[at]]
            rows += [(key[0], when[at], "added", t) for t in sorted(now - before)]
            rows += [(key[0], when[at], "removed", t) for t in sorted(before - now)]
            if len(rows) >= rows_at_once:
                yield pd.DataFrame(rows, columns=["url", "timestamp", "type", "technology"])
                rows = []
        state.update((sorted(sets[which[-1]]),))
        _expire(state, int(when[-1].astype("int64")), keep_seconds)
        if rows:
            yield pd.DataFrame(rows, columns=["url", "timestamp", "type", "technology"])

    return compare


def change_stream(scans: DataFrame, keep_seconds: int = 30 * 24 * 3600, delay: str = "1 hour") -> DataFrame:
    """Change events of every URL against its last seen technologies (T4).

    The state of a URL is its last set of names; it goes when the URL has had no scan for
    ``keep_seconds``. ``scans`` holds ``scan_id``, ``url``, ``timestamp``, ``technologies``; the
    freshness gate (``first_scans``, ``due_urls``) keeps a URL's scans in one micro-batch few.
    """
    return scans.withWatermark("timestamp", delay).groupBy("url").applyInPandasWithState(
        _compare(keep_seconds), CHANGE, "technologies array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def maintain_stats(detected: DataFrame, store: str, checkpoint: str, attributes: tuple[str, ...] = ()) -> StreamingQuery:
    """Keep technology statistics current from a stream of detections (T5).

    Every micro-batch writes its own per-URL rows under its batch id and overwrites them when it
    is run again, so a retried batch is counted once. ``running_urls`` adds the batches up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        technology_urls(batch, attributes).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (detected.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def running_urls(spark: SparkSession, store: str, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Per-URL rows of all batches so far (T5, H2)."""
    return sum_technology_urls(spark.read.parquet(store).drop("batch"), attributes)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into a Parquet table, exactly once."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
