"""Quality rules: base rules and a hashed n-gram log-likelihood ratio (DataFrame functions only).

Words and pairs of neighbouring words are hashed into ``buckets``. Counting all n-grams of all documents
gives the raw multinomial, counting those of trusted documents the target. A document's score is the
sum of log(target / raw) over its n-grams, divided by their number; it passes from ``threshold`` on.
The target is fitted on every other trusted document. The rest of them calibrate: the threshold is lowered
where it would drop more than a few of these. The same counts and the same threshold then decide on every
document. Nothing but the counts is shuffled.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import SPACE, words_of

BUCKETS = 1 << 14
#: Score per n-gram from which a document passes, and the share of trusted documents outside the fit
#: that must pass in any case: in a small corpus clean documents score lower.
THRESHOLD, PASSING = -0.06, 0.995
#: Bound on the memory of the quantile over all trusted documents: its rank is exact to this part of their number.
ACCURACY = 1_000_000
#: Most labelled documents that the target is fitted on: those with the smallest hash of their id.
TRUSTED = 20_000
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"


def _neighbours(values: Column, combine) -> Column:
    """``combine`` of every element and the one after it; empty for fewer than two."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), combine)


def with_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (with ``text``) plus words, ``h`` (hashes of the words), ``pairs`` (hashes of
    neighbouring words) and ``grams`` (the buckets of both)."""
    split = docs.withColumn("words", words_of(F.col("text")))
    hashed = split.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    paired = hashed.withColumn("pairs", _neighbours(F.col("h"), lambda a, b: F.xxhash64(a, b)))
    return paired.withColumn("grams", F.transform(F.concat("h", "pairs"), lambda g: F.pmod(g, F.lit(buckets)).cast("int")))


def _fits(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), doc_id), F.lit(2)) == 0


def chosen_ids(trusted: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` of the trusted ids (None: all), and whether an id is for the fit or for the calibration."""
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    some = ids if limit is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return (some.select(F.col("doc_id").alias("chosen"), _fits("doc_id").alias("fits")))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, limit: int = TRUSTED) -> list[float]:
    """log(target / raw) of every bucket; 0 where no n-gram falls into it.

    The raw counts are over all of ``docs``; the target's over half of the documents whose doc_id is in
    ``trusted``, at most ``limit`` of them. Without a trusted document all ratios are 0. Only ``buckets``
    counts reach the driver.
    """
    chosen = chosen_ids(trusted, limit).where("fits")
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left")
    grams = with_grams(flagged.select("text", F.col("chosen").isNotNull().cast("long").alias("trust")), buckets)
    # the outer form: a plain explode adds a filter that computes the arrays once more
    found = (grams.select("trust", F.explode_outer("grams").alias("bucket")).groupBy("bucket")
             .agg(F.count("*").alias("raw"), F.sum("trust").alias("target")).collect())
    counts = [r for r in found if r["bucket"] is not None]
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    if not target:
        return [0.0] * buckets
    # shrunk towards the raw shares by as many pseudo-counts as there are buckets
    ratios = [0.0] * buckets
    for r in counts:
        ratios[r["bucket"]] = log((r["target"] * raw / r["raw"] + buckets) / (target + buckets))
    return ratios


def _repeated_words(windows: DataFrame) -> DataFrame:
    """Adds n_repeat_words, given ``pairs`` and ``h``: the words in 3-word windows found twice or more.

    Windows are compared by their 64-bit hashes. Only texts with a repeated window are sorted.
    """
    n = F.greatest(F.size("h") - 2, F.lit(0))
    all3 = windows.withColumn("w3", F.zip_with(F.slice("pairs", 1, n), F.slice("h", 3, n), lambda a, b: F.xxhash64(a, b)))
    placed = F.sort_array(F.transform("w3", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    sorted3 = all3.withColumn("placed", F.when(F.size("w3") > F.size(F.array_distinct("w3")), placed))
    # both members of an equal neighbouring pair are repeated windows
    both = sorted3.withColumn("both", _neighbours(F.col("placed"), lambda a, b: F.when(
        a["w"] == b["w"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2))))
    covered = F.size(F.array_distinct(F.flatten(F.filter("both", lambda x: x.isNotNull()))))
    return (both.withColumn("n_repeat_words", F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("long"))
            .drop("w3", "placed", "both"))


def _mean_ratio(ratios: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)


def calibrate(docs: DataFrame, trusted: DataFrame, ratios: list[float], threshold: float = THRESHOLD,
              passing: float = PASSING, limit: int = TRUSTED, sound: bool = False) -> float:
    """``threshold``, or the score that the share ``passing`` of the trusted documents outside the fit reach, if lower.

    With ``sound`` only those count that pass the base rules: the scores of short texts scatter most, and
    the base rules drop these texts in any case. ``limit`` then bounds nothing here: all of them count.
    """
    held = chosen_ids(trusted, None if sound else limit).where(~F.col("fits"))
    if sound:
        # scores meet the ids, so that no text is shuffled
        scores = score(docs.select("doc_id", "text").where(~_fits("doc_id")), ratios).where(~F.col("base_failed")).select("doc_id", "score")
        passed = scores.join(held, F.col("doc_id") == F.col("chosen"), "left_semi")
        low = passed.agg(F.percentile_approx("score", F.lit(1 - passing), F.lit(ACCURACY))).first()[0]
        return threshold if low is None else min(threshold, low)
    texts = docs.join(F.broadcast(held), F.col("doc_id") == F.col("chosen"), "left_semi").select("text")
    low = with_grams(texts, len(ratios)).select(_mean_ratio(ratios).alias("s")).agg(F.percentile("s", F.lit(1 - passing))).first()[0]
    return threshold if low is None else min(threshold, low)


def score(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    ``row`` is the whole input row. A null text has no words, fails the base rules and scores 0. Lines are
    compared exactly; a line without a word is no line. Counts are of code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    grams = with_grams(docs.select(F.struct("*").alias("row"), "doc_id", text.alias("text")), len(ratios))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    ready = _repeated_words(grams.withColumn("lines", lines))
    n_words = F.size("words").cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    found = ready.select(
        "row", "doc_id", n_words.alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        _mean_ratio(ratios).alias("score"))
    # unnested, so that a later filter by the verdict is not pushed down and does not measure each text once more
    whole = found.select(F.explode_outer(F.array(F.struct("*"))).alias("m")).select("m.*")
    return whole.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
                  limit: int = TRUSTED, sound: bool = False) -> DataFrame:
    """Measures and verdict of every row of ``docs``; ``trusted`` names good documents by doc_id, ``sound`` as in ``calibrate``.

    Rows that repeat each other get the same verdict. A null doc_id is never trusted. An empty table gives
    an empty result.
    """
    ratios = fit(docs, trusted, buckets, limit)
    return score(docs, ratios, calibrate(docs, trusted, ratios, threshold, limit=limit, sound=sound))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
