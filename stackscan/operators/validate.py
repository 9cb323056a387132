"""Validation of ledger patterns against labelled snapshots (Q10-Q14).

Every snapshot is tested against all patterns inside its own row, as pages are; the hits are
then counted per pattern. Patterns and snapshots are never paired by a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions.regex import literal_conditions, strip_suffix, to_spark_regex
from stackscan.operators.candidates import PART, WANTED, candidate_rows, entry_conditions, entry_text, key_trigger, write_patterns
from stackscan.sources.signatures import valid_regex

# Statuses the validation may overwrite.
AUTO_STATUSES = ("", "verified", "suspect", "false-positive", "needs-review", "no-evidence")
ROW = ["technology", "file", "field", "pattern"]
_TEST = ["place", "own_tech", "field", "key", "key_regex", "value_regex"]


def snapshot_evidence(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their evidence in the columns the tests read.

    ``ord`` orders the snapshots; ``html`` comes from the companion file.
    """
    e = F.col("evidence")
    return snapshots.select(
        "ord", "technology", "url", F.coalesce("html", F.lit("")).alias("html"), e["scripts"].alias("scripts"),
        e["headers"].alias("headers"), e["meta"].alias("meta"), e["cookies"].alias("cookies"),
        e["dom"]["jsObjects"].alias("js_objects"))


def normal_tech(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def _identifier(key: str) -> str:
    """Regex for a global's name standing alone in the HTML."""
    return r"(?i)\b" + "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in key) + r"\b"


def _wanted(field: str, plain: str, key: str | None, value: str | None, mode: str) -> list[dict]:
    """What makes a ledger pattern's test worth running on a snapshot."""
    if field in ("html", "scripts") or (field == "cookies" and mode == "validate"):
        branches, _ = literal_conditions(plain if key is None else key)
        return [{"where": field, "terms": [list(t) for t in terms]} for terms in branches] or [{"where": field, "terms": []}]
    if field in ("headers", "meta"):
        return entry_conditions(field, key, literal_conditions(value)[0] if value else [])
    name = key_trigger(field, key)
    found = [{"where": "key", "terms": [[name]]}]
    if field == "js" and mode == "validate":
        found.append({"where": "html", "terms": [[key.lower()]] if key and key.isascii() else []})
    return found


def prepare_ledger(rows: DataFrame, mode: str = "validate") -> DataFrame:
    """Distinct ledger patterns taken apart: key, regexes for key and value, conditions, validity."""

    @F.pandas_udf(f"plain string, key string, key_regex string, value_regex string, wanted {WANTED}")
    def take_apart(fields: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        out = []
        for field, pattern in zip(fields, patterns):
            plain = strip_suffix(pattern or "").strip()
            key = value = None
            if field in ("html", "scripts"):
                regex = to_spark_regex(plain)
            else:
                key, _, value = plain.partition("=")
                regex = _identifier(key) if field == "js" else to_spark_regex(key)
            out.append((plain, key, regex, to_spark_regex(value) if value else None, _wanted(field, plain, key, value, mode)))
        return pd.DataFrame(out, columns=["plain", "key", "key_regex", "value_regex", "wanted"])

    parts = rows.select(*ROW).distinct().withColumn("p", take_apart("field", "pattern")).select(*ROW, "p.*")
    by_key = F.col("field").isin("headers", "meta")
    return parts.filter("plain != ''").filter(
        (by_key | valid_regex(F.col("key_regex"))) & (F.col("value_regex").isNull() | valid_regex(F.col("value_regex"))))


def _holds(s: Column, mode: str) -> Column:
    """Whether ledger test ``s`` fires on the snapshot (Q10).

    ``validate`` is the looser rule set: a header or meta key alone is enough, a cookie name is a
    regex, a global counts when its key is recorded - even as absent - or stands in the HTML.
    ``runtime`` follows the page matcher.
    """
    runtime = mode == "runtime"
    no_value = s["value_regex"].isNull()

    def keyed(column: str) -> Column:
        entry = F.get(F.filter(F.map_entries(column), lambda e: F.lower(e["key"]) == F.lower(s["key"])), 0)
        value = F.coalesce(entry["value"], F.lit(""))
        found = entry.isNotNull() & (no_value | F.rlike(value, s["value_regex"]))
        return found & (value != "") if runtime else found

    def cookie(c: Column) -> Column:
        name = F.coalesce(c["name"], F.lit(""))
        same = (name == s["key"]) if runtime else F.rlike(name, s["key_regex"])
        return same & (no_value | F.rlike(F.coalesce(c["value"], F.lit("")), s["value_regex"]))

    recorded = F.try_element_at("js_objects", s["key"])
    js = recorded if runtime else F.when(
        F.coalesce(F.map_contains_key("js_objects", s["key"]), F.lit(False)),
        no_value | F.rlike(F.coalesce(recorded.cast("string"), F.lit("")), s["value_regex"]),
    ).otherwise(F.rlike("html", s["key_regex"]))
    return F.coalesce(
        F.when(s["field"] == "html", F.rlike("html", s["key_regex"]))
        .when(s["field"] == "scripts", F.exists("scripts", lambda x: F.rlike(F.coalesce(x["src"], F.lit("")), s["key_regex"])))
        .when(s["field"] == "headers", keyed("headers"))
        .when(s["field"] == "meta", keyed("meta"))
        .when(s["field"] == "js", js)
        .when(s["field"] == "cookies", F.exists("cookies", cookie)),
        F.lit(False))


def _fired(ledger_rows: DataFrame, snapshots: DataFrame, mode: str, part: int) -> tuple[DataFrame, DataFrame]:
    """(place, own, ord, url, snapshot_tech) of every ledger row and snapshot it fires on, and the
    ledger's patterns by place. ``own`` tells whether the snapshot is labelled with the row's technology."""
    empty = F.array().cast("array<string>")

    def tagged(field: str, keys: Column) -> Column:
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(key_trigger(field, "")), k)), empty)

    names = F.transform("cookies", lambda c: c["name"])
    keys = F.concat(tagged("js", F.map_keys("js_objects")), tagged("cookies", names))
    texts = {"html": F.col("html"), "scripts": F.concat_ws("\n", F.transform("scripts", lambda s: s["src"])),
             "cookies": F.concat_ws("\n", names), "headers": entry_text(F.map_entries("headers")), "meta": entry_text(F.map_entries("meta"))}
    patterns = write_patterns(prepare_ledger(ledger_rows, mode).withColumn("own_tech", normal_tech(F.col("technology"))), ROW, "place")
    tested = snapshots.select("*", candidate_rows(patterns, _TEST, texts, keys, part).alias("_tests"))
    hits = F.transform(F.filter("_tests", lambda s: _holds(s, mode)), lambda s: F.struct(
        s["place"].alias("place"), (s["own_tech"] == normal_tech(F.col("technology"))).alias("own")))
    return tested.select("ord", "url", F.col("technology").alias("snapshot_tech"), F.explode_outer(hits).alias("s")).filter(
        "s is not null").select("s.place", "s.own", "ord", "url", "snapshot_tech"), patterns.select("place", *ROW)


def snapshot_hits(ledger_rows: DataFrame, snapshots: DataFrame, mode: str = "validate", part: int = PART) -> DataFrame:
    """One row per ledger pattern and snapshot it fires on (Q10)."""
    fired, rows = _fired(ledger_rows, snapshots, mode, part)
    return fired.join(rows, "place").select(*ROW, "ord", "url", "snapshot_tech")


def validation_results(ledger_rows: DataFrame, snapshots: DataFrame, mode: str = "validate", part: int = PART) -> DataFrame:
    """Status of every ledger pattern with its citation and false-positive note (Q11).

    ``needs-review`` fires on its own and on other technologies, ``verified`` only on its own,
    ``false-positive`` only on others, ``suspect`` never; ``no-evidence`` has no own snapshot.
    Hits travel without their patterns, dealt by pattern and snapshot: both uses below read this one
    shuffle, and a pattern that fires everywhere is counted before its rows meet.
    """
    fired, rows = _fired(ledger_rows, snapshots, mode, part)
    fired = fired.filter("place is not null").repartition("place", "ord")
    counts = fired.groupBy("place").agg(
        F.count_if("own").alias("own_hits"), F.count_if(~F.col("own")).alias("other_hits"),
        # with all columns, as below: only then are both reads of the shuffle the same
        F.min(F.when(F.col("own"), F.struct("ord", "url", "snapshot_tech"))).alias("first_own"))
    order = Window.partitionBy("place", "own").orderBy("ord", "url")
    firsts = fired.withColumn("rn", F.row_number().over(order)).filter("rn <= 2").groupBy("place").agg(
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("ord", "url", "snapshot_tech")))).alias("firsts"))
    found = counts.join(firsts, "place", "left").join(rows, "place").select(*ROW, "own_hits", "other_hits", "first_own", "firsts")
    own_techs = snapshots.select(normal_tech(F.col("technology")).alias("_tech")).distinct().withColumn("_known", F.lit(True))
    row = ledger_rows.withColumn("_tech", normal_tech(F.col("technology"))).join(own_techs, "_tech", "left").drop("_tech")
    # null-safe, so that no filter on the pattern's columns is pushed into one of the two reads only
    same = [row[c].eqNullSafe(found[c]) for c in ROW]
    both = row.join(found, same, "left").select(row["*"], "own_hits", "other_hits", "first_own", "firsts")
    n_other = F.coalesce("other_hits", F.lit(0))
    own, other = F.coalesce("own_hits", F.lit(0)) > 0, n_other > 0
    result = (F.when(F.col("_known").isNull(), "no-evidence").when(own & other, "needs-review")
              .when(own, "verified").when(other, "false-positive").otherwise("suspect"))
    shown = F.array_join(F.transform("firsts", lambda x: x["snapshot_tech"]), ", ")
    more = F.when(n_other > 2, F.concat(F.lit(" +"), (n_other - 2).cast("string"))).otherwise(F.lit(""))
    note = F.when(other, F.concat(F.lit("FP on: "), shown, more))
    known = F.col("_known").isNotNull()
    return both.select(
        *ledger_rows.columns, result.alias("result"), F.coalesce("own_hits", F.lit(0)).alias("own_hits"),
        n_other.alias("other_hits"), F.when(known, F.col("first_own.url")).alias("first_own_url"),
        F.when(known, note).alias("fp_note"))


def update_ledger(results: DataFrame, force: bool = False) -> DataFrame:
    """Write results into the ledger columns, keeping manual entries (Q12)."""
    status, cited, notes = (F.coalesce(c, F.lit("")) for c in ("status", "source_evidence", "notes"))
    touched = F.lit(True) if force else status.isin(*AUTO_STATUSES)
    tested = touched & (F.col("result") != "no-evidence")
    new_status = (F.when(~touched, status)
                  .when(F.col("result") == "no-evidence", F.when(status == "", "no-evidence").otherwise(status))
                  .otherwise(F.col("result")))
    cite = tested & F.col("first_own_url").isNotNull() & (F.lit(force) | (cited == ""))
    note = tested & F.col("fp_note").isNotNull()
    new_notes = (F.when(note & (notes == ""), F.col("fp_note"))
                 .when(note & ~F.contains(notes, F.lit("FP on:")), F.concat(notes, F.lit(" | "), "fp_note"))
                 .otherwise(notes))
    dropped = ("result", "own_hits", "other_hits", "first_own_url", "fp_note")
    return results.withColumns({
        "status": new_status, "source_evidence": F.when(cite, F.col("first_own_url")).otherwise(cited),
        "notes": new_notes}).drop(*dropped)


def _status_counts() -> list[Column]:
    names = {"verified": "verified", "review": "needs-review", "suspect": "suspect", "false_positive": "false-positive",
             "no_evidence": "no-evidence"}
    return [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()]]


def status_summary(rows: DataFrame) -> DataFrame:
    """Patterns per status with their rounded share (Q13)."""
    totals = rows.agg(*_status_counts())
    parts = ["verified", "review", "suspect", "false_positive", "no_evidence"]
    return totals.select("*", *[
        F.when(F.col("total") > 0, F.round(100 * F.col(p) / F.col("total")).cast("int")).otherwise(0).alias(f"{p}_pct")
        for p in parts])


def status_rollup(rows: DataFrame) -> DataFrame:
    """Patterns per status for the whole ledger, each file, each technology (Q13)."""
    return rows.rollup("file", "technology").agg(*_status_counts())


def needs_attention(rows: DataFrame) -> DataFrame:
    """Patterns to look at (Q14)."""
    return rows.filter(F.col("status").isin("suspect", "false-positive", "needs-review")).select(*ROW, "status", "notes")
