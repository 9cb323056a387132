"""Signature quality: ledger, tiers, audit, library reports (Q1-Q9, Q15-Q19, Q22, Q23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscan import fixed
from stackscan.functions.columns import any_contains, union_all, unnest

# Signature fields the ledger covers; kinds the audit covers.
LEDGER_FIELDS = ("html", "scripts", "headers", "meta", "cookies", "js")
AUDIT_KINDS = ("html", "script", "js")


def _audit_field() -> Column:
    return F.when(F.col("kind") == "script", "scripts").otherwise(F.col("kind"))


def _joined(values: str) -> Column:
    return F.coalesce(F.array_join(values, ";"), F.lit(""))


# The tier rules.
def tier(field: Column, pattern: Column) -> Column:
    """Expected reliability of a pattern: A strong, B moderate, C suspect (Q2); first rule wins."""
    length = F.length(pattern)
    common = F.lower(pattern).isin(*fixed.TIER_COMMON_WORDS)
    js = (F.when(length <= 2, "C").when(pattern.rlike("^[A-Z][a-zA-Z0-9]{4,}$"), "A")
          .when(common, "C").otherwise("B"))
    return (
        F.when(field == "headers", "A")
        .when((field == "cookies") & (length >= 6), "A")
        .when((field == "meta") & ~pattern.rlike("(?i)generator"), "B")
        .when(field == "js", js)
        .when(length < 4, "C")
        .when(common, "C")
        .when(pattern.rlike(r"(?i)^\.\*[a-z]+\.\*\z"), "C")
        .when(pattern.rlike(r'^class="?\.\*'), "C")
        .when(pattern.rlike(r"(?i)[a-z0-9-]+\\\.(?:com|org|net|edu|io)"), "A")
        .when(pattern.rlike(r"(?i)^/[a-z0-9_-]{4,}") & F.contains(pattern, F.lit("\\")), "B")
        .when((length >= 8) & pattern.rlike(r"(?i)[a-z]+[-_][a-z]+"), "B")
        .otherwise("C")
    )


def ledger(technologies: DataFrame, signatures: DataFrame) -> DataFrame:
    """One validation row per html, scripts, headers, meta, cookies and js pattern (Q1, Q2)."""
    keyed = F.col("key").isNotNull()
    key = F.regexp_extract("label", "^[A-Za-z]+: ([^=]*)", 1)
    text = F.when(keyed, F.concat_ws("=", key, F.when(F.col("pattern") != "", F.col("pattern")))).otherwise(F.col("pattern"))
    facts = technologies.select("tech", "file", "listed_categories", "higher_ed", "legacy_names")
    rows = signatures.filter(F.col("field").isin(*LEDGER_FIELDS)).join(facts, ["tech", "file"], "left")
    judged = rows.withColumn("_judged", F.when(keyed, key).otherwise(F.col("pattern")))
    return judged.select(
        F.col("tech").alias("technology"), "file", _joined("listed_categories").alias("category"), "field",
        text.alias("pattern"), tier(F.col("field"), F.col("_judged")).alias("tier"),
        F.coalesce("higher_ed", F.lit(False)).alias("higher_ed"), _joined("legacy_names").alias("legacy_names"),
        F.lit("").alias("source_evidence"), F.lit("").alias("status"), F.lit("").alias("notes"),
        "tech_ord", "kind_ord", "ord")


def tier_counts(ledger_rows: DataFrame) -> DataFrame:
    """Patterns per tier (Q3)."""
    return ledger_rows.groupBy("tier").agg(F.count("*").alias("patterns"))


def audit_issues(signatures: DataFrame) -> DataFrame:
    """Problems of single html, scripts and js patterns (Q4-Q7), one row each. The message texts
    are fixed values."""
    p = F.when(F.col("kind") == "js", F.col("key")).otherwise(F.col("pattern"))
    regex_like = p.rlike(r"[\\.*+?^${}()|\[\]]") & (F.length(p) > 6)
    raw = F.replace(F.replace(p, F.lit("\\\\"), F.lit("\\")), F.lit("\\."), F.lit("."))
    text = F.col("kind").isin("html", "script")
    broad = (p.rlike(r"(?i)^\.\*[a-z]+\.\*\z") | p.rlike(r'^class="?\.\*') | p.rlike(r"^\\\$\\\("))

    def issue(condition: Column, severity: str, *message) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.concat(*message).alias("message")))

    quoted = (F.lit('"'), p, F.lit('"'))
    issues = F.array(
        issue(text & ~regex_like & (F.length(raw) < 4), "ERROR",
              F.lit("Pattern too short ("), F.length(raw).cast("string"), F.lit(" chars): "), *quoted),
        issue(text & (F.length(p) > 2) & p.isin(*fixed.AUDIT_COMMON_WORDS), "ERROR",
              F.lit("Standalone common word: "), *quoted, F.lit(" - use more specific pattern")),
        issue(text & broad, "WARNING", F.lit("Overly broad regex pattern: "), *quoted),
        issue((F.col("kind") == "js") & p.isin(*fixed.AUDIT_SHORT_GLOBALS), "ERROR",
              F.lit("Short/common JS object name: "), *quoted, F.lit(" - too likely to cause false positives")),
    )
    audited = signatures.filter(F.col("kind").isin(*AUDIT_KINDS)).withColumn("_issues", F.array_compact(issues)).select(
        "tech", "file", _audit_field().alias("field"), p.alias("pattern"), "_issues")
    return unnest(audited, ["tech", "file", "field", "pattern"], "_issues", "i").select(
        "i.severity", "tech", "file", "field", "pattern", "i.message")


def _audited(signatures: DataFrame) -> DataFrame:
    p = F.when(F.col("kind") == "js", F.col("key")).otherwise(F.col("pattern"))
    return signatures.filter(F.col("kind").isin(*AUDIT_KINDS)).select(
        _audit_field().alias("field"), p.alias("pattern"), "tech_ord", "ord", "tech", "file")


def duplicate_patterns(signatures: DataFrame) -> DataFrame:
    """Patterns used more than once, with their number of uses (Q8)."""
    return _audited(signatures).groupBy("field", "pattern").agg(F.count("*").alias("uses")).filter("uses > 1")


def duplicate_places(signatures: DataFrame) -> DataFrame:
    """Every use of a pattern that is used more than once, one row each (Q8)."""
    return _audited(signatures).join(duplicate_patterns(signatures), ["field", "pattern"])


def duplicate_issues(signatures: DataFrame) -> DataFrame:
    """Patterns used more than once as audit issues (Q8): one row per pattern with its number of
    uses. ``duplicate_places`` names the places, one row each, however many there are."""
    return duplicate_patterns(signatures).select(
        F.lit("INFO").alias("severity"), F.lit("Multiple").alias("tech"), F.lit("various").alias("file"), "field", "pattern",
        F.concat(F.lit("Duplicate pattern found in "), F.col("uses").cast("string"), F.lit(" places")).alias("message"))


def audit(signatures: DataFrame) -> DataFrame:
    """All audit issues."""
    return union_all([audit_issues(signatures), duplicate_issues(signatures)])


def audit_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity and the verdict: failed if there is any error (Q9)."""
    return issues.agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "INFO").alias("infos"),
    ).withColumn("passed", F.col("errors") == 0)


def incomplete_technologies(technologies: DataFrame) -> DataFrame:
    """Technologies without a description or without any usual pattern (Q15)."""
    no_text = F.coalesce(F.col("description"), F.lit("")) == ""
    no_pattern = ~(F.col("has_html") | F.col("has_scripts") | F.col("has_headers") | F.col("has_js"))
    issues = F.array_compact(F.array(F.when(no_text, "missing description"), F.when(no_pattern, "no detection patterns")))
    return technologies.select("tech", F.array_join(issues, ", ").alias("issues")).filter("issues != ''")


def expected_coverage(technologies: DataFrame, expected: tuple[str, ...] = fixed.EXPECTED_SYSTEMS) -> DataFrame:
    """How many of the expected technologies the library names (Q15)."""
    found = F.count_distinct(F.when(F.col("tech").isin(*expected), F.col("tech")))
    return technologies.agg(found.alias("found")).select(
        "found", F.lit(len(expected)).alias("expected"),
        F.round(F.col("found") * 100 / len(expected)).cast("int").alias("pct"))


def library_categories(technologies: DataFrame) -> DataFrame:
    """Distinct categories as written in the library (Q15)."""
    return technologies.select(F.explode("categories").alias("category")).distinct()


def sis_candidates(technologies: DataFrame) -> DataFrame:
    """Technologies that look like student information systems (Q16)."""
    text = F.lower(F.coalesce("description", F.lit("")))
    by_text = any_contains(text, fixed.SIS_KEYWORDS) & any_contains(
        text, ("student", "information", "management", "sis"))
    by_category = F.coalesce(F.array_contains("category_ids", 53), F.lit(False)) & F.coalesce("higher_ed", F.lit(False))
    return technologies.filter(by_text | by_category | F.contains(F.lower("tech"), F.lit("sis")))


def _names(system: Column) -> Column:
    return (F.col("tech") == system) | F.contains(F.lower("tech"), F.lower(system))


def segment_coverage(candidates: DataFrame, segments: dict[str, tuple[str, ...]] = fixed.MARKET_SEGMENTS) -> DataFrame:
    """Per expected system of each segment, the first library technology that names it (Q16).

    Every candidate is compared with the fixed list of systems inside its row; what it names is
    aggregated and put next to the list.
    """
    spark = candidates.sparkSession
    wanted = [(s, i, name) for s, names in segments.items() for i, name in enumerate(names)]
    expected = spark.createDataFrame(wanted, "segment string, pos int, system string")
    systems = F.array(*[F.lit(name) for _, _, name in wanted])
    named = unnest(candidates, ["tech", "tech_ord"], F.filter(systems, _names), "system")
    first = named.groupBy("system").agg(F.min_by("tech", "tech_ord").alias("found"))
    return expected.join(F.broadcast(first), "system", "left").select("segment", "pos", "system", "found")


def uncategorized_sis(candidates: DataFrame, segments: dict[str, tuple[str, ...]] = fixed.MARKET_SEGMENTS) -> DataFrame:
    """Candidates that name no expected system (Q16)."""
    systems = F.array(*[F.lit(n) for names in segments.values() for n in names])
    return candidates.filter(~F.exists(systems, _names))


def import_rollup(technologies: DataFrame, popular: tuple[str, ...] = fixed.POPULAR_CMS) -> DataFrame:
    """Technologies per import group (Q17): first of cms, lms, sis by id; higher-ed or general."""
    has = lambda i: F.coalesce(F.array_contains("category_ids", i), F.lit(False))
    group = F.when(has(1), "cms").when(has(21), "lms").when(has(53), "sis")
    higher = F.coalesce("higher_ed", F.lit(False))
    groups = F.array_compact(F.array(
        F.lit("total"), group, F.when(higher, "higher_ed").otherwise("general"),
        F.when((group == "cms") & F.col("tech").isin(*popular), "popular_cms")))
    return unnest(technologies, [], groups, "category").groupBy("category").agg(
        F.count("*").alias("technologies"))


def reference_ledger(technologies: DataFrame) -> DataFrame:
    """One research row per technology with its priority (Q18)."""
    holds = lambda hints: any_contains(F.col("tech"), hints)
    legacy = _joined("legacy_names")
    priority = (F.when(legacy != "", "high").when(holds(fixed.HIGH_PRIORITY_HINTS), "high")
                .when(holds(fixed.LOW_PRIORITY_HINTS), "low").otherwise("medium"))
    blank = F.lit("")
    return technologies.select(
        F.col("tech").alias("technology"), "file", legacy.alias("legacy_names"),
        F.coalesce("website", blank).alias("vendor_website"),
        *[blank.alias(c) for c in ("vendor_demo_url", "vendor_docs_url", "customer_url_1", "customer_url_2",
                                   "customer_url_3", "unverifiable_public")],
        priority.alias("priority"), blank.alias("notes"))


def priority_counts(reference_rows: DataFrame) -> DataFrame:
    return reference_rows.groupBy("priority").agg(F.count("*").alias("technologies"))


def capture_worklist(reference_rows: DataFrame, order: str = "ord") -> DataFrame:
    """URLs to capture, high priority first (S8). ``order`` is the ledger's row order."""
    url = lambda c: F.when(F.col(c) != "", F.col(c))
    customers = F.array(*[F.struct(F.lit(i).alias("pos"), url(f"customer_url_{i}").alias("url")) for i in (1, 2, 3)])
    demo = F.array(F.struct(F.lit(1).alias("pos"), url("vendor_demo_url").alias("url")))
    filled = lambda a: F.filter(a, lambda x: x["url"].isNotNull())
    chosen = F.when(F.size(filled(customers)) > 0, filled(customers)).otherwise(filled(demo))
    rows = reference_rows.filter(~F.col("unverifiable_public").eqNullSafe("true")).select(
        F.col("technology").alias("tech"), "priority", order, F.explode(chosen).alias("u"))
    return rows.select("tech", "priority", "u.url", F.when(F.col("priority") == "high", 0).otherwise(1).alias("bucket"),
                       order, "u.pos")


def capture_summary(snapshots: DataFrame, min_confidence: int = 30) -> DataFrame:
    """Captured, failed, matched and missed captures (Q19).

    ``snapshots`` has ``technology``, ``matched_patterns`` and ``error``, null when captured.
    """
    own = F.exists("matched_patterns", lambda m: (F.lower(m["name"]) == F.lower("technology"))
                   & (m["confidence"] >= min_confidence))
    hit = F.coalesce(own, F.lit(False))
    captured = F.col("error").isNull()
    return snapshots.agg(
        F.count_if(captured).alias("captured"), F.count_if(~captured).alias("errors"),
        F.count_if(captured & hit).alias("matched"), F.count_if(captured & ~hit).alias("missed"))


def regression_outcomes(expectations: DataFrame, detections: DataFrame, site: str = "url") -> DataFrame:
    """Outcome per expected or forbidden technology of every tested site (Q22).

    ``expectations(url, suite, expected, must_not_match, min_confidence)`` with suite
    ``false_positive`` or ``true_positive``. A technology expected in the false-positive suite
    only warns.
    """
    rows = F.concat(
        F.transform(F.coalesce("must_not_match", F.array().cast("array<string>")),
                    lambda t: F.struct(t.alias("tech"), F.lit("forbidden").alias("rule"))),
        F.transform(F.coalesce("expected", F.array().cast("array<string>")),
                    lambda t: F.struct(t.alias("tech"), F.lit("expected").alias("rule"))))
    rules = expectations.select("url", "suite", "min_confidence", F.explode(rows).alias("r")).select(
        "url", "suite", "min_confidence", "r.*").filter("rule = 'expected' or suite = 'false_positive'")
    # Only the tested sites' detections matter, at most one per site and technology.
    best = detections.groupBy(F.col(site).alias("url"), "tech").agg(F.max("confidence").alias("confidence"))
    found = F.col("confidence").isNotNull()
    outcome = (
        F.when((F.col("rule") == "forbidden") & found, "false_positive")
        .when(F.col("rule") == "forbidden", "pass")
        .when(~found & (F.col("suite") == "false_positive"), "warning")
        .when(~found, "true_positive_missing")
        .when((F.col("suite") == "true_positive") & (F.col("confidence") < F.col("min_confidence")), "low_confidence")
        .otherwise("pass"))
    return rules.join(best, ["url", "tech"], "left").select("url", "suite", "rule", "tech", "confidence", outcome.alias("outcome"))


def regression_summary(outcomes: DataFrame) -> DataFrame:
    """Whether every tested site passed (Q22)."""
    return outcomes.groupBy("url", "suite").agg(
        F.bool_and(F.col("outcome").isin("pass", "warning")).alias("passed"))


def kind_coverage(signatures: DataFrame) -> DataFrame:
    """Patterns per technology and kind (Q23)."""
    kinds = ["html", "script", "network", "header", "meta", "dom", "js", "cookie"]
    counted = signatures.groupBy("tech").pivot("kind", kinds).count()
    return counted.fillna(0, kinds)
