"""Registered queries: signature libraries, ledger, audit, validation, mining (S, Q).

The library under review is derived from the ``part`` table: every part is a technology of a
signature file, with patterns put together from its name, brand and type.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackscan import fixed
from stackscan.functions.categories import category_names
from stackscan.operators import mining, quality, validate
from stackscan.operators.match import detect
from stackscan.operators.rollup import merge_sites
from stackscan.plans import demo
from stackscan.sources import signatures as library
from stackscan.streaming.jobs import shared_folder
from stackscan.sources.ledgers import read_ledger, write_ledger


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    n = F.col("p_partkey")
    word, kind = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    return part.select(n.alias("n"), "p_name", "p_type", "p_brand", "p_size", word.alias("word"), kind.alias("kind"))


def _tech(n: Column) -> Column:
    """Name of a part's technology; every seventh takes the name of an expected system."""
    names = F.array(*map(F.lit, [*fixed.EXPECTED_SYSTEMS, *[x for s in fixed.MARKET_SEGMENTS.values() for x in s]]))
    picked = F.element_at(names, ((F.col("n") / 7).cast("long") % F.size(names) + 1).cast("int"))
    return F.when(n % 7 == 0, _cat(picked, " ", n.cast("string"))).otherwise(_cat(F.col("p_name"), " ", n.cast("string")))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Signature files as JSON text, 200 parts each. Names repeat over files, so later ones override."""
    rows = _parts(spark, sf)
    record = F.struct(
        F.col("p_type").alias("description"), F.array(F.col("p_size")).alias("cats"),
        F.array(F.col("p_name"), _cat("v", F.col("n").cast("string"))).alias("html"),
        F.when(F.col("n") % 3 == 0, F.array(F.col("word"))).alias("scripts"),
        F.when(F.col("n") % 3 == 1, F.array(F.col("kind"))).alias("scriptSrc"),
        F.create_map(F.lit("X-Part"), F.col("p_brand")).alias("headers"), F.create_map(F.col("word"), F.lit("")).alias("js"),
        (F.col("n") % 2 == 0).alias("higher_ed"))
    entry = F.struct(F.col("n"), _cat('"', F.col("p_name"), '":', F.to_json(record)).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), ",")
    return rows.select((F.col("n") / 200).cast("int").alias("file_ord"), entry.alias("e")).groupBy("file_ord").agg(
        _cat('{"_metadata":{"description":"x"},', text, "}").alias("value")).select(
        "file_ord", _cat("file", F.col("file_ord").cast("string"), ".json").alias("file"), "value")


def library_load(spark: SparkSession, sf: str) -> DataFrame:
    """Signature files parsed and overridden: the surviving record of every technology."""
    records = library.resolve_overrides(library.parse_signature_text(_files(spark, sf)))
    techs = library.technologies(records)
    counts = library.signatures(records).groupBy("tech").agg(
        F.count("*").alias("patterns"), F.sum("weight").cast("long").alias("weight"), F.max("label").alias("last_label"))
    return techs.join(counts, "tech").select(
        "tech", "file", "description", F.array_join("categories", "|").alias("categories"), "higher_ed", "patterns", "weight",
        "last_label", F.array_join(category_names(F.col("categories")), "|").alias("names"))


def library_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Even files as upstream, odd ones as custom: custom records win."""
    files = _files(spark, sf)
    upstream = library.parse_signature_text(files.filter("file_ord % 2 = 0"))
    custom = library.parse_signature_text(files.filter("file_ord % 2 = 1"))
    return library.merge_custom(upstream, custom).select("tech", "file")


def _technologies(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    text = F.when(n % 5 == 0, "").when(n % 5 == 1, _cat("Student information system for ", F.col("p_type"))).when(
        n % 5 == 2, _cat("Management of ", F.col("p_name"), " campus")).otherwise(F.col("p_type"))
    nothing = F.lit(None)
    cats = F.array(F.col("p_size").cast("int"), (n % 60).cast("int"))
    return _parts(spark, sf).select(
        _tech(n).alias("tech"), n.alias("tech_ord"), _cat("parts-", F.col("p_brand"), ".json").alias("file"),
        F.lit(0).alias("file_ord"), text.alias("description"), cats.cast("array<string>").alias("categories"),
        cats.alias("category_ids"), cats.cast("array<string>").alias("listed_categories"), (n % 3 == 0).alias("higher_ed"),
        (n % 100).cast("int").alias("base_confidence"), _cat("https://", F.col("word"), ".example.com").alias("website"),
        F.when(n % 11 == 0, F.array(F.col("p_name"), F.col("p_brand"))).alias("legacy_names"),
        nothing.cast("string").alias("signal_polarity"), (n % 4 == 0).alias("has_html"), (n % 4 == 1).alias("has_scripts"),
        (n % 4 == 2).alias("has_headers"), F.lit(False).alias("has_js"))


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Three signatures per part, with shapes that reach every tier and audit rule."""
    n, word, kind = F.col("n"), F.col("word"), F.col("kind")
    words = F.array(*map(F.lit, fixed.AUDIT_COMMON_WORDS))
    common = F.element_at(words, (n % len(fixed.AUDIT_COMMON_WORDS) + 1).cast("int"))
    globals_ = F.array(*map(F.lit, [*fixed.AUDIT_SHORT_GLOBALS, *fixed.JS_GLOBALS]))
    name = F.element_at(globals_, (n % (len(fixed.AUDIT_SHORT_GLOBALS) + len(fixed.JS_GLOBALS)) + 1).cast("int"))
    k = n % 10
    text = (F.when(k == 0, F.col("p_name")).when(k == 1, _cat(".*", word, ".*")).when(k == 2, _cat("cdn\\.", word, "\\.com"))
            .when(k == 3, _cat("/", word, "_path\\b")).when(k == 4, F.substring(word, 1, 3)).when(k == 5, _cat(kind, "-", word))
            .when(k == 6, common).when(k == 7, _cat('class=".*', word)).when(k == 8, _cat("\\$\\(", word))
            .otherwise(_cat(word, F.col("p_size").cast("string"), "?x")))
    row = lambda field, k_, ord_, key, pattern, label: F.struct(
        F.lit(field).alias("field"), F.lit(k_).alias("kind"), F.lit(ord_).alias("ord"), key.alias("key"), pattern.alias("pattern"),
        label.alias("label"))
    none = F.lit(None).cast("string")
    html = row("html", "html", 0, none, text, _cat("HTML: ", text))
    script = row("scripts", "script", 0, none, _cat(kind, "/", word, "\\.js"), _cat("Script: ", kind, "/", word, "\\.js"))
    js = row("js", "js", 0, name, F.lit(""), _cat("JS: ", name))
    header = row("headers", "header", 0, F.lower(_cat("X-", word)), F.col("p_brand"), _cat("Header: X-", word, "=", F.col("p_brand")))
    cookie = row("cookies", "cookie", 0, _cat(F.substring(word, 1, 3), F.when(n % 2 == 0, "_session").otherwise("")), F.lit(""),
                 _cat("Cookie: ", F.substring(word, 1, 3), F.when(n % 2 == 0, "_session").otherwise("")))
    meta = row("meta", "meta", 0, F.when(n % 2 == 0, "generator").otherwise(word), kind,
               _cat("Meta: ", F.when(n % 2 == 0, "generator").otherwise(word), "=", kind))
    third = F.when(n % 4 == 0, js).when(n % 4 == 1, header).when(n % 4 == 2, cookie).otherwise(meta)
    rows = _parts(spark, sf).select(
        _tech(n).alias("tech"), n.alias("tech_ord"), _cat("parts-", F.col("p_brand"), ".json").alias("file"),
        F.explode(F.array(html, script, third)).alias("s"))
    return library.with_weights(rows.select("tech", "tech_ord", "file", "s.*"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ledger(_technologies(spark, sf), _signatures(spark, sf))


def ledger_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).select("technology", "file", "category", "field", "pattern", "tier", "higher_ed", "legacy_names")


def ledger_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger written as CSV and read back, with quotes, commas and line breaks in a note."""
    rows = _ledger(spark, sf).withColumn("notes", _cat('said "', F.col("tier"), '", then\nnext'))
    folder = f"{shared_folder(spark)}/ledger"
    write_ledger(rows.withColumn("higher_ed", F.col("higher_ed").cast("string")), folder)
    return read_ledger(spark, folder).select("technology", "field", "pattern", "tier", "higher_ed", "status", "notes")


def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.tier_counts(_ledger(spark, sf))


def audit_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit_issues(_signatures(spark, sf))


def duplicate_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_patterns(_signatures(spark, sf))


def duplicate_places(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_places(_signatures(spark, sf)).select("field", "pattern", "tech", "file", "uses")


def audit_issues_all(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit(_signatures(spark, sf))


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.audit_summary(quality.audit(_signatures(spark, sf)))


def incomplete_technologies(spark: SparkSession, sf: str) -> DataFrame:
    return quality.incomplete_technologies(_technologies(spark, sf))


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    """The technologies without the part number in their name."""
    return _technologies(spark, sf).withColumn("tech", F.regexp_replace("tech", " [0-9]+$", ""))


def expected_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.expected_coverage(_plain(spark, sf))


def library_categories(spark: SparkSession, sf: str) -> DataFrame:
    return quality.library_categories(_technologies(spark, sf))


def sis_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.sis_candidates(_technologies(spark, sf)).select("tech", "description")


def segment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.segment_coverage(quality.sis_candidates(_technologies(spark, sf)))


def uncategorized_sis(spark: SparkSession, sf: str) -> DataFrame:
    return quality.uncategorized_sis(quality.sis_candidates(_technologies(spark, sf))).select("tech")


def import_rollup(spark: SparkSession, sf: str) -> DataFrame:
    named = _technologies(spark, sf).withColumn("tech", F.when(F.col("tech_ord") % 9 == 0, "Drupal").otherwise(F.col("tech")))
    return quality.import_rollup(named)


def reference_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reference_ledger(_technologies(spark, sf)).select("technology", "file", "legacy_names", "vendor_website", "priority")


def priority_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.priority_counts(quality.reference_ledger(_technologies(spark, sf)))


def capture_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Research rows with customer and demo addresses filled in by formula."""
    n = F.col("tech_ord")
    rows = quality.reference_ledger(_technologies(spark, sf).withColumn("tech", _cat(F.col("tech"), "#", n.cast("string"))))
    k = F.regexp_extract("technology", "#([0-9]+)$", 1).cast("long")
    site = lambda i: _cat("https://c", i, ".example.edu/", k.cast("string"))
    filled = rows.withColumns({
        "ord": k, "customer_url_1": F.when(k % 3 == 0, site("1")).otherwise(""), "customer_url_2": F.when(k % 6 == 0, site("2")).otherwise(""),
        "customer_url_3": F.when(k % 4 == 0, site("3")).otherwise(""), "vendor_demo_url": F.when(k % 2 == 1, site("demo")).otherwise(""),
        "unverifiable_public": F.when(k % 13 == 0, "true").otherwise("")})
    order = Window.partitionBy("tech").orderBy("bucket", "ord", "pos")
    work = quality.capture_worklist(filled)
    return work.withColumn("turn", F.row_number().over(order)).select("tech", "priority", "url", "bucket", "turn")


def capture_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    shots = demo.raw_pages(spark, sf).select(
        _cat("Tech ", (n % 4).cast("string")).alias("technology"), F.when(n % 10 == 0, "navigation failed").alias("error"),
        F.array(F.struct(_cat("TECH ", (n % 3).cast("string")).alias("name"), (n % 70).cast("int").alias("confidence"))).alias("matched_patterns"))
    return quality.capture_summary(shots)


def regression_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _regression(spark, sf).select("url", "suite", "rule", "tech", "confidence", "outcome")


def _regression(spark: SparkSession, sf: str) -> DataFrame:
    """Expectations for every site against its merged technologies."""
    pages = demo.demo_pages(spark, sf)
    found = detect(demo.demo_evidence(spark, sf), demo.library(spark), ["page_id", "site", "url", "page_ord"], demo.CONFIG)
    sites = pages.select("site").distinct()
    bits = F.length("site")
    expectations = sites.select(
        F.col("site").alias("url"), F.when(bits % 2 == 0, "false_positive").otherwise("true_positive").alias("suite"),
        F.array(F.lit("Markup"), F.lit("Joomla")).alias("expected"), F.array(F.lit("PHP"), F.lit("Admission CRM")).alias("must_not_match"),
        F.lit(90).alias("min_confidence"))
    return quality.regression_outcomes(expectations, merge_sites(found), "site")


def regression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.regression_summary(_regression(spark, sf))


def kind_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.kind_coverage(_signatures(spark, sf))


def rejected_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns no regex engine accepts, set aside at load: every fifth part's have a loose end."""
    broken = _signatures(spark, sf).withColumn(
        "pattern", F.when(F.col("tech_ord") % 5 == 0, _cat(F.col("pattern"), "(")).otherwise(F.col("pattern")))
    return library.rejected_signatures(library.prepare_signatures(broken)).select("tech", "kind", "pattern")


# ---- validation ----

def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a labelled snapshot; the label follows from the page number."""
    evidence = demo.demo_evidence(spark, sf)
    n = F.col("page_id")
    label = (F.when(n % 4 == 0, "wordpress ").when(n % 4 == 1, "Drupal").when(n % 4 == 2, "JOOMLA").otherwise("PHP"))
    return evidence.select(
        n.alias("ord"), label.alias("technology"), "url", "html", "scripts", "headers", "meta", "cookies", "js_objects")


def _demo_ledger(spark: SparkSession) -> DataFrame:
    rows = quality.ledger(demo.technology_frame(spark), demo.signature_frame(spark).filter("pattern != '(unclosed'"))
    status = F.when(F.col("technology") == "Apache", "manual").when(F.col("ord") == 1, "verified").otherwise("")
    note = F.when(F.col("technology") == "WordPress", "seen before").otherwise("")
    return rows.withColumns({"status": status, "notes": note})


def _results(spark: SparkSession, sf: str, mode: str = "validate") -> DataFrame:
    return validate.validation_results(_demo_ledger(spark), _snapshots(spark, sf), mode)


def snapshot_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = validate.snapshot_hits(_demo_ledger(spark), _snapshots(spark, sf))
    return hits.groupBy("technology", "field", "pattern").agg(
        F.count("*").alias("hits"), F.min("ord").alias("first_ord"), F.sum("ord").alias("ord_sum"))


def snapshot_hits_runtime(spark: SparkSession, sf: str) -> DataFrame:
    hits = validate.snapshot_hits(_demo_ledger(spark), _snapshots(spark, sf), "runtime")
    return hits.groupBy("technology", "field", "pattern").agg(F.count("*").alias("hits"), F.sum("ord").alias("ord_sum"))


def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("technology", "field", "pattern", "result", "own_hits", "other_hits", "first_own_url", "fp_note")


def ledger_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    return validate.update_ledger(_results(spark, sf)).select("technology", "field", "pattern", "status", "source_evidence", "notes")


def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validate.status_summary(validate.update_ledger(_results(spark, sf)))


def validation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return validate.status_rollup(validate.update_ledger(_results(spark, sf)))


def needs_attention(spark: SparkSession, sf: str) -> DataFrame:
    return validate.needs_attention(validate.update_ledger(_results(spark, sf))).drop("file")


# ---- mining ----

FINE = "source || '-' || (doc_id % 1000)"


def _corpus(spark: SparkSession, sf: str, institution: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as captured pages: a source, or a part of one, is an institution; a label puts a vendor in its profile."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("inst", F.expr(institution))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flags = docs.join(labels, "doc_id", "left").groupBy("inst").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    tech = lambda name, raw, cond: F.when(cond, F.struct(F.lit(name).alias("name"), F.array(F.lit(raw)).alias("raw_names")))
    profile = F.struct(F.create_map(F.lit("Site Search"), F.struct(
        F.array_compact(F.array(tech("SearchOne", "searchone", F.col("toxic") == 1), tech("Other", "other", F.lit(True)))).alias("current"),
        F.array_compact(F.array(tech("Old", "SearchOne", F.col("quality") == 0))).alias("historical"))).alias("categories"))
    institutions = flags.select(
        F.col("inst").alias("id"), _cat("Inst ", F.col("inst")).alias("name"),
        _cat("https://", F.col("inst"), ".example.edu").alias("website_url"), profile.alias("tech_profile"))
    scans = docs.select(F.col("doc_id").alias("id"), F.col("inst").alias("institution_id"))
    pages = docs.select(F.col("doc_id").alias("scan_id"), F.struct(
        _cat("https://", F.col("source"), "/", F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html")).alias("content"))
    return institutions, scans, pages


def _hits(spark: SparkSession, sf: str, signature: str, as_regex: bool = False, historical: bool = False,
          institution: str = "source") -> DataFrame:
    institutions, scans, pages = _corpus(spark, sf, institution)
    members = mining.universe(institutions, scans, pages, "Site Search", "SearchOne", historical, None, None)
    return mining.institution_hits(members, scans, pages, signature, as_regex)


def mine_signature(spark: SparkSession, sf: str) -> DataFrame:
    institutions = _corpus(spark, sf)[0]
    return mining.signature_metrics(_hits(spark, sf, "Er The"), mining.positives(institutions, "Site Search", "SearchOne"),
                                    "SearchOne", "Site Search", "Er The")


def mine_signature_historical(spark: SparkSession, sf: str) -> DataFrame:
    institutions = _corpus(spark, sf)[0]
    return mining.signature_metrics(
        _hits(spark, sf, r"\bcion\w+ de\b", True, True), mining.positives(institutions, "Site Search", "SearchOne", True),
        "SearchOne", "Site Search", r"\bcion\w+ de\b")


def institution_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "er the")


def mine_signature_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics on random samples of positives and negatives, smaller than their groups."""
    institutions, scans, pages = _corpus(spark, sf, FINE)
    members = mining.universe(institutions, scans, pages, "Site Search", "SearchOne", False, *SAMPLES)
    hits = mining.institution_hits(members, scans, pages, "er the")
    return mining.signature_metrics(hits, mining.positives(institutions, "Site Search", "SearchOne"), "SearchOne", "Site Search", "er the")


SAMPLES = (10, 40)


def spotcheck(spark: SparkSession, sf: str) -> DataFrame:
    institutions = _corpus(spark, sf, FINE)[0]
    return mining.spotcheck(_hits(spark, sf, "er the", institution=FINE), institutions)


QUERIES = {f.__name__: f for f in (
    library_load, library_merge, ledger_tiers, ledger_csv, tier_counts, audit_issues, audit_issues_all, duplicate_signatures, duplicate_places,
    audit_summary, incomplete_technologies, expected_coverage, library_categories, sis_candidates, segment_coverage,
    uncategorized_sis, import_rollup, reference_ledger, priority_counts, capture_worklist, capture_summary, regression_outcomes,
    regression_summary, kind_coverage, rejected_signatures, snapshot_hits, snapshot_hits_runtime, validation_status,
    ledger_upkeep, validation_summary, validation_rollup, needs_attention, mine_signature, mine_signature_historical,
    institution_hits, mine_signature_sampled, spotcheck)}


def _values(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_EXPECTED = [*fixed.EXPECTED_SYSTEMS, *[x for s in fixed.MARKET_SEGMENTS.values() for x in s]]
PARTS_SQL = f"""parts AS (
  SELECT p_partkey AS n, p_name, p_type, p_brand, p_size, split_part(p_name, ' ', 2) AS word, split_part(p_name, ' ', 1) AS kind,
    CASE WHEN p_partkey % 7 = 0 THEN ({_values(_EXPECTED)})[(p_partkey // 7) % {len(_EXPECTED)} + 1] ELSE p_name END AS base,
    'parts-' || p_brand || '.json' AS file
  FROM part
),
named AS (SELECT *, base || ' ' || n AS tech FROM parts)"""
SIGNATURES_SQL = f"""{PARTS_SQL},
texts AS (SELECT *, CASE n % 10 WHEN 0 THEN p_name WHEN 1 THEN '.*' || word || '.*' WHEN 2 THEN 'cdn\\.' || word || '\\.com'
    WHEN 3 THEN '/' || word || '_path\\b' WHEN 4 THEN left(word, 3) WHEN 5 THEN kind || '-' || word
    WHEN 6 THEN ({_values(fixed.AUDIT_COMMON_WORDS)})[n % {len(fixed.AUDIT_COMMON_WORDS)} + 1] WHEN 7 THEN 'class=".*' || word
    WHEN 8 THEN '\\$\\(' || word ELSE word || p_size || '?x' END AS text,
  ({_values([*fixed.AUDIT_SHORT_GLOBALS, *fixed.JS_GLOBALS])})[n % {len(fixed.AUDIT_SHORT_GLOBALS) + len(fixed.JS_GLOBALS)} + 1] AS js_name FROM named),
sigs AS (
  SELECT tech, n, file, 'html' AS field, 'html' AS kind, text AS shown, text AS head FROM texts
  UNION ALL SELECT tech, n, file, 'scripts', 'script', kind || '/' || word || '\\.js', kind || '/' || word || '\\.js' FROM texts
  UNION ALL SELECT tech, n, file, 'js', 'js', js_name, js_name FROM texts WHERE n % 4 = 0
  UNION ALL SELECT tech, n, file, 'headers', 'header', 'X-' || word || '=' || p_brand, 'X-' || word FROM texts WHERE n % 4 = 1
  UNION ALL SELECT tech, n, file, 'cookies', 'cookie', left(word, 3) || CASE WHEN n % 2 = 0 THEN '_session' ELSE '' END, left(word, 3) || CASE WHEN n % 2 = 0 THEN '_session' ELSE '' END FROM texts WHERE n % 4 = 2
  UNION ALL SELECT tech, n, file, 'meta', 'meta', CASE WHEN n % 2 = 0 THEN 'generator' ELSE word END || '=' || kind, CASE WHEN n % 2 = 0 THEN 'generator' ELSE word END FROM texts WHERE n % 4 = 3
)"""
_COMMON = f"list_contains({_values(fixed.TIER_COMMON_WORDS)}, lower(head))"
LEDGER_SQL = f"""{SIGNATURES_SQL},
led AS (SELECT s.*, CASE WHEN field = 'headers' THEN 'A' WHEN field = 'cookies' AND length(head) >= 6 THEN 'A'
  WHEN field = 'meta' AND NOT regexp_matches(head, 'generator', 'i') THEN 'B'
  WHEN field = 'js' THEN CASE WHEN length(head) <= 2 THEN 'C' WHEN regexp_matches(head, '^[A-Z][a-zA-Z0-9]{{4,}}$') THEN 'A' WHEN {_COMMON} THEN 'C' ELSE 'B' END
  WHEN length(head) < 4 THEN 'C' WHEN {_COMMON} THEN 'C' WHEN regexp_matches(head, '^\\.\\*[a-z]+\\.\\*$', 'i') THEN 'C'
  WHEN regexp_matches(head, '^class="?\\.\\*') THEN 'C' WHEN regexp_matches(head, '[a-z0-9-]+\\\\\\.(com|org|net|edu|io)', 'i') THEN 'A'
  WHEN regexp_matches(head, '^/[a-z0-9_-]{{4,}}', 'i') AND contains(head, '\\') THEN 'B'
  WHEN length(head) >= 8 AND regexp_matches(head, '[a-z]+[-_][a-z]+', 'i') THEN 'B' ELSE 'C' END AS tier,
  p_size || ';' || (s.n % 60) AS category, s.n % 3 = 0 AS higher_ed, CASE WHEN s.n % 11 = 0 THEN p_name || ';' || p_brand ELSE '' END AS legacy_names
  FROM sigs s JOIN parts ON parts.n = s.n)"""
_RAW = "replace(replace(shown, '\\\\', '\\'), '\\.', '.')"
AUDIT_SQL = f"""{SIGNATURES_SQL},
audited AS (SELECT *, kind IN ('html', 'script') AS is_text FROM sigs WHERE kind IN ('html', 'script', 'js')),
issues AS (
  SELECT 'ERROR' AS severity, tech, file, field, shown AS pattern, 'Pattern too short (' || length({_RAW}) || ' chars): "' || shown || '"' AS message FROM audited
    WHERE is_text AND length({_RAW}) < 4 AND NOT (regexp_matches(shown, '[\\\\.*+?^${{}}()|\\[\\]]') AND length(shown) > 6)
  UNION ALL SELECT 'ERROR', tech, file, field, shown, 'Standalone common word: "' || shown || '" - use more specific pattern' FROM audited
    WHERE is_text AND list_contains({_values(fixed.AUDIT_COMMON_WORDS)}, shown)
  UNION ALL SELECT 'WARNING', tech, file, field, shown, 'Overly broad regex pattern: "' || shown || '"' FROM audited
    WHERE is_text AND (regexp_matches(shown, '^\\.\\*[a-z]+\\.\\*$', 'i') OR regexp_matches(shown, '^class="?\\.\\*') OR starts_with(shown, '\\$\\('))
  UNION ALL SELECT 'ERROR', tech, file, field, shown, 'Short/common JS object name: "' || shown || '" - too likely to cause false positives' FROM audited
    WHERE kind = 'js' AND list_contains({_values(fixed.AUDIT_SHORT_GLOBALS)}, shown)
),
dups AS (SELECT field, shown AS pattern, count(*) AS uses FROM audited GROUP BY 1, 2 HAVING count(*) > 1)"""
_TECH_TEXT = "CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN 'Student information system for ' || p_type WHEN 2 THEN 'Management of ' || p_name || ' campus' ELSE p_type END"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


SIS_SQL = f"""{PARTS_SQL}, techs AS (SELECT *, {_TECH_TEXT} AS description FROM named),
sis AS (SELECT * FROM techs WHERE ({_any('lower(description)', fixed.SIS_KEYWORDS)} AND {_any('lower(description)', ('student', 'information', 'management', 'sis'))})
  OR ((p_size = 53 OR n % 60 = 53) AND n % 3 = 0) OR contains(lower(tech), 'sis')),
systems(segment, pos, system) AS (VALUES {", ".join(f"('{s}', {i}, '{x}')" for s, names in fixed.MARKET_SEGMENTS.items() for i, x in enumerate(names))})"""
_PRIORITY = f"""CASE WHEN n % 11 = 0 THEN 'high' WHEN {_any('tech', fixed.HIGH_PRIORITY_HINTS)} THEN 'high' WHEN {_any('tech', fixed.LOW_PRIORITY_HINTS)} THEN 'low' ELSE 'medium' END"""


def _validation_sql() -> str:
    """``led``: demo ledger rows; ``hits``: row and snapshot; ``res``: status per row."""
    return f"""{demo.matches_sql()},
shots AS (SELECT page_id AS ord, n, url, CASE n % 4 WHEN 0 THEN 'wordpress ' WHEN 1 THEN 'Drupal' WHEN 2 THEN 'JOOMLA' ELSE 'PHP' END AS snapshot_tech FROM dp),
led AS (
  SELECT tech AS technology, tech_ord, kind, ord, key, pattern AS regex,
    CASE kind WHEN 'script' THEN 'scripts' WHEN 'header' THEN 'headers' WHEN 'cookie' THEN 'cookies' ELSE kind END AS field,
    CASE WHEN kind IN ('html', 'script') THEN substr(label, strpos(label, ': ') + 2)
      WHEN kind IN ('header', 'meta') THEN CASE WHEN pattern = '' THEN rtrim(substr(label, strpos(label, ': ') + 2), '=') ELSE substr(label, strpos(label, ': ') + 2) END
      WHEN kind = 'cookie' AND pattern <> '' THEN key || '=' || pattern ELSE key END AS pattern
  FROM lib WHERE kind NOT IN ('network', 'dom')
),
globals(name, k, r) AS (VALUES ('React', 7, 0), ('jQuery', 2, 0), ('D2L', 9, 0), ('Drupal.settings', 4, 1)),
hits AS (
  SELECT DISTINCT l.technology, l.field, l.pattern, s.ord, s.url, s.snapshot_tech FROM led l JOIN ev ON ev.kind = l.kind JOIN shots s ON s.ord = ev.page_id
  WHERE l.kind IN ('html', 'script') AND regexp_matches(ev.value, l.regex, 'i')
     OR l.kind IN ('header', 'meta') AND ev.key = l.key AND (l.regex = '' OR regexp_matches(ev.value, l.regex, 'i'))
     OR l.kind = 'cookie' AND regexp_matches(ev.key, l.key, 'i') AND (l.regex = '' OR regexp_matches(ev.value, l.regex, 'i'))
  UNION SELECT l.technology, l.field, l.pattern, s.ord, s.url, s.snapshot_tech FROM led l, shots s WHERE l.kind = 'js'
),
own AS (SELECT *, lower(trim(technology)) = lower(trim(snapshot_tech)) AS is_own FROM hits),
foreign_hits AS (SELECT *, row_number() OVER (PARTITION BY technology, field, pattern ORDER BY ord) AS rn FROM own WHERE NOT is_own),
notes AS (SELECT technology, field, pattern, 'FP on: ' || string_agg(snapshot_tech, ', ' ORDER BY rn) FILTER (WHERE rn <= 2)
    || CASE WHEN count(*) > 2 THEN ' +' || (count(*) - 2) ELSE '' END AS fp_note FROM foreign_hits GROUP BY 1, 2, 3),
counts AS (SELECT technology, field, pattern, count(*) FILTER (WHERE is_own) AS own_hits, count(*) FILTER (WHERE NOT is_own) AS other_hits,
  arg_min(url, ord) FILTER (WHERE is_own) AS first_own FROM own GROUP BY 1, 2, 3),
res AS (
  SELECT l.technology, l.field, l.pattern, l.ord, coalesce(own_hits, 0) AS own_hits, coalesce(other_hits, 0) AS other_hits,
    k.known, CASE WHEN k.known IS NULL THEN 'no-evidence' WHEN own_hits > 0 AND other_hits > 0 THEN 'needs-review' WHEN own_hits > 0 THEN 'verified'
      WHEN other_hits > 0 THEN 'false-positive' ELSE 'suspect' END AS result,
    CASE WHEN k.known THEN first_own END AS first_own_url, CASE WHEN k.known THEN fp_note END AS fp_note
  FROM led l LEFT JOIN (SELECT DISTINCT lower(trim(snapshot_tech)) AS t, true AS known FROM shots) k ON k.t = lower(trim(l.technology))
  LEFT JOIN counts c ON c.technology = l.technology AND c.field = l.field AND c.pattern = l.pattern
  LEFT JOIN notes n ON n.technology = l.technology AND n.field = l.field AND n.pattern = l.pattern
),
before AS (SELECT *, CASE WHEN technology = 'Apache' THEN 'manual' WHEN ord = 1 THEN 'verified' ELSE '' END AS old_status,
  CASE WHEN technology = 'WordPress' THEN 'seen before' ELSE '' END AS old_notes FROM res),
kept AS (
  SELECT technology, 'custom.json' AS file, field, pattern,
    CASE WHEN old_status = 'manual' THEN old_status WHEN result = 'no-evidence' THEN CASE WHEN old_status = '' THEN 'no-evidence' ELSE old_status END ELSE result END AS status,
    CASE WHEN old_status <> 'manual' AND first_own_url IS NOT NULL THEN first_own_url ELSE '' END AS source_evidence,
    CASE WHEN old_status = 'manual' OR fp_note IS NULL THEN old_notes WHEN old_notes = '' THEN fp_note ELSE old_notes || ' | ' || fp_note END AS notes
  FROM before
)"""


_STATUS = """count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'needs-review') AS review,
  count(*) FILTER (WHERE status = 'suspect') AS suspect, count(*) FILTER (WHERE status = 'false-positive') AS false_positive, count(*) FILTER (WHERE status = 'no-evidence') AS no_evidence"""
def _mine(test: str, positive: str, institution: str = "source") -> str:
    return f"""docs AS (SELECT *, {institution} AS inst FROM documents),
inst AS (SELECT inst AS id, max(toxic) = 1 AS cur, min(quality) = 0 AS old FROM docs LEFT JOIN labels USING (doc_id) GROUP BY inst),
scanned AS (SELECT doc_id, inst AS id, text, 'https://' || source || '/' || doc_id AS url FROM docs),
whole AS (SELECT s.id, coalesce({positive}, false) AS is_pos, bool_or({test}) AS hit, min(url) FILTER (WHERE {test}) AS sample_hit_url, count(*) AS pages
  FROM scanned s JOIN inst USING (id) GROUP BY s.id, is_pos),
flagged AS (SELECT * FROM whole)"""


def _metrics(signature: str, positive: str) -> str:
    return f"""SELECT 'SearchOne' AS vendor, 'Site Search' AS category, '{signature}' AS signature, (SELECT count(*) FROM inst WHERE {positive}) AS positives_total,
  count(*) FILTER (WHERE is_pos) AS pos_with_html, count(*) FILTER (WHERE is_pos AND hit) AS pos_hit,
  CAST(round(100 * CAST(count(*) FILTER (WHERE is_pos AND hit) AS DECIMAL(18, 6)) / nullif(count(*) FILTER (WHERE is_pos), 0), 1) AS DOUBLE) AS recall_pct,
  count(*) FILTER (WHERE NOT is_pos) AS neg_with_html, count(*) FILTER (WHERE NOT is_pos AND hit) AS neg_hit,
  CAST(round(100 * CAST(count(*) FILTER (WHERE NOT is_pos AND hit) AS DECIMAL(18, 6)) / nullif(count(*) FILTER (WHERE NOT is_pos), 0), 3) AS DOUBLE) AS neg_hit_pct
FROM flagged"""


def oracles() -> dict[str, str]:
    led, aud, sis, val = f"WITH {LEDGER_SQL}", f"WITH {AUDIT_SQL}", f"WITH {SIS_SQL}", f"WITH {_validation_sql()}"
    names = {str(k): v for k, v in __import__("stackscan.fixed", fromlist=["x"]).CATEGORY_NAMES.items()}
    cats = ", ".join(f"({k}, '{v}')" for k, v in names.items())
    winner = """p AS (SELECT p_partkey AS n, *, split_part(p_name, ' ', 2) AS word, split_part(p_name, ' ', 1) AS kind FROM part)"""
    work = f"""{PARTS_SQL}, rows AS (SELECT *, tech || '#' || n AS t2, {_PRIORITY.replace('tech', "tech")} AS priority FROM named WHERE n % 13 <> 0),
urls AS (SELECT t2, priority, n, 1 AS pos, 'https://c1.example.edu/' || n AS url FROM rows WHERE n % 3 = 0
  UNION ALL SELECT t2, priority, n, 2, 'https://c2.example.edu/' || n FROM rows WHERE n % 6 = 0
  UNION ALL SELECT t2, priority, n, 3, 'https://c3.example.edu/' || n FROM rows WHERE n % 4 = 0
  UNION ALL SELECT t2, priority, n, 1, 'https://cdemo.example.edu/' || n FROM rows WHERE n % 2 = 1 AND n % 3 <> 0)"""
    site_len = "length(site)"
    reg = f"""WITH {demo.merged_sql()}, sites AS (SELECT DISTINCT site FROM dp),
rules(tech, rule) AS (VALUES ('Markup', 'expected'), ('Joomla', 'expected'), ('PHP', 'forbidden'), ('Admission CRM', 'forbidden')),
expd AS (SELECT site, tech, rule, CASE WHEN {site_len} % 2 = 0 THEN 'false_positive' ELSE 'true_positive' END AS suite FROM sites, rules),
outc AS (SELECT e.site AS url, suite, rule, e.tech, m.confidence, CASE WHEN rule = 'forbidden' AND m.confidence IS NOT NULL THEN 'false_positive' WHEN rule = 'forbidden' THEN 'pass'
  WHEN m.confidence IS NULL AND suite = 'false_positive' THEN 'warning' WHEN m.confidence IS NULL THEN 'true_positive_missing'
  WHEN suite = 'true_positive' AND m.confidence < 90 THEN 'low_confidence' ELSE 'pass' END AS outcome
  FROM expd e LEFT JOIN merged m ON m.site = e.site AND m.tech = e.tech WHERE rule = 'expected' OR suite = 'false_positive')"""
    kinds = ("html", "script", "network", "header", "meta", "dom", "js", "cookie")
    return {
        "library_load": f"""WITH {winner}, cat(id, name) AS (VALUES {cats}),
w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC) = 1)
SELECT p_name AS tech, 'file' || (n // 200) || '.json' AS file, p_type AS description, CAST(p_size AS VARCHAR) AS categories, n % 2 = 0 AS higher_ed,
  CAST(CASE WHEN n % 3 = 2 THEN 4 ELSE 5 END AS BIGINT) AS patterns, CAST(80 + 80 + 80 + CASE WHEN n % 3 = 2 THEN 0 ELSE 60 END AS BIGINT) AS weight,
  CASE n % 3 WHEN 0 THEN 'Script: ' || word WHEN 1 THEN 'Script: ' || kind ELSE 'JS: ' || word END AS last_label, coalesce(cat.name, 'Unknown') AS names
FROM w LEFT JOIN cat ON cat.id = p_size""",
        "library_merge": f"""WITH {winner} SELECT p_name AS tech, 'file' || arg_max(n // 200, ((n // 200) % 2, n)) || '.json' AS file FROM p GROUP BY p_name""",
        "ledger_tiers": f"{led} SELECT tech AS technology, file, category, field, shown AS pattern, tier, higher_ed, legacy_names FROM led",
        "ledger_csv": f"""{led} SELECT tech AS technology, field, shown AS pattern, tier, CAST(higher_ed AS VARCHAR) AS higher_ed, '' AS status,
  'said "' || tier || '", then' || chr(10) || 'next' AS notes FROM led""",
        "tier_counts": f"{led} SELECT tier, count(*) AS patterns FROM led GROUP BY tier",
        "audit_issues": f"{aud} SELECT * FROM issues",
        "audit_issues_all": f"""{aud} SELECT severity, tech, file, field, pattern, message FROM issues UNION ALL
SELECT 'INFO', 'Multiple', 'various', field, pattern, 'Duplicate pattern found in ' || uses || ' places' FROM dups""",
        "duplicate_signatures": f"{aud} SELECT * FROM dups",
        "duplicate_places": f"{aud} SELECT a.field, a.shown AS pattern, a.tech, a.file, uses FROM audited a JOIN dups d ON d.field = a.field AND d.pattern = a.shown",
        "audit_summary": f"""{aud} SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings,
  (SELECT count(*) FROM dups) AS infos, count(*) FILTER (WHERE severity = 'ERROR') = 0 AS passed FROM issues""",
        "incomplete_technologies": f"""WITH {PARTS_SQL} SELECT * FROM (SELECT tech, concat_ws(', ', CASE WHEN n % 5 = 0 THEN 'missing description' END,
  CASE WHEN n % 4 = 3 THEN 'no detection patterns' END) AS issues FROM named) WHERE issues <> ''""",
        "expected_coverage": f"""WITH {PARTS_SQL} SELECT count(DISTINCT base) FILTER (WHERE list_contains({_values(fixed.EXPECTED_SYSTEMS)}, base)) AS found, 20 AS expected,
  CAST(round(count(DISTINCT base) FILTER (WHERE list_contains({_values(fixed.EXPECTED_SYSTEMS)}, base)) * 100.0 / 20) AS INTEGER) AS pct FROM parts""",
        "library_categories": "SELECT CAST(p_size AS VARCHAR) AS category FROM part UNION SELECT CAST(p_partkey % 60 AS VARCHAR) FROM part",
        "sis_candidates": f"{sis} SELECT tech, description FROM sis",
        "segment_coverage": f"""{sis} SELECT segment, pos, system, arg_min(tech, n) FILTER (WHERE tech IS NOT NULL) AS found FROM systems
  LEFT JOIN sis ON contains(lower(tech), lower(system)) GROUP BY segment, pos, system""",
        "uncategorized_sis": f"{sis} SELECT tech FROM sis WHERE NOT EXISTS (SELECT 1 FROM systems WHERE contains(lower(sis.tech), lower(system)))",
        "import_rollup": f"""WITH {PARTS_SQL}, t AS (SELECT CASE WHEN n % 9 = 0 THEN 'Drupal' ELSE tech END AS tech, n, CASE WHEN p_size = 1 OR n % 60 = 1 THEN 'cms' WHEN p_size = 21 OR n % 60 = 21 THEN 'lms'
  WHEN p_size = 53 OR n % 60 = 53 THEN 'sis' END AS g FROM named)
SELECT category, count(*) AS technologies FROM (SELECT 'total' AS category FROM t UNION ALL SELECT g FROM t WHERE g IS NOT NULL
  UNION ALL SELECT CASE WHEN n % 3 = 0 THEN 'higher_ed' ELSE 'general' END FROM t UNION ALL SELECT 'popular_cms' FROM t WHERE g = 'cms' AND tech = 'Drupal') GROUP BY category""",
        "reference_ledger": f"""WITH {PARTS_SQL} SELECT tech AS technology, file, CASE WHEN n % 11 = 0 THEN p_name || ';' || p_brand ELSE '' END AS legacy_names,
  'https://' || word || '.example.com' AS vendor_website, {_PRIORITY} AS priority FROM named""",
        "priority_counts": f"WITH {PARTS_SQL} SELECT {_PRIORITY} AS priority, count(*) AS technologies FROM named GROUP BY 1",
        "capture_worklist": f"""WITH {work} SELECT t2 AS tech, priority, url, CASE WHEN priority = 'high' THEN 0 ELSE 1 END AS bucket,
  CAST(row_number() OVER (PARTITION BY t2 ORDER BY pos) AS INTEGER) AS turn FROM urls""",
        "capture_summary": """SELECT count(*) FILTER (WHERE page_id % 10 <> 0) AS captured, count(*) FILTER (WHERE page_id % 10 = 0) AS errors,
  count(*) FILTER (WHERE page_id % 10 <> 0 AND page_id % 4 = page_id % 3 AND page_id % 70 >= 30) AS matched,
  count(*) FILTER (WHERE page_id % 10 <> 0 AND NOT (page_id % 4 = page_id % 3 AND page_id % 70 >= 30)) AS missed FROM pages""",
        "regression_outcomes": f"{reg} SELECT * FROM outc",
        "regression_summary": f"{reg} SELECT url, suite, bool_and(outcome IN ('pass', 'warning')) AS passed FROM outc GROUP BY url, suite",
        "kind_coverage": f"WITH {SIGNATURES_SQL} SELECT tech, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in kinds) + " FROM sigs GROUP BY tech",
        "rejected_signatures": f"""WITH {SIGNATURES_SQL} SELECT s.tech, s.kind, CASE s.kind WHEN 'header' THEN p_brand WHEN 'meta' THEN p.kind WHEN 'cookie' THEN '' ELSE shown END || '(' AS pattern
FROM sigs s JOIN parts p ON p.n = s.n WHERE s.kind <> 'js' AND s.n % 5 = 0""",
        "snapshot_hits": f"{val} SELECT technology, field, pattern, count(*) AS hits, min(ord) AS first_ord, CAST(sum(ord) AS BIGINT) AS ord_sum FROM hits GROUP BY 1, 2, 3",
        "snapshot_hits_runtime": f"""{val}, m AS (SELECT DISTINCT tech, kind, ord, page_id FROM matches)
SELECT technology, field, pattern, count(*) AS hits, CAST(sum(page_id) AS BIGINT) AS ord_sum FROM led l JOIN m ON m.tech = l.technology AND m.kind = l.kind AND m.ord = l.ord GROUP BY 1, 2, 3""",
        "validation_status": f"{val} SELECT technology, field, pattern, result, own_hits, other_hits, first_own_url, fp_note FROM res",
        "ledger_upkeep": f"{val} SELECT technology, field, pattern, status, source_evidence, notes FROM kept",
        "validation_summary": f"""{val}, t AS (SELECT {_STATUS} FROM kept) SELECT *, """ + ", ".join(
            f"CAST(round(100.0 * {p} / total) AS INTEGER) AS {p}_pct" for p in ("verified", "review", "suspect", "false_positive", "no_evidence")) + " FROM t",
        "validation_rollup": f"{val} SELECT file, technology, {_STATUS} FROM kept GROUP BY ROLLUP (file, technology)",
        "needs_attention": f"{val} SELECT technology, field, pattern, status, notes FROM kept WHERE status IN ('suspect', 'false-positive', 'needs-review')",
        "mine_signature": f"WITH {_mine('contains(lower(text), ' + chr(39) + 'er the' + chr(39) + ')', 'cur')} {_metrics('Er The', 'cur')}",
        "mine_signature_historical": f"WITH {_mine('regexp_matches(text, ' + chr(39) + chr(92) + 'bcion' + chr(92) + 'w+ de' + chr(92) + 'b' + chr(39) + ', ' + chr(39) + 'i' + chr(39) + ')', '(cur OR old)')} {_metrics(chr(92) + 'bcion' + chr(92) + 'w+ de' + chr(92) + 'b', '(cur OR old)')}",
        "mine_signature_sampled": "WITH " + _mine("contains(lower(text), 'er the')", "cur", FINE).replace("flagged AS (SELECT * FROM whole)", f"""flagged AS (
  SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY is_pos ORDER BY md5(id || CASE WHEN is_pos THEN '#0' ELSE '#1' END), id)
    <= CASE WHEN is_pos THEN {SAMPLES[0]} ELSE {SAMPLES[1]} END)""") + _metrics("er the", "cur"),
        "spotcheck": "WITH " + _mine("contains(lower(text), 'er the')", "cur", FINE) + f""" SELECT CASE WHEN is_pos THEN 'pos_miss' ELSE 'neg_hit' END AS kind, id,
  'Inst ' || id AS name, 'https://' || id || '.example.edu' AS website, CASE WHEN NOT is_pos THEN sample_hit_url END AS sample_hit_url
FROM flagged WHERE hit <> is_pos QUALIFY row_number() OVER (PARTITION BY is_pos ORDER BY md5(id || '#0'), id) <= {mining.SPOTCHECK_ROWS}""",
        "institution_hits": f"WITH {_mine('contains(lower(text), ' + chr(39) + 'er the' + chr(39) + ')', 'cur')} SELECT * FROM flagged",
    }
