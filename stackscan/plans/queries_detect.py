"""Registered queries: matching, scoring, roll-up (M, R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.model import ScanConfig
from stackscan.operators import match, rollup
from stackscan.plans import demo, scan
from stackscan.sources import sinks

IDS = ["page_id"]


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return demo.demo_evidence(spark, sf)


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return match.signature_matches(_evidence(spark, sf), demo.library(spark), IDS)


def _detections(spark: SparkSession, sf: str, config: ScanConfig = demo.CONFIG) -> DataFrame:
    ids = ["page_id", "site", "url", "page_ord"]
    return match.detect(_evidence(spark, sf), demo.library(spark), ids, config)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.merge_sites(_detections(spark, sf))


def _list(column: str | Column) -> Column:
    return F.array_join(column, "|")


def detect_pages(spark: SparkSession, sf: str) -> DataFrame:
    """HTML signatures on the pages as they are: match, score, threshold."""
    found = match.detect(demo.raw_pages(spark, sf), demo.library(spark), IDS, demo.CONFIG)
    return found.select("page_id", "tech", "confidence")


def detect_all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _detections(spark, sf).select(
        "page_id", "rank", "tech", "confidence", _list("categories").alias("categories"),
        _list("evidence").alias("evidence"), "version", "is_higher_ed", "description")


def kind_matches(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _matches(spark, sf).filter(F.col("kind") == kind).select("page_id", "tech", "label", "weight")
    return query


def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = _detections(spark, sf, ScanConfig(capture_network=True, min_confidence=0, include_evidence=False))
    return found.select("page_id", "tech", "confidence", F.size("evidence").alias("evidence_items"))


def strict_versions(spark: SparkSession, sf: str) -> DataFrame:
    found = _detections(spark, sf, ScanConfig(capture_network=True, loose_version=False))
    return found.filter("version is not null").select("page_id", "tech", "version")


def site_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select(
        "site", "rank", "tech", "confidence", _list("categories").alias("categories"),
        _list("evidence").alias("evidence"), "version", "is_higher_ed", "description")


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Merge over page sources: later pages of a site count as additional pages."""
    found = _detections(spark, sf)
    main = found.filter("page_id % 3 = 0")
    merged = rollup.merge_sites(rollup.union_sources(main=main, additional=found.filter("page_id % 3 != 0")))
    return merged.select("site", "tech", "confidence", "version", F.size("evidence").alias("evidence_items"))


def _stack(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.stack_components(_merged(spark, sf))


def _slots() -> list:
    return [*rollup.STACK_SINGLE, *[_list(c).alias(c) for c in rollup.STACK_LISTS]]


def stack_components(spark: SparkSession, sf: str) -> DataFrame:
    return _stack(spark, sf).select("site", *_slots())


def stack_components_highest(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.stack_components(_merged(spark, sf), prefer="highest").select("site", *rollup.STACK_SINGLE)


def stack_inferences(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.stack_inferences(_stack(spark, sf)).select("site", _list("inferences").alias("inferences"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return scan.budgeted_scan(demo.demo_pages(spark, sf), demo.library(spark), demo.CONFIG)


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform("technologies", lambda t: F.concat(t["name"], F.lit(":"), t["confidence"].cast("string")))
    return _documents(spark, sf).select(
        "site", "url", "scanned_pages", _list("scanned_urls").alias("scanned_urls"), _list(names).alias("technologies"),
        F.col("inferred_stack.components.cms").alias("cms"), _list("inferred_stack.inferences").alias("inferences"))


def _whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all pages, whatever their number."""
    pages = demo.demo_pages(spark, sf)
    return rollup.scan_documents(scan.page_scans(pages), _merged(spark, sf))


def document_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON and read back."""
    text = sinks.document_json(_whole_documents(spark, sf))
    schema = "struct<site:string,technologies:array<struct<name:string>>,scanned_pages:int>"
    parsed = text.select(F.from_json("document", schema).alias("d"))
    return parsed.select("d.site", F.size("d.technologies").alias("technologies"), "d.scanned_pages")


def store_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The store's row per scan and technology."""
    return sinks.detected_rows(_whole_documents(spark, sf)).select(
        "url", "tech", "confidence", _list("categories").alias("categories"), "version", "is_higher_ed")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.category_counts(_merged(spark, sf))


def higher_ed_subset(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.higher_ed_subset(_merged(spark, sf))


def evidence_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.evidence_preview(_merged(spark, sf)).select("site", "tech", _list("shown").alias("shown"), "more")


def confident_detections(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.confident(_merged(spark, sf), 80).select("site", "tech", "confidence")


def cms_detections(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.in_category(_merged(spark, sf), "CMS").select("site", "tech", "confidence")


def site_comparison(spark: SparkSession, sf: str) -> DataFrame:
    top = F.transform("top_technologies", lambda t: F.concat(t["name"], F.lit(":"), t["confidence"].cast("string")))
    return rollup.site_comparison(_merged(spark, sf)).select(
        "site", "total_tech", "higher_ed_tech", "cms", "lms", "sis", _list(top).alias("top_technologies"))


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Scans whose URL may not be scanned or lies on an excluded path fail."""
    pages = demo.demo_pages(spark, sf)
    error = F.when(F.col("url").rlike("[.]html$"), "not a page").when(F.col("page_id") % 9 == 4, "timeout")
    return rollup.scan_summary(pages.withColumn("error", error), ["site"])


def failed_scans(spark: SparkSession, sf: str) -> DataFrame:
    pages = demo.raw_pages(spark, sf)
    error = F.when(F.col("url").rlike("[.]html$"), "not a page").when(F.col("page_id") % 9 == 4, "timeout")
    return rollup.failed_scans(pages.withColumn("error", error))


def versioned_technologies(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.versioned_technologies(_merged(spark, sf))


def channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.channel_counts(_detections(spark, sf))


def network_technologies(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.channel_technologies(_detections(spark, sf), "Network")


def _spread(pages: DataFrame) -> DataFrame:
    """Pages dealt out to all cores: a table of one small file is one task, whatever its pages cost."""
    return pages.repartition(pages.sparkSession.sparkContext.defaultParallelism)


def match_large_library(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of signatures of all kinds."""
    found = match.signature_matches(_spread(_evidence(spark, sf)), demo.large_library(spark, sf), IDS)
    return found.select("page_id", "tech", "kind", "label", "weight")


def detect_large_library(spark: SparkSession, sf: str) -> DataFrame:
    found = match.detect(_spread(_evidence(spark, sf)), demo.large_library(spark, sf), IDS, demo.CONFIG)
    return found.select("page_id", "rank", "tech", "confidence", F.size("evidence").alias("evidence_items"))


QUERIES = {
    "match_large_library": match_large_library, "detect_large_library": detect_large_library,
    "detect_pages": detect_pages, "detect_all_kinds": detect_all_kinds,
    **{f"match_{k}": kind_matches(k) for k in ("html", "script", "network", "header", "meta", "dom", "js", "cookie")},
    "page_scores": page_scores, "strict_versions": strict_versions, "site_merge": site_merge, "source_union": source_union,
    "stack_components": stack_components, "stack_components_highest": stack_components_highest,
    "stack_inferences": stack_inferences, "scan_documents": scan_documents, "document_json": document_json,
    "store_rows": store_rows, "category_counts": category_counts, "higher_ed_subset": higher_ed_subset,
    "evidence_preview": evidence_preview, "confident_detections": confident_detections, "cms_detections": cms_detections,
    "site_comparison": site_comparison, "scan_summary": scan_summary, "failed_scans": failed_scans,
    "versioned_technologies": versioned_technologies, "channel_counts": channel_counts,
    "network_technologies": network_technologies,
}

_STACK = """
  SELECT site,
    arg_max(tech, rank) FILTER (WHERE list_contains(c, 'cms')) AS cms, arg_max(tech, rank) FILTER (WHERE list_contains(c, 'lms')) AS lms,
    arg_max(tech, rank) FILTER (WHERE list_contains(c, 'sis')) AS sis, arg_max(tech, rank) FILTER (WHERE list_contains(c, 'crm')) AS crm,
    coalesce(string_agg(tech, '|' ORDER BY rank) FILTER (WHERE list_contains(c, 'analytics')), '') AS analytics,
    coalesce(string_agg(tech, '|' ORDER BY rank) FILTER (WHERE list_contains(c, 'javascript framework') OR list_contains(c, 'javascript')), '') AS javascript,
    coalesce(string_agg(tech, '|' ORDER BY rank) FILTER (WHERE list_contains(c, 'web server')), '') AS server,
    coalesce(string_agg(tech, '|' ORDER BY rank) FILTER (WHERE list_contains(c, 'cdn')), '') AS cdn
  FROM (SELECT *, list_transform(categories, lambda x: lower(x)) AS c FROM merged) GROUP BY site"""
_INFER = """concat_ws('|',
    CASE WHEN cms = 'WordPress' AND list_contains(string_split(javascript, '|'), 'React') THEN 'WordPress with React frontend (likely headless WordPress)' END,
    CASE WHEN lms = 'Canvas LMS' AND list_contains(string_split(server, '|'), 'Apache') THEN 'Canvas LMS hosted on Apache (standard institutional setup)' END,
    CASE WHEN cms = 'Drupal' AND list_contains(string_split(analytics, '|'), 'Google Analytics') THEN 'Enterprise Drupal with Google Analytics integration' END,
    CASE WHEN sis IS NOT NULL AND lms IS NOT NULL THEN 'Integrated SIS (' || sis || ') and LMS (' || lms || ') environment' END)"""
_FAILED = "CASE WHEN url LIKE '%.html' THEN 'not a page' WHEN page_id % 9 = 4 THEN 'timeout' END"


def _budget_sql() -> str:
    """``det`` restricted to each site's first five pages, minus excluded paths, then merged."""
    from stackscan.fixed import EXCLUDED_PATHS
    out = " OR ".join(f"contains(lower(path), '{p}')" for p in EXCLUDED_PATHS)
    chosen = f"""chosen AS (
  SELECT * FROM (SELECT *, bool_or(slot = 1 AND excluded) OVER (PARTITION BY site) AS no_main FROM (SELECT *, {out} AS excluded FROM (
    SELECT page_id, site, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
      row_number() OVER (PARTITION BY site ORDER BY page_id) AS slot FROM dp)) WHERE slot <= 5) WHERE NOT excluded AND NOT no_main
)"""
    merged = demo.merged_sql()
    # the roll-up reads the chosen pages' detections
    return merged.replace("labels AS (", chosen + ",\nlabels AS (", 1).replace(
        "generate_subscripts(evidence, 1) AS i FROM det)", "generate_subscripts(evidence, 1) AS i FROM det SEMI JOIN chosen USING (page_id))").replace(
        "count(*) AS pages\n  FROM det GROUP BY", "count(*) AS pages\n  FROM det SEMI JOIN chosen USING (page_id) GROUP BY")


def oracles() -> dict[str, str]:
    d, m = f"WITH {demo.detections_sql()}", f"WITH {demo.merged_sql()}"
    matches = f"WITH {demo.matches_sql()}"
    budget = f"WITH {_budget_sql()}"
    shown = "list_contains(list_transform(categories, lambda x: lower(x)), 'cms')"
    large = f"WITH {demo.large_matches_sql()}"
    out = {
        "match_large_library": f"{large} SELECT page_id, tech, kind, label, weight FROM matches",
        "detect_large_library": f"""{large}, hits AS (SELECT *, row_number() OVER (PARTITION BY page_id, tech, kind ORDER BY ord) AS hit FROM matches),
scored AS (SELECT page_id, tech, tech_ord, CAST(least(sum(weight), 100) AS INTEGER) AS confidence, CAST(count(*) FILTER (WHERE kind <> 'html' OR hit <= 11) AS INTEGER) AS evidence_items
  FROM hits GROUP BY page_id, tech, tech_ord HAVING sum(weight) >= 30)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, tech_ord) AS INTEGER) AS rank, tech, confidence, evidence_items FROM scored""",
        "detect_pages": f"""WITH {demo.library_sql()}
SELECT page_id, tech, CAST(least(sum(weight), 100) AS INTEGER) AS confidence
FROM pages JOIN lib ON lib.kind = 'html' AND regexp_matches(html, pattern, 'i') GROUP BY page_id, tech HAVING sum(weight) >= 30""",
        "detect_all_kinds": d + """ SELECT page_id, rank, tech, confidence, array_to_string(categories, '|') AS categories,
  array_to_string(evidence, '|') AS evidence, version, is_higher_ed, description FROM det""",
        "page_scores": matches + """ SELECT page_id, tech, CAST(least(sum(weight), 100) AS INTEGER) AS confidence, 0 AS evidence_items
FROM matches GROUP BY page_id, tech""",
        "strict_versions": d + """ SELECT s.page_id, s.tech, fact.version FROM scored s JOIN fact ON fact.page_id = s.page_id AND fact.tech = s.tech
WHERE s.confidence >= 30""",
        "site_merge": m + """ SELECT site, rank, tech, confidence, array_to_string(categories, '|') AS categories,
  array_to_string(evidence, '|') AS evidence, version, is_higher_ed, description FROM merged""",
        "source_union": d + """, ordered AS (SELECT *, (CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END, page_id, rank) AS place FROM det),
items AS (SELECT site, tech, CAST(count(DISTINCT label) AS INTEGER) AS evidence_items FROM (SELECT site, tech, unnest(evidence) AS label FROM det) GROUP BY site, tech)
SELECT o.site, o.tech, max(confidence) AS confidence, arg_min(version, place) FILTER (WHERE version IS NOT NULL) AS version, any_value(evidence_items) AS evidence_items
FROM ordered o JOIN items USING (site, tech) GROUP BY o.site, o.tech""",
        "stack_components": f"{m} {_STACK}",
        "stack_components_highest": m + " SELECT site, " + ", ".join(
            f"arg_min(tech, rank) FILTER (WHERE list_contains(list_transform(categories, lambda x: lower(x)), '{s}')) AS {s}"
            for s in ("cms", "lms", "sis", "crm")) + " FROM merged GROUP BY site",
        "stack_inferences": f"{m}, stack AS ({_STACK}) SELECT site, {_INFER} AS inferences FROM stack",
        "scan_documents": f"""{budget}, stack AS ({_STACK}),
heads AS (SELECT site, arg_min(url, page_id) AS url, CAST(count(*) AS INTEGER) AS scanned_pages, string_agg(url, '|' ORDER BY page_id) AS scanned_urls
  FROM chosen GROUP BY site),
names AS (SELECT site, string_agg(tech || ':' || confidence, '|' ORDER BY rank) AS technologies FROM merged GROUP BY site)
SELECT site, url, scanned_pages, scanned_urls, coalesce(technologies, '') AS technologies, cms, coalesce({_INFER}, '') AS inferences
FROM heads LEFT JOIN names USING (site) LEFT JOIN stack USING (site)""",
        "document_json": f"""{m}, heads AS (SELECT site, CAST(count(*) AS INTEGER) AS scanned_pages FROM dp GROUP BY site),
names AS (SELECT site, CAST(count(*) AS INTEGER) AS technologies FROM merged GROUP BY site)
SELECT site, coalesce(technologies, 0) AS technologies, scanned_pages FROM heads LEFT JOIN names USING (site)""",
        "store_rows": f"""{m}, heads AS (SELECT site, arg_min(url, page_id) AS url FROM dp GROUP BY site)
SELECT url, tech, confidence, array_to_string(categories, '|') AS categories, version, is_higher_ed FROM heads JOIN merged USING (site)""",
        "category_counts": m + " SELECT category, count(*) AS technologies FROM (SELECT unnest(categories) AS category FROM merged) GROUP BY category",
        "higher_ed_subset": m + " SELECT site, tech, confidence FROM merged WHERE is_higher_ed",
        "evidence_preview": m + """ SELECT site, tech, array_to_string(evidence[1:3], '|') AS shown,
  CAST(greatest(len(evidence) - 3, 0) AS INTEGER) AS more FROM merged""",
        "confident_detections": m + " SELECT site, tech, confidence FROM merged WHERE confidence >= 80",
        "cms_detections": m + f" SELECT site, tech, confidence FROM merged WHERE {shown}",
        "site_comparison": f"""{m}, stack AS ({_STACK})
SELECT site, count(*) AS total_tech, count(*) FILTER (WHERE is_higher_ed) AS higher_ed_tech, any_value(cms) AS cms, any_value(lms) AS lms, any_value(sis) AS sis,
  string_agg(tech || ':' || confidence, '|' ORDER BY rank) FILTER (WHERE rank <= 5) AS top_technologies
FROM merged JOIN stack USING (site) GROUP BY site""",
        "scan_summary": f"""SELECT {demo.SITE_SQL} AS site, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful,
  count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM (SELECT *, {_FAILED} AS error FROM pages) GROUP BY 1""",
        "failed_scans": f"SELECT url, error FROM (SELECT url, {_FAILED} AS error FROM pages) WHERE error IS NOT NULL",
        "versioned_technologies": m + " SELECT site, tech, version FROM merged WHERE version IS NOT NULL",
        "channel_counts": d + """, channels AS (SELECT DISTINCT page_id, tech, split_part(label, ':', 1) AS channel FROM (SELECT page_id, tech, unnest(evidence) AS label FROM det)),
counted AS (SELECT *, count(*) OVER (PARTITION BY page_id, tech) AS n FROM channels)
SELECT channel, count(*) AS detections, count(DISTINCT tech) AS technologies, count(*) FILTER (WHERE n = 1) AS sole_detections FROM counted GROUP BY channel""",
        "network_technologies": matches + """, s AS (SELECT page_id, tech, sum(weight) AS w, count(*) FILTER (WHERE kind = 'network') AS net FROM matches GROUP BY ALL)
SELECT tech, count(*) AS detections FROM s WHERE w >= 30 AND net > 0 GROUP BY tech""",
    }
    for kind in ("html", "script", "network", "header", "meta", "dom", "js", "cookie"):
        out[f"match_{kind}"] = matches + f" SELECT page_id, tech, label, weight FROM matches WHERE kind = '{kind}'"
    return out
