"""Registered queries: evidence extraction and crawl frontier (E, F, S8, S9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.functions.columns import unnest
from stackscan.model import ScanConfig
from stackscan.operators import frontier
from stackscan.operators.candidates import shared_folder
from stackscan.operators.evidence import long_evidence
from stackscan.plans import demo, scan
from stackscan.sources import snapshots

# Link rules that find something on the test pages.
LINKS = ScanConfig(strategic_paths=("/student", "/the", "log in", "/library"), fallback_words=("a", "course"),
                   excluded_paths=("/login", "/es/", ".html"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return demo.demo_evidence(spark, sf)


def _list(column):
    return F.array_join(column, "|")


def _pairs(column: str):
    """A map as text, by key."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def page_source(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with their length and site: source and HTML evidence."""
    pages = demo.raw_pages(spark, sf).withColumn("site", urls.root_host(F.col("url")))
    return pages.select("page_id", "site", F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


def script_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = unnest(_evidence(spark, sf), ["page_id"], "scripts", "s", "pos")
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), "s.src", "s.version")


def meta_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return unnest(_evidence(spark, sf), ["page_id"], F.map_entries("meta"), "e").select("page_id", "e.key", "e.value")


def header_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return unnest(_evidence(spark, sf), ["page_id"], F.map_entries("headers"), "e").select("page_id", "e.key", "e.value")


def cookie_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return unnest(_evidence(spark, sf), ["page_id"], "cookies", "c").select("page_id", "c.name", "c.value", "c.domain")


def dom_strings(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select(
        "page_id", "dom.title", "dom.body_classes", "dom.body_id", F.md5("dom.head_content").alias("head_digest"))


def element_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("page_id", _pairs("has_elements").alias("flags"))


def js_globals(spark: SparkSession, sf: str) -> DataFrame:
    from stackscan.operators.evidence import js_globals as globals_of
    present = F.map_filter(globals_of(F.col("js_objects")), lambda k, v: v)
    return _evidence(spark, sf).select(
        "page_id", F.size(globals_of(F.col("js_objects"))).alias("recorded"), _list(F.array_sort(F.map_keys(present))).alias("present"))


def network_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("page_id", _list("network_hosts").alias("hosts"))


def version_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = unnest(_evidence(spark, sf), ["page_id"], F.map_entries("version_info"), "e")
    return rows.select("page_id", F.col("e.key").alias("product"), F.col("e.value").alias("version"))


def all_version_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Version facts of every product, shown by the page or stated in its text."""
    evidence = demo.extract_evidence(demo.versioned_pages(spark, sf), demo.CONFIG)
    rows = unnest(evidence, ["page_id"], F.map_entries("version_info"), "e")
    return rows.select("page_id", F.col("e.key").alias("product"), F.col("e.value").alias("version"))


def api_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("page_id", _list("api_endpoints").alias("endpoints"))


def link_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = frontier.page_links(_evidence(spark, sf), ["page_id"])
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), "href", "text")


def long_evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_evidence(_evidence(spark, sf), ["page_id"])
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return demo.raw_pages(spark, sf).select(
        "page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.origin(url).alias("origin"),
        urls.root_host(url).alias("root_host"), urls.host_slug(url).alias("host_slug"), urls.tech_slug(url).alias("tech_slug"))


def _odd_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs, some changed to addresses that may not be scanned."""
    n, path = F.col("page_id"), F.col("url")
    url = (F.when(n % 10 == 1, F.regexp_replace(path, "^https?://[^/]+", "http://localhost:8080"))
           .when(n % 10 == 2, F.regexp_replace(path, "^https?://[^/]+", "http://172.20.0.5"))
           .when(n % 10 == 3, F.regexp_replace(path, "^https?:", "ftp:"))
           .when(n % 10 == 4, F.regexp_replace(path, "^https?://", "")).when(n % 10 == 5, F.lit(""))
           .when(n % 10 == 6, F.regexp_replace(path, "^https?://[^/]+", "https://172.32.0.5")).otherwise(path))
    return demo.raw_pages(spark, sf).select("page_id", url.alias("url"))


def url_admission(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_urls(spark, sf).select("page_id", F.coalesce(urls.rejection(F.col("url")), F.lit("admitted")).alias("verdict"))


def rejected_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.admit(_odd_urls(spark, sf))[1].select("page_id", "url", "reason")


def strategic_links(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.strategic_links(_evidence(spark, sf), ["page_id"], LINKS)


def fallback_links(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.fallback_links(_evidence(spark, sf), ["page_id"], LINKS)


def excluded_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = demo.raw_pages(spark, sf).withColumn("final_url", F.col("url"))
    return frontier.drop_excluded(pages, LINKS).select("page_id", "url")


def page_budget(spark: SparkSession, sf: str) -> DataFrame:
    links = frontier.candidate_links(_evidence(spark, sf), ["site", "page_ord"], LINKS)
    return frontier.page_budget(links, "site", ["page_ord", "pos"], LINKS).select("site", "slot", "href", "source")


def unscanned_links(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate links minus the pages of even number, which count as scanned."""
    links = frontier.candidate_links(_evidence(spark, sf), ["page_id"], LINKS)
    pages = demo.demo_pages(spark, sf).filter("page_id % 2 = 0")
    scanned = pages.select(F.concat(urls.origin(F.col("url")), F.lit("/student/login?x="), F.col("page_id").cast("string")).alias("href"))
    return frontier.not_scanned(links, scanned, "href").select("page_id", "href", "source")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response log: two fetches per derived or probed address, by formula."""
    sites = demo.raw_pages(spark, sf).select(F.concat(urls.origin(F.col("url")), F.lit("/")).alias("url"), "page_id")
    first = sites.groupBy("url").agg(F.min("page_id").alias("n"))
    derived = frontier.derived_candidates(first).select(
        F.col("candidate").alias("url"), "n", (F.col("prefix_ord") + F.col("variant")).alias("k"))
    probes = frontier.probe_targets(first).select(
        F.col("target").alias("url"), "n", F.col("probe_ord").alias("k"))
    asked = derived.unionByName(probes).groupBy("url").agg(F.min("n").alias("n"), F.min("k").alias("k"))
    m = F.col("n") + F.col("k")
    rows = asked.select("url", "n", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("fetch"))
    status = F.when(m % 5 == 0, 200).when(m % 5 == 1, 404).when(m % 5 == 2, 403).when(m % 5 == 3, 301).otherwise(500)
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return rows.select(
        "url", "n", F.timestamp_seconds(F.col("fetch") * 3600).alias("fetched_at"),
        F.when(F.col("fetch") == 1, 500).otherwise(status).alias("status"),
        F.create_map(F.lit("Server"), text("s", F.col("k").cast("string"))).alias("headers"),
        text("body ", F.col("k").cast("string"), " of ", F.col("n").cast("string")).alias("body"))


def _site_roots(spark: SparkSession, sf: str) -> DataFrame:
    return demo.raw_pages(spark, sf).select(F.concat(urls.origin(F.col("url")), F.lit("/")).alias("url")).distinct()


def derived_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.derived_candidates(_site_roots(spark, sf))


def reachable_derived(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.reachable_derived(frontier.derived_candidates(_site_roots(spark, sf)), _responses(spark, sf))


def probe_targets(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.probe_targets(_site_roots(spark, sf))


def probe_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = frontier.probe_pages(frontier.probe_targets(_site_roots(spark, sf)), _responses(spark, sf))
    return pooled.select("url", "html", _pairs("headers").alias("headers"), _list("api_endpoints").alias("api_endpoints"))


def linked_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A whole scan per site: main page, linked pages, derived pages, pooled probes."""
    pages = demo.demo_pages(spark, sf)
    seeds = pages.groupBy("site").agg(F.min_by("url", "page_ord").alias("url"))
    documents = scan.linked_scan(seeds, pages, _responses(spark, sf), demo.library(spark), LINKS)
    names = F.transform("technologies", lambda t: F.concat(t["name"], F.lit(":"), t["confidence"].cast("string")))
    return documents.select("site", "url", "scanned_pages", _list(names).alias("technologies"),
                            _list("inferred_stack.inferences").alias("inferences"))


def snapshot_source(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a snapshot in two files, read back: records that do not parse or name no technology
    are skipped, missing companions give empty HTML."""
    n, label = F.col("page_id"), F.element_at(F.array(*map(F.lit, ("WordPress", "Drupal", "Canvas LMS", "PHP"))), (F.col("page_id") % 4 + 1).cast("int"))
    stem = F.concat(urls.tech_slug(label), F.lit("/page-"), n.cast("string"))
    record = F.to_json(F.struct(
        F.when(n % 13 != 5, label).alias("technology"), "url", (F.lit(200) + n % 3).cast("int").alias("response_status"),
        F.concat(F.lit("tests/"), stem, F.lit(".html")).alias("html_file"),
        F.struct(F.create_map(F.lit("server"), F.concat(F.lit("s"), n % 5)).alias("headers")).alias("evidence")))
    files = F.array(F.struct(F.concat(stem, F.lit(".json")).alias("path"), F.when(n % 11 == 3, F.substring(record, 1, 40)).otherwise(record).alias("text")),
                    F.struct(F.concat(stem, F.lit(".html")).alias("path"), F.when(n % 6 != 5, F.col("html")).alias("text")))
    folder = shared_folder(spark, "snapshots")
    snapshots.write_files(demo.raw_pages(spark, sf).select(F.inline(files)), folder)
    return snapshots.read_snapshots(spark, folder).select(
        "technology", "url", "response_status", "html_file", F.col("evidence.headers")["server"].alias("server"),
        F.char_length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as labelled snapshots: cut cookie values and probe bodies, file names, own-match flag."""
    e = _evidence(spark, sf).withColumns({
        "technology": F.concat(F.lit("Site "), "site"), "final_url": F.col("url"), "captured_at": F.timestamp_seconds("page_id"),
        "response_status": F.lit(200),
        "cookies": F.transform("cookies", lambda c: c.withField("value", F.repeat(c["value"], 30))),
        "probe_results": F.create_map(F.lit("/user/login"), F.struct(
            F.col("url"), F.lit("timeout").alias("status"), F.col("url").alias("redirect_to"), F.repeat("url", 20).alias("body_excerpt"))),
        "matched_patterns": F.array(F.struct(
            F.upper(F.concat(F.lit("Site "), "site")).alias("name"), (F.col("page_id") % 60).cast("int").alias("confidence"),
            F.array().cast("array<string>").alias("evidence")))})
    rows = snapshots.snapshot_rows(e)
    probe = F.try_element_at("probe_results", F.lit("/user/login"))
    return rows.select(
        "url", "html_file", "target_tech_matched", F.coalesce(F.array_max(F.transform("evidence.cookies", lambda c: F.length(c["value"]))), F.lit(0)).alias("longest_cookie"),
        F.length(probe["body_excerpt"]).alias("body_chars"), probe["status"].alias("status"))


QUERIES = {f.__name__: f for f in (
    page_source, script_evidence, meta_evidence, header_evidence, cookie_evidence, dom_strings, element_flags, js_globals,
    network_hosts, version_facts, api_endpoints, link_evidence, long_evidence_counts, url_parts, url_admission, rejected_urls,
    strategic_links, fallback_links, excluded_pages, page_budget, unscanned_links, derived_candidates, reachable_derived,
    probe_targets, probe_pool, linked_scan, snapshot_rows, snapshot_source, all_version_facts)}

# ``links``: anchors of the pages with position, address and text.
LINKS_SQL = rf"""
anchor_tags AS (
  SELECT page_id, url, site, unnest(regexp_extract_all(markup, '(?is)<a\s[^>]*>.*?</a>')) AS a,
    generate_subscripts(regexp_extract_all(markup, '(?is)<a\s[^>]*>.*?</a>'), 1) AS i
  FROM dom
),
anchor_refs AS (
  SELECT *, {demo.ENTITIES_SQL.format("regexp_replace(regexp_extract(regexp_extract(a, '^<[^>]*>'), '(?i)[" + chr(92) + "s" + chr(34) + "''/]href" + chr(92) + "s*=" + chr(92) + "s*(" + chr(34) + "[^" + chr(34) + "]*" + chr(34) + "|''[^'']*''|[^" + chr(92) + "s" + chr(34) + "''>]+)', 1), '^[" + chr(34) + "'']|[" + chr(34) + "'']$', '', 'g')")} AS ref,
    lower(regexp_replace({demo.ENTITIES_SQL.format("regexp_replace(a, '<[^>]*>', '', 'g')")}, '^\s+|\s+$', '', 'g')) AS text
  FROM anchor_tags
),
links AS (
  SELECT page_id, url, site, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS pos,
    CASE WHEN ref LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || ref WHEN ref LIKE 'http%' THEN ref
      ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || ref END AS href
  FROM anchor_refs WHERE ref <> ''
)"""
_PATH = "regexp_extract({}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def _contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _frontier_sql() -> str:
    """``picked``: strategic links, or fallback links where a page has none, without repeats."""
    path = f"lower({_PATH.format('href')})"
    return f"""WITH {demo.PAGES_SQL},{LINKS_SQL},
same_host AS (SELECT *, {demo.HOST_SQL.format('href')} AS link_host FROM links),
flagged AS (
  SELECT page_id, site, pos, href, text,
    {_contains(path, LINKS.strategic_paths)} OR {_contains('text', LINKS.strategic_paths)} AS is_strategic,
    {_contains(f"lower(text || ' ' || {_PATH.format('href')})", LINKS.fallback_words)} AS is_fallback
  FROM same_host WHERE link_host = {demo.HOST_SQL.format('url')}
),
paged AS (SELECT *, bool_or(is_strategic) OVER (PARTITION BY page_id) AS any_strategic FROM flagged),
kept AS (
  SELECT page_id, site, min(pos) AS first_pos, href, arg_min(text, pos) AS text, any_value(CASE WHEN any_strategic THEN 'strategic' ELSE 'fallback' END) AS source
  FROM paged WHERE CASE WHEN any_strategic THEN is_strategic ELSE is_fallback END GROUP BY page_id, site, href
),
picked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS INTEGER) AS pos FROM kept
)"""


_ODD = """odd AS (SELECT page_id, CASE page_id % 10
  WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', 'http://localhost:8080') WHEN 2 THEN regexp_replace(url, '^https?://[^/]+', 'http://172.20.0.5')
  WHEN 3 THEN regexp_replace(url, '^https?:', 'ftp:') WHEN 4 THEN regexp_replace(url, '^https?://', '') WHEN 5 THEN ''
  WHEN 6 THEN regexp_replace(url, '^https?://[^/]+', 'https://172.32.0.5') ELSE url END AS url FROM pages)"""
_VERDICT = f"""CASE WHEN url = '' THEN 'empty'
  WHEN NOT regexp_matches(url, '^https?://') OR {demo.HOST_SQL.format('url')} = '' THEN 'invalid'
  WHEN {demo.HOST_SQL.format('url')} = 'localhost' OR regexp_matches({demo.HOST_SQL.format('url')}, '^(127\\.|192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') THEN 'private' END"""
_ROOTS = "roots AS (SELECT DISTINCT regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/' AS url FROM pages)"


def _derived_sql() -> str:
    from stackscan.fixed import DERIVED_PREFIXES
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(DERIVED_PREFIXES))
    return f"""{_ROOTS}, prefixes(prefix_ord, prefix) AS (VALUES {values}),
derived AS (
  SELECT url, prefix_ord, prefix, 0 AS variant, split_part(url, ':', 1) || '://' || prefix || '.' || {demo.SITE_SQL} || '/' AS candidate FROM roots, prefixes
  UNION ALL SELECT url, prefix_ord, prefix, 1, split_part(url, ':', 1) || '://' || {demo.HOST_SQL.format('url')} || '/' || prefix || '/' FROM roots, prefixes
)"""


def _responses_sql() -> str:
    from stackscan.fixed import PROBE_PATHS
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PROBE_PATHS))
    return f"""{_derived_sql()}, probes(probe_ord, path) AS (VALUES {values}),
targets AS (SELECT url, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS origin, probe_ord, path,
  regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || path AS target FROM roots, probes),
firsts AS (SELECT regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/' AS url, min(page_id) AS n FROM pages GROUP BY 1),
asked AS (
  SELECT target AS url, min(n) AS n, min(k) AS k FROM (
    SELECT candidate AS target, n, prefix_ord + variant AS k FROM derived JOIN firsts USING (url)
    UNION ALL SELECT target, n, probe_ord FROM targets JOIN firsts USING (url)) GROUP BY target
),
latest AS (SELECT url, n, k, CASE (n + k) % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 301 ELSE 500 END AS status FROM asked)"""


def oracles() -> dict[str, str]:
    base = f"WITH {demo.PAGES_SQL}"
    front = _frontier_sql()
    slug = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    host_slug = f"left(lower(regexp_replace(regexp_replace({demo.HOST_SQL.format('url')} || CASE WHEN {_PATH.format('url')} = '' THEN '/' ELSE {_PATH.format('url')} END, '[^A-Za-z0-9.]+', '-', 'g'), '^-|-$', '', 'g')), 100)"
    return {
        "page_source": f"SELECT page_id, {demo.SITE_SQL} AS site, length(html) AS chars, md5(html) AS digest FROM pages",
        "script_evidence": f"{base},{demo.SCRIPTS_SQL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS pos, src, version FROM scripts",
        "meta_evidence": f"{base},{demo.META_SQL} SELECT page_id, key, value FROM meta",
        "header_evidence": f"{base},{demo.CRAWLER_SQL} SELECT page_id, key, value FROM crawler WHERE kind = 'header'",
        "cookie_evidence": f"{base},{demo.CRAWLER_SQL} SELECT page_id, key AS name, value, site AS domain FROM crawler JOIN dp USING (page_id) WHERE kind = 'cookie'",
        "dom_strings": f"{base},{demo.STRINGS_SQL} SELECT page_id, title, body_classes, body_id, md5(head_content) AS head_digest FROM strings",
        "element_flags": f"""{base} SELECT page_id, 'bootstrapClasses=' || (n % 9 = 0) || '|drupalSettings=' || (n % 4 = 1) || '|joomlaSystem=' || (n % 4 = 2)
  || '|jqueryPresent=' || (n % 2 = 0) || '|reactRoot=' || (n % 9 = 0) || '|slateContainer=false|vueApp=false|wpContent=false' AS flags FROM dp""",
        "js_globals": f"{base} SELECT page_id, 43 AS recorded, CASE WHEN n % 9 = 0 THEN 'D2L' ELSE '' END AS present FROM dp",
        "network_hosts": f"{base},{demo.CRAWLER_SQL} SELECT page_id, string_agg(value, '|' ORDER BY ord) AS hosts FROM crawler WHERE kind = 'network' GROUP BY page_id",
        "all_version_facts": f"""WITH {demo.versioned_sql()},
{demo.SCRIPTS_SQL},{demo.META_SQL},{demo.FACTS_SQL},{demo.ALL_FACTS_SQL} SELECT page_id, key AS product, value AS version FROM all_facts""",
        "snapshot_source": """SELECT CASE page_id % 4 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Drupal' WHEN 2 THEN 'Canvas LMS' ELSE 'PHP' END AS technology, url,
  CAST(200 + page_id % 3 AS INTEGER) AS response_status, 'tests/' || CASE page_id % 4 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'drupal' WHEN 2 THEN 'canvas-lms' ELSE 'php' END
    || '/page-' || page_id || '.html' AS html_file, 's' || (page_id % 5) AS server, CAST(length(shown) AS BIGINT) AS n_chars, md5(shown) AS html_md5
FROM (SELECT *, coalesce(CASE WHEN page_id % 6 <> 5 THEN html END, '') AS shown FROM pages) WHERE page_id % 11 <> 3 AND page_id % 13 <> 5""",
        "version_facts": f"{base},{demo.SCRIPTS_SQL},{demo.META_SQL},{demo.FACTS_SQL} SELECT page_id, key AS product, value AS version FROM version_facts",
        "api_endpoints": f"""{base}, found AS (
  SELECT page_id, 0 AS part, '/api/v1/items/1' AS e FROM dp WHERE n % 4 = 1 UNION ALL SELECT page_id, 1, '/wp-json/wp/v2/x' FROM dp WHERE n % 4 = 1
  UNION ALL SELECT page_id, 2, '/rest/v2/' FROM dp WHERE n % 6 = 1
  UNION ALL SELECT page_id, 3, '/api/docs' FROM dp WHERE n % 8 = 0 UNION ALL SELECT page_id, 4, '/api/search' FROM dp WHERE n % 8 = 0)
SELECT page_id, coalesce(string_agg(e, '|' ORDER BY part), '') AS endpoints FROM dp LEFT JOIN found USING (page_id) GROUP BY page_id""",
        "link_evidence": f"{base},{LINKS_SQL} SELECT page_id, pos, href, text FROM links",
        "long_evidence_counts": f"""WITH {demo.evidence_sql()}, every AS (SELECT kind, key, value FROM ev WHERE kind NOT IN ('js')
  UNION ALL SELECT 'js', 'React', CAST(n % 7 = 0 AS VARCHAR) FROM dp UNION ALL SELECT 'js', 'jQuery', CAST(n % 2 = 0 AS VARCHAR) FROM dp
  UNION ALL SELECT 'js', 'D2L', CAST(n % 9 = 0 AS VARCHAR) FROM dp UNION ALL SELECT 'js', 'Drupal.settings', CAST(n % 4 = 1 AS VARCHAR) FROM dp)
SELECT kind, key, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM every GROUP BY kind, key""",
        "url_parts": f"""SELECT page_id, {demo.HOST_SQL.format('url')} AS host, CASE WHEN {_PATH.format('url')} = '' THEN '/' ELSE {_PATH.format('url')} END AS path,
  regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS origin, {demo.SITE_SQL} AS root_host, {host_slug} AS host_slug, {slug.format('url')} AS tech_slug FROM pages""",
        "url_admission": f"WITH {_ODD} SELECT page_id, coalesce({_VERDICT}, 'admitted') AS verdict FROM odd",
        "rejected_urls": f"WITH {_ODD} SELECT * FROM (SELECT page_id, url, {_VERDICT} AS reason FROM odd) WHERE reason IS NOT NULL",
        "strategic_links": f"{front} SELECT page_id, pos, href, text FROM picked WHERE source = 'strategic'",
        "fallback_links": f"{front} SELECT page_id, pos, href, text FROM picked WHERE source = 'fallback'",
        "excluded_pages": f"SELECT page_id, url FROM pages WHERE NOT {_contains(f'lower({_PATH.format(chr(117) + chr(114) + chr(108))})', LINKS.excluded_paths)}",
        "page_budget": f"""{front} SELECT site, slot, href, source FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS INTEGER) AS slot FROM picked) WHERE slot <= 4""",
        "unscanned_links": f"""{front} SELECT page_id, href, source FROM picked WHERE href NOT IN (
  SELECT regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/student/login?x=' || page_id FROM pages WHERE page_id % 2 = 0)""",
        "derived_candidates": f"WITH {_derived_sql()} SELECT * FROM derived",
        "reachable_derived": f"""WITH {_responses_sql()}, ok AS (SELECT d.* FROM derived d JOIN latest l ON l.url = d.candidate WHERE l.status < 400 OR l.status IN (401, 403))
SELECT url, prefix_ord, prefix, min(variant) AS variant, arg_min(candidate, variant) AS candidate FROM ok GROUP BY url, prefix_ord, prefix""",
        "probe_targets": f"WITH {_responses_sql()} SELECT * FROM targets",
        "probe_pool": f"""WITH {_responses_sql()}
SELECT t.url, string_agg('body ' || k || ' of ' || n, chr(10) ORDER BY probe_ord) AS html, 'server=s' || arg_max(k, probe_ord) AS headers,
  coalesce(string_agg(path, '|' ORDER BY probe_ord) FILTER (WHERE status = 200), '') AS api_endpoints
FROM targets t JOIN latest l ON l.url = t.target WHERE status IN (200, 301, 302) GROUP BY t.url""",
        "snapshot_rows": f"""{base} SELECT url, {slug.format("'Site ' || site")} || '/' || {host_slug} || '.html' AS html_file, n % 60 >= 30 AS target_tech_matched,
  CAST(least(64, greatest(CASE WHEN n % 3 = 0 THEN 30 * length('v' || n) ELSE 0 END, CASE WHEN n % 5 = 1 THEN 90 ELSE 0 END)) AS INTEGER) AS longest_cookie,
  CAST(least(512, 20 * length(url)) AS INTEGER) AS body_chars, 'timeout' AS status FROM dp""",
    }
