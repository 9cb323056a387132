"""Inputs of the registered queries: the test tables seen as crawled pages and scan stores.

The ``pages`` table holds plain articles. To give every kind of evidence something to find, a
formula over ``page_id`` and ``url`` adds tags to each page and the columns a crawler records.
Every row of the table is used. The same formulas are stated once more in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.functions.columns import union_all
from stackscan.model import KINDS, ScanConfig, TECHNOLOGY_SCHEMA
from stackscan.operators.evidence import extract_evidence
from stackscan.sources.signatures import Library, compile_library, signature_rows, with_weights

CONFIG = ScanConfig(capture_network=True)

# (technology, categories, higher education, description)
TECHNOLOGIES = [
    ("WordPress", ["CMS"], False, "Publishing platform"),
    ("Drupal", ["1"], False, "Content framework"),
    ("Joomla", ["cms"], False, "Site builder"),
    ("React", ["9"], False, "Interface library"),
    ("jQuery", ["JavaScript"], False, ""),
    ("Apache", ["6"], False, "Web server"),
    ("nginx", ["Web Server"], False, "Web server"),
    ("Cloudflare", ["7", "CDN"], False, "Delivery network"),
    ("PHP", ["8"], False, "Language"),
    ("Canvas LMS", ["LMS"], True, "Learning management for students"),
    ("D2L Brightspace", ["5"], True, "Learning management"),
    ("Campus SIS", ["53"], True, "Student information system"),
    ("Admission CRM", ["54"], True, "Admissions"),
    ("Google Analytics", ["Analytics"], False, "Usage statistics"),
    ("Site Search", ["999"], False, "Hosted search"),
    ("Bootstrap", None, False, "Front-end kit"),
    ("Markup", None, False, ""),
]
# (technology, kind, key, pattern)
SIGNATURES = [
    ("WordPress", "html", None, r"/wp-json/wp"),
    ("WordPress", "html", None, r"track\([0-9]*7\)"),
    ("WordPress", "meta", "generator", r"^WordPress"),
    ("Drupal", "meta", "generator", r"drupal \d+$"),
    ("Drupal", "js", "Drupal.settings", ""),
    ("Joomla", "meta", "generator", r"Joomla!"),
    ("React", "js", "React", ""),
    ("React", "html", None, r"<!-- ad [0-9]*3 -->"),
    ("jQuery", "js", "jQuery", ""),
    ("jQuery", "script", None, r"/lib[0-2]\.js"),
    ("Apache", "header", "Server", r"Apache(?:/([\d.]+))?\;version:\1"),
    ("nginx", "header", "Server", "nginx"),
    ("Cloudflare", "header", "Server", "^cloudflare$"),
    ("PHP", "header", "X-Powered-By", ""),
    ("PHP", "cookie", "PHPSESSID", ""),
    ("Canvas LMS", "cookie", "canvas_session", "^ok[01]$"),
    ("Canvas LMS", "meta", "canvas-environment", ""),
    ("D2L Brightspace", "js", "D2L", ""),
    ("Campus SIS", "html", None, r"/student/(?:login|portal)"),
    ("Campus SIS", "dom", "title", r"\bthe\b"),
    ("Admission CRM", "html", None, "casino|free-bets"),
    ("Admission CRM", "dom", "bodyClasses", r"page-2"),
    ("Google Analytics", "network", None, r"google-analytics\."),
    ("Google Analytics", "html", None, r'<html lang="de"'),
    ("Site Search", "network", None, "swiftype"),
    ("Bootstrap", "script", None, r"bootstrap(?:\.min)?\.js"),
    ("Bootstrap", "dom", "headContent", r"bootstrap/4\.[0-2]"),
    *[("Markup", "html", None, tag) for tag in (
        "<p>", "<a ", "<b>", "<h1", "<li>", "<ul>", "<nav", "<div", "<article", "<footer", "<title", "<style", "</ul>")],
    ("Markup", "html", None, "(unclosed"),
]


def technology_frame(spark: SparkSession) -> DataFrame:
    rows = [(t, i, "custom.json", 0, d, c, None, c, h, None, None, None, None, True, False, False, False)
            for i, (t, c, h, d) in enumerate(TECHNOLOGIES)]
    return spark.createDataFrame(rows, TECHNOLOGY_SCHEMA)


def signature_frame(spark: SparkSession) -> DataFrame:
    return signature_rows(spark, SIGNATURES)[1]


def library(spark: SparkSession) -> Library:
    return compile_library(technology_frame(spark), signature_frame(spark))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def decorate(pages: DataFrame) -> DataFrame:
    """Add the formula's tags and crawler columns to the pages."""
    n = F.col("page_id")
    s = n.cast("string")
    mod = lambda k: (n % k).cast("string")
    none = F.lit("")
    site = urls.root_host(F.col("url"))
    generator = (F.when(n % 4 == 0, _text("WordPress 6.", mod(9))).when(n % 4 == 1, _text("Drupal 10"))
                 .when(n % 4 == 2, _text("Joomla! 4.", mod(5), ".1")).otherwise(none))
    head = _text(
        _text('<script src="/assets/lib', mod(5), ".js?ver=", mod(3), ".", mod(10), '"></script>'),
        F.when(n % 7 == 0, _text("<script src='https://cdn.example.net/bootstrap/4.", mod(6), ".1/bootstrap.min.js'></script>")).otherwise(none),
        F.when(n % 6 == 1, _text('<script async src=//api.example.net/rest/v2/x.js?ver=', s, "></script>")).otherwise(none),
        _text('<meta name="Generator" content="', generator, '">'),
        _text('<meta content="', site, '" property="og:site_name">'),
        F.when(n % 11 == 0, _text("<meta name='canvas-environment' content='2024-0", mod(9), "'>")).otherwise(none),
    )
    body = _text(
        _text('<body class="home page-', mod(4), '" id="b', mod(2), '">'),
        F.when(n % 3 == 0, _text('<a href="/student/login?x=', s, '"> Student <b>Login</b>\n</a>')).otherwise(none),
        F.when(n % 2 == 0, _text("<a class=x href='https://other.example.org/library'>Library</a>")).otherwise(none),
        F.when(n % 5 == 0, _text('<a href="courses/list">Courses &amp; More</a><a href="courses/list">Again</a>')).otherwise(none),
        F.when(n % 4 == 1, _text('<script>fetch("/api/v1/items/', mod(4), "\");go('/wp-json/wp/v2/x')</script>")).otherwise(none),
        F.when(n % 8 == 0, _text('<form action="/api/search"></form><a href="/api/docs">API</a>')).otherwise(none),
        F.when(n % 9 == 0, _text('<div class="col-1 btn-x" id="root"></div>')).otherwise(none),
        F.when(n % 10 == 0, _text('<!-- <a href="/login">hidden</a> -->')).otherwise(none),
    )
    html = F.replace(F.replace("html", F.lit("</head>"), _text(head, "</head>")), F.lit("<body>"), body)
    server = F.when(n % 4 == 0, "Apache/2.4.5").when(n % 4 == 1, "nginx").when(n % 4 == 2, "cloudflare").otherwise("")
    headers = F.when(n % 5 == 0, F.create_map(F.lit("Server"), server, F.lit("X-Powered-By"), F.lit("PHP/8"))).otherwise(
        F.create_map(F.lit("Server"), server))
    cookie = lambda name, value: F.struct(
        F.lit(name).alias("name"), value.alias("value"), site.alias("domain"), F.lit("/").alias("path"),
        F.lit(-1.0).alias("expires"), F.lit(False).alias("secure"), F.lit(True).alias("http_only"))
    cookies = F.array_compact(F.array(
        F.when(n % 3 == 0, cookie("PHPSESSID", _text("v", s))),
        F.when(n % 5 == 1, cookie("canvas_session", _text("ok", mod(3))))))
    return pages.withColumns({
        "site": site, "page_ord": n, "html": html, "headers": headers, "cookies": cookies,
        "js_objects": F.create_map(F.lit("React"), n % 7 == 0, F.lit("jQuery"), n % 2 == 0, F.lit("D2L"), n % 9 == 0,
                                   F.lit("Drupal.settings"), n % 4 == 1),
        "version_hints": F.when(n % 2 == 0, F.create_map(F.lit("jquery"), _text("3.", mod(8)))),
        "request_urls": F.array(
            F.when(n % 3 == 1, "https://api.swiftype.example.com/x"),
            F.when(n % 4 == 2, "https://www.google-analytics.example.com/g?id=1"), F.lit("not a url"), F.col("url")),
    })


#: Text that states versions: (condition, piece before the number, number), written so that Spark and the oracle read the same.
VERSIONED = [
    ("page_id % 5 = 0", '<script src="/lib/1.5/drupal.js?', "'7.' || (page_id % 9)"),
    ("page_id % 6 = 0", '<script src="/WP-includes/js/wp-embed.min.js?ver=', "'5.' || (page_id % 8) || '.2'"),
    ("page_id % 10 = 3", '<script src="/media/Joomla.js?', "'3.' || (page_id % 7)"),
    ("page_id % 7 = 2", '<script src="/moodle/lib/javascript.js?', "'4.' || (page_id % 6)"),
    ("page_id % 7 = 4", '<script src="/moodle/lib/javascript.js?', "'rev' || page_id"),
]
VERSIONED_HTML = "html || " + " || ".join(
    f"CASE WHEN {when} THEN '{before}' || {number} || '\"></script>' ELSE '' END" for when, before, number in VERSIONED)


def versioned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with text that states versions, and a global that only some of them set."""
    pages = demo_pages(spark, sf).withColumn("html", F.expr(VERSIONED_HTML))
    return pages.withColumn("js_objects", F.map_concat("js_objects", F.create_map(F.lit("webpackChunkcanvas_lms"), F.col("page_id") % 2 == 1)))


def demo_pages(spark: SparkSession, sf: str) -> DataFrame:
    return decorate(raw_pages(spark, sf))


def demo_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the demo pages."""
    return extract_evidence(demo_pages(spark, sf), CONFIG)


# ---- the same in SQL ----

def _quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def library_sql() -> str:
    """The valid demo signatures as a VALUES list ``lib``."""
    order: dict[str, int] = {}
    counts: dict[tuple, int] = {}
    rows = []
    for tech, kind, key, pattern in SIGNATURES:
        order.setdefault(tech, len(order))
        ordinal = counts.get((tech, kind), 0)
        counts[tech, kind] = ordinal + 1
        if pattern == "(unclosed":
            continue
        kind_ord, weight, label = KINDS[kind]
        text = pattern if key is None else (f"{key}={pattern}" if kind in ("header", "meta", "dom") else key)
        plain = pattern.split(r"\;version:")[0]
        lookup = key.lower() if kind in ("header", "meta") else key
        rows.append(f"({_quote(tech)},{order[tech]},{_quote(kind)},{kind_ord},{ordinal},{_quote(lookup)},"
                    f"{_quote(plain)},{weight},{_quote(f'{label}: {text}')})")
    return ("lib(tech, tech_ord, kind, kind_ord, ord, key, pattern, weight, label) AS (VALUES\n  "
            + ",\n  ".join(rows) + ")")


def technologies_sql() -> str:
    """Demo technologies with their category names as ``techs``."""
    from stackscan.fixed import CATEGORY_NAMES
    rows = []
    for i, (tech, cats, higher, text) in enumerate(TECHNOLOGIES):
        names = ["Unknown"] if cats is None else [
            CATEGORY_NAMES.get(int(c), "Unknown") if c.isdigit() else c.lower() for c in cats]
        listed = "[" + ",".join(map(_quote, names)) + "]"
        rows.append(f"({_quote(tech)},{i},{listed},{str(higher).lower()},{_quote(text)})")
    return "techs(tech, tech_ord, categories, is_higher_ed, description) AS (VALUES\n  " + ",\n  ".join(rows) + ")"


HOST_SQL = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SITE_SQL = "regexp_replace(" + HOST_SQL.format("url") + r", '^www\.', '')"
# ``dp``: decorated pages.
PAGES_SQL = rf"""
dp AS (
  SELECT page_id, page_id AS n, url, {SITE_SQL} AS site,
    replace(replace(html, '</head>',
      '<script src="/assets/lib' || (page_id % 5) || '.js?ver=' || (page_id % 3) || '.' || (page_id % 10) || '"></script>'
      || CASE WHEN page_id % 7 = 0 THEN '<script src=''https://cdn.example.net/bootstrap/4.' || (page_id % 6) || '.1/bootstrap.min.js''></script>' ELSE '' END
      || CASE WHEN page_id % 6 = 1 THEN '<script async src=//api.example.net/rest/v2/x.js?ver=' || page_id || '></script>' ELSE '' END
      || '<meta name="Generator" content="' || CASE page_id % 4 WHEN 0 THEN 'WordPress 6.' || (page_id % 9) WHEN 1 THEN 'Drupal 10'
           WHEN 2 THEN 'Joomla! 4.' || (page_id % 5) || '.1' ELSE '' END || '">'
      || '<meta content="' || {SITE_SQL} || '" property="og:site_name">'
      || CASE WHEN page_id % 11 = 0 THEN '<meta name=''canvas-environment'' content=''2024-0' || (page_id % 9) || '''>' ELSE '' END
      || '</head>'),
    '<body>',
      '<body class="home page-' || (page_id % 4) || '" id="b' || (page_id % 2) || '">'
      || CASE WHEN page_id % 3 = 0 THEN '<a href="/student/login?x=' || page_id || '"> Student <b>Login</b>' || chr(10) || '</a>' ELSE '' END
      || CASE WHEN page_id % 2 = 0 THEN '<a class=x href=''https://other.example.org/library''>Library</a>' ELSE '' END
      || CASE WHEN page_id % 5 = 0 THEN '<a href="courses/list">Courses &amp; More</a><a href="courses/list">Again</a>' ELSE '' END
      || CASE WHEN page_id % 4 = 1 THEN '<script>fetch("/api/v1/items/' || (page_id % 4) || '");go(''/wp-json/wp/v2/x'')</script>' ELSE '' END
      || CASE WHEN page_id % 8 = 0 THEN '<form action="/api/search"></form><a href="/api/docs">API</a>' ELSE '' END
      || CASE WHEN page_id % 9 = 0 THEN '<div class="col-1 btn-x" id="root"></div>' ELSE '' END
      || CASE WHEN page_id % 10 = 0 THEN '<!-- <a href="/login">hidden</a> -->' ELSE '' END) AS html
  FROM pages
),
dom AS (
  SELECT *, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)(<script\b[^>]*>).*?</script>', '\1</script>', 'g') AS markup
  FROM dp
)"""

# ``scripts``: external scripts in document order.
SCRIPTS_SQL = r"""
script_tags AS (
  SELECT page_id, n, url, unnest(regexp_extract_all(markup, '(?i)<script\b[^>]*>')) AS tag,
    generate_subscripts(regexp_extract_all(markup, '(?i)<script\b[^>]*>'), 1) AS pos
  FROM dom
),
script_refs AS (
  SELECT page_id, pos, url, regexp_replace(regexp_extract(tag,
    '(?i)[\s"''/]src\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS ref
  FROM script_tags
),
scripts AS (
  SELECT page_id, pos, src, nullif(regexp_extract(src, '[?&]ver=([^&]+)', 1), '') AS version
  FROM (SELECT page_id, pos, CASE WHEN ref LIKE '//%' THEN split_part(url, ':', 1) || ':' || ref
      WHEN ref LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || ref ELSE ref END AS src
    FROM script_refs WHERE ref <> '')
)"""

# ``metas``: named meta tags; ``meta``: the last of every name.
META_SQL = r"""
meta_tags AS (
  SELECT page_id, unnest(regexp_extract_all(markup, '(?i)<meta\b[^>]*>')) AS tag,
    generate_subscripts(regexp_extract_all(markup, '(?i)<meta\b[^>]*>'), 1) AS pos
  FROM dom
),
meta_values AS (
  SELECT page_id, pos,
    regexp_replace(regexp_extract(tag, '(?i)[\s"''/]name\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS name,
    regexp_replace(regexp_extract(tag, '(?i)[\s"''/]property\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS prop,
    regexp_replace(regexp_extract(tag, '(?i)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS content
  FROM meta_tags
),
metas AS (
  SELECT page_id, pos, lower(CASE WHEN name <> '' THEN name ELSE prop END) AS key, content AS value
  FROM meta_values WHERE (name <> '' OR prop <> '') AND content <> ''
),
meta AS (SELECT page_id, key, arg_max(value, pos) AS value FROM metas GROUP BY page_id, key)"""

ENTITIES_SQL = ("replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
                "'&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")

# ``strings``: DOM strings; ``crawler``: headers, cookies, globals, request hosts as rows.
STRINGS_SQL = rf"""
strings AS (
  SELECT page_id,
    trim(regexp_replace({ENTITIES_SQL.format("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title,
    regexp_extract(regexp_extract(markup, '(?i)<body(?:\s[^>]*)?>'), 'class="([^"]*)"', 1) AS body_classes,
    regexp_extract(regexp_extract(markup, '(?i)<body(?:\s[^>]*)?>'), 'id="([^"]*)"', 1) AS body_id,
    regexp_extract(html, '(?is)<head(?:\s[^>]*)?>(.*?)</head>', 1) AS head_content
  FROM dom
)"""
CRAWLER_SQL = rf"""
crawler AS (
  SELECT page_id, 'header' AS kind, 'server' AS key, CASE n % 4 WHEN 0 THEN 'Apache/2.4.5' WHEN 1 THEN 'nginx' WHEN 2 THEN 'cloudflare' ELSE '' END AS value, 0 AS ord FROM dp
  UNION ALL SELECT page_id, 'header', 'x-powered-by', 'PHP/8', 1 FROM dp WHERE n % 5 = 0
  UNION ALL SELECT page_id, 'cookie', 'PHPSESSID', 'v' || n, 0 FROM dp WHERE n % 3 = 0
  UNION ALL SELECT page_id, 'cookie', 'canvas_session', 'ok' || (n % 3), 1 FROM dp WHERE n % 5 = 1
  UNION ALL SELECT page_id, 'js', 'React', 'true', 0 FROM dp WHERE n % 7 = 0
  UNION ALL SELECT page_id, 'js', 'jQuery', 'true', 1 FROM dp WHERE n % 2 = 0
  UNION ALL SELECT page_id, 'js', 'D2L', 'true', 2 FROM dp WHERE n % 9 = 0
  UNION ALL SELECT page_id, 'js', 'Drupal.settings', 'true', 3 FROM dp WHERE n % 4 = 1
  UNION ALL SELECT page_id, 'network', NULL, 'api.swiftype.example.com', 0 FROM dp WHERE n % 3 = 1
  UNION ALL SELECT page_id, 'network', NULL, 'www.google-analytics.example.com', 1 FROM dp WHERE n % 4 = 2
  UNION ALL SELECT page_id, 'network', NULL, {HOST_SQL.format("url")}, 2 FROM dp
)"""
EVIDENCE_SQL = r"""
ev AS (
  SELECT page_id, 'html' AS kind, NULL AS key, html AS value FROM dp
  UNION ALL SELECT page_id, 'script', NULL, src FROM scripts
  UNION ALL SELECT page_id, 'meta', key, value FROM meta
  UNION ALL SELECT page_id, 'dom', 'title', title FROM strings
  UNION ALL SELECT page_id, 'dom', 'bodyClasses', body_classes FROM strings
  UNION ALL SELECT page_id, 'dom', 'bodyId', body_id FROM strings
  UNION ALL SELECT page_id, 'dom', 'headContent', head_content FROM strings
  UNION ALL SELECT page_id, kind, key, value FROM crawler
)"""
# Version facts in the order they are looked up.
FACTS_SQL = r"""
gen AS (SELECT page_id, pos, value FROM metas WHERE key = 'generator'),
facts AS (
  SELECT page_id, 0 AS ord, 'wordpress' AS key, regexp_extract(arg_min(value, pos), 'WordPress (\d+\.\d+(?:\.\d+)?)', 1) AS value
    FROM gen WHERE contains(value, 'WordPress') GROUP BY page_id
  UNION ALL SELECT page_id, 2, 'joomla', regexp_extract(arg_min(value, pos), 'Joomla! (\d+\.\d+(?:\.\d+)?)', 1)
    FROM gen WHERE contains(value, 'Joomla') GROUP BY page_id
  UNION ALL SELECT page_id, 4, 'jquery', '3.' || (n % 8) FROM dp WHERE n % 2 = 0
  UNION ALL SELECT page_id, 5, 'bootstrap', regexp_extract(arg_min(src, pos), '(?i)bootstrap/(\d+\.\d+(?:\.\d+)?)', 1)
    FROM scripts WHERE contains(src, 'bootstrap') GROUP BY page_id
),
version_facts AS (SELECT * FROM facts WHERE value <> '')"""


# All version facts of ``versioned_pages``: what the page shows first, then what its text states.
ALL_FACTS_SQL = r"""
shown AS (
  SELECT page_id, key, value FROM version_facts
  UNION ALL SELECT page_id, 'drupal', regexp_extract(arg_min(src, pos), '(\d+\.\d+)', 1) FROM scripts WHERE contains(src, 'drupal.js') AND page_id % 4 = 1 GROUP BY page_id
  UNION ALL SELECT page_id, 'canvas', arg_min(value, pos) FROM metas WHERE key = 'canvas-environment' AND page_id % 2 = 1 GROUP BY page_id
),
stated AS (
  SELECT page_id, 'wordpress' AS key, regexp_extract(html, '(?i)wp-includes/js/wp-embed\.min\.js\?ver=(\d+\.\d+(?:\.\d+)?)', 1) AS value FROM dp
  UNION ALL SELECT page_id, 'drupal', regexp_extract(html, '(?i)drupal\.js\?(\d+\.\d+)', 1) FROM dp
  UNION ALL SELECT page_id, 'joomla', regexp_extract(html, '(?i)joomla\.js\?(\d+\.\d+)', 1) FROM dp
  UNION ALL SELECT page_id, 'moodle', regexp_extract(html, '(?i)moodle/lib/javascript\.js\?(\d+\.\d+)', 1) FROM dp
),
all_facts AS (SELECT * FROM shown UNION ALL SELECT * FROM stated ANTI JOIN shown USING (page_id, key) WHERE value <> '')"""


# A library of real size, two signatures per part: (condition, kind, key, pattern), written so that
# Spark and the oracle read the same text. Some hit most pages, most hit none.
LARGE = [
    ("n % 8 = 0", "html", None, "'href=\"[^\"]*' || (n % 500) || '\"'"),
    ("n % 8 = 1", "script", None, "'lib' || (n % 5) || '[.]js[?]ver=' || (n % 30)"),
    ("n % 8 = 2", "network", None, "CASE WHEN n % 3 = 0 THEN 'swiftype' ELSE 'vendor' || n END"),
    ("n % 8 = 3", "header", "'server'", "CASE WHEN n % 5 = 0 THEN 'nginx' ELSE 'srv' || n END"),
    ("n % 8 = 4", "meta", "'generator'", "'WordPress 6[.]' || (n % 90)"),
    ("n % 8 = 5", "dom", "'bodyClasses'", "'page-' || (n % 40) || '$'"),
    ("n % 8 = 6", "js", "CASE WHEN n % 3 = 0 THEN 'React' ELSE 'g' || n END", "''"),
    ("n % 8 = 7", "cookie", "'PHPSESSID'", "'^v' || (n % 100) || '$'"),
    ("true", "html", None, "'track[(]' || n || '[)]'"),
]


def large_library(spark: SparkSession, sf: str) -> Library:
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("n"))
    rows = []
    for i, (condition, kind, key, pattern) in enumerate(LARGE):
        rows.append(parts.filter(condition).selectExpr(
            "'L' || (n % 97) AS tech", "n % 97 AS tech_ord", "'large.json' AS file", f"'{kind}' AS field", f"'{kind}' AS kind",
            f"CAST(n * 10 + {i} AS INT) AS ord", f"{key or 'CAST(NULL AS STRING)'} AS key", f"{pattern} AS pattern",
            f"'{KINDS[kind][2]}: ' || n || '/{i}' AS label"))
    none = lambda kind: f"CAST(NULL AS {kind})"
    techs = parts.selectExpr("'L' || (n % 97) AS tech").distinct().selectExpr(
        "tech", f"{none('array<string>')} AS categories", "false AS higher_ed", "'' AS description")
    return compile_library(techs, with_weights(union_all(rows)))


def large_matches_sql() -> str:
    """``matches``: matching signatures of the large library per page."""
    rows = "\n  UNION ALL ".join(
        f"SELECT 'L' || (n % 97) AS tech, n % 97 AS tech_ord, '{kind}' AS kind, {KINDS[kind][0]} AS kind_ord, n * 10 + {i} AS ord, "
        f"{key or 'CAST(NULL AS VARCHAR)'} AS key, {pattern} AS pattern, {KINDS[kind][1]} AS weight, '{KINDS[kind][2]}: ' || n || '/{i}' AS label "
        f"FROM (SELECT p_partkey AS n FROM part) WHERE {condition}" for i, (condition, kind, key, pattern) in enumerate(LARGE))
    return f"lib AS ({rows}),{evidence_sql()},{_MATCHES_SQL}"


def versioned_sql() -> str:
    """``PAGES_SQL`` over ``versioned_pages``."""
    return PAGES_SQL.replace("dp AS (", "plain AS (", 1).replace(
        "dom AS (", f"dp AS (SELECT * REPLACE ({VERSIONED_HTML} AS html) FROM plain),\ndom AS (", 1)


def evidence_sql() -> str:
    return ",".join([PAGES_SQL, SCRIPTS_SQL, META_SQL, STRINGS_SQL, CRAWLER_SQL, EVIDENCE_SQL])


_MATCHES_SQL = """
matches AS (
  SELECT DISTINCT ev.page_id, lib.tech, lib.tech_ord, lib.kind, lib.kind_ord, lib.ord, lib.key, lib.weight, lib.label
  FROM lib JOIN ev ON ev.kind = lib.kind AND (lib.key IS NULL OR lib.key = ev.key)
  WHERE lib.kind = 'js' OR (ev.value <> '' AND regexp_matches(ev.value, lib.pattern, 'i'))
)"""


def matches_sql() -> str:
    """``matches``: matching signatures per page."""
    return f"{library_sql()},{evidence_sql()},{_MATCHES_SQL}"


def detections_sql() -> str:
    """``det``: scored detections per page with rank, evidence and version."""
    return f"""{matches_sql()},{technologies_sql()},{FACTS_SQL},
listed AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, tech, kind ORDER BY ord) AS hit FROM matches
),
scored AS (
  SELECT page_id, tech, tech_ord, CAST(least(sum(weight), 100) AS INTEGER) AS confidence,
    list(label ORDER BY kind_ord, ord) FILTER (WHERE kind <> 'html' OR hit <= 11) AS evidence
  FROM listed GROUP BY page_id, tech, tech_ord
),
asset AS (SELECT page_id, arg_min(version, pos) AS version FROM scripts WHERE version IS NOT NULL GROUP BY page_id),
fact AS (
  SELECT s.page_id, s.tech, arg_min(f.value, f.ord) AS version
  FROM scored s JOIN version_facts f ON f.page_id = s.page_id
   AND (contains(lower(s.tech), f.key) OR contains(f.key, lower(s.tech))) GROUP BY s.page_id, s.tech
),
det AS (
  SELECT dp.site, dp.url, s.page_id, s.tech, s.tech_ord, s.confidence, s.evidence, t.categories, t.is_higher_ed, t.description,
    coalesce(fact.version, asset.version) AS version,
    CAST(row_number() OVER (PARTITION BY s.page_id ORDER BY s.confidence DESC, s.tech_ord) AS INTEGER) AS rank
  FROM scored s JOIN dp USING (page_id) JOIN techs t ON t.tech = s.tech
  LEFT JOIN fact ON fact.page_id = s.page_id AND fact.tech = s.tech LEFT JOIN asset ON asset.page_id = s.page_id
  WHERE s.confidence >= 30
)"""


def merged_sql() -> str:
    """``merged``: site technologies."""
    return f"""{detections_sql()},
labels AS (
  SELECT site, tech, label, min((page_id, rank, i)) AS place FROM (
    SELECT site, tech, page_id, rank, unnest(evidence) AS label, generate_subscripts(evidence, 1) AS i FROM det)
  GROUP BY site, tech, label
),
site_labels AS (SELECT site, tech, list(label ORDER BY place) AS evidence FROM labels GROUP BY site, tech),
site_techs AS (
  SELECT site, tech, any_value(tech_ord) AS tech_ord, max(confidence) AS confidence, any_value(categories) AS categories,
    arg_min(version, (page_id, rank)) FILTER (WHERE version IS NOT NULL) AS version, any_value(is_higher_ed) AS is_higher_ed,
    any_value(description) AS description, min((page_id, rank)) AS first_at, count(*) AS pages
  FROM det GROUP BY site, tech
),
merged AS (
  SELECT t.*, l.evidence, CAST(row_number() OVER (PARTITION BY t.site ORDER BY t.confidence DESC, t.first_at) AS INTEGER) AS rank
  FROM site_techs t JOIN site_labels l ON l.site = t.site AND l.tech = t.tech
)"""
