"""Schemas, signature weights and scan settings."""

from __future__ import annotations

from dataclasses import dataclass

from stackscan import fixed

# Signature kind -> (order in a detection's evidence, weight, evidence label).
KINDS = {
    "html": (0, 40, "HTML"),
    "script": (1, 60, "Script"),
    "network": (2, 70, "Network"),
    "header": (3, 80, "Header"),
    "meta": (4, 100, "Meta"),
    "dom": (5, 70, "DOM"),
    "js": (6, 80, "JS"),
    "cookie": (7, 70, "Cookie"),
}
# Signature kind -> field of a signature file.
FIELDS = {"html": "html", "script": "scripts", "network": "network", "header": "headers",
          "meta": "meta", "dom": "dom", "js": "js", "cookie": "cookies"}
# Fixed value: HTML hits listed per technology and page.
MAX_HTML_HITS = 11
# Fixed value: API endpoints kept per page.
MAX_API_ENDPOINTS = 20

SCRIPT = "struct<src:string,version:string>"
COOKIE = (
    "struct<name:string,value:string,domain:string,path:string,"
    "expires:double,secure:boolean,http_only:boolean>"
)
DOM = (
    "struct<title:string,body_classes:string,body_id:string,head_content:string>"
)

# Evidence columns of one page. A column missing from the input gives no matches of its kind.
EVIDENCE_TYPES = {
    "html": "string",
    "scripts": f"array<{SCRIPT}>",
    "network_hosts": "array<string>",
    "headers": "map<string,string>",
    "meta": "map<string,string>",
    "dom": DOM,
    "has_elements": "map<string,boolean>",
    "js_objects": "map<string,boolean>",
    "cookies": f"array<{COOKIE}>",
    "api_endpoints": "array<string>",
    "version_info": "map<string,string>",
}

TECHNOLOGY_SCHEMA = (
    "tech string, tech_ord long, file string, file_ord int, description string, "
    "categories array<string>, category_ids array<int>, listed_categories array<string>, "
    "higher_ed boolean, base_confidence int, "
    "website string, legacy_names array<string>, signal_polarity string, "
    "has_html boolean, has_scripts boolean, has_headers boolean, has_js boolean"
)
SIGNATURE_SCHEMA = (
    "tech string, tech_ord long, file string, field string, kind string, kind_ord int, ord int, "
    "key string, pattern string, weight int, label string"
)

# One technology in a signature file.
PATTERN_FILE_RECORD = (
    "struct<description:string,categories:string,cats:string,html:array<string>,"
    "scripts:array<string>,scriptSrc:array<string>,network:array<string>,"
    "headers:map<string,string>,meta:map<string,string>,cookies:map<string,string>,"
    "js:map<string,string>,dom:map<string,string>,higher_ed:boolean,confidence:int,"
    "version:string,website:string,icon:string,implies:array<string>,excludes:array<string>,"
    "signal_polarity:string,_legacy_names:array<string>>"
)

SNAPSHOT_SCHEMA = (
    "technology string, url string, final_url string, captured_at timestamp, "
    "response_status int, html_file string, "
    "evidence struct<headers:map<string,string>,"
    "scripts:array<struct<src:string,version:string>>,meta:map<string,string>,"
    "cookies:array<struct<name:string,value:string,domain:string>>,"
    "dom:struct<title:string,bodyClasses:string,bodyId:string,headContent:string,"
    "hasElements:map<string,boolean>,jsObjects:map<string,boolean>>,"
    "api_endpoints:array<string>,version_info:map<string,string>>, "
    "probe_results map<string,struct<url:string,status:string,redirect_to:string,"
    "body_excerpt:string>>, "
    "matched_patterns array<struct<name:string,confidence:int,evidence:array<string>>>, "
    "target_tech_matched boolean"
)

LEDGER_COLUMNS = (
    "technology", "file", "category", "field", "pattern", "tier", "higher_ed",
    "legacy_names", "source_evidence", "status", "notes",
)
REFERENCE_LEDGER_COLUMNS = (
    "technology", "file", "legacy_names", "vendor_website", "vendor_demo_url",
    "vendor_docs_url", "customer_url_1", "customer_url_2", "customer_url_3",
    "unverifiable_public", "priority", "notes",
)


@dataclass(frozen=True)
class ScanConfig:
    """Settings of a scan; the defaults are those of the tool's users."""

    min_confidence: int = 30
    include_evidence: bool = True
    capture_network: bool = False
    loose_version: bool = True
    max_pages: int = 5
    follow_external_links: bool = False
    strategic_paths: tuple[str, ...] = fixed.STRATEGIC_PATHS
    fallback_words: tuple[str, ...] = fixed.FALLBACK_WORDS
    excluded_paths: tuple[str, ...] = fixed.EXCLUDED_PATHS
    derived_prefixes: tuple[str, ...] = fixed.DERIVED_PREFIXES
    probe_paths: tuple[str, ...] = fixed.PROBE_PATHS
