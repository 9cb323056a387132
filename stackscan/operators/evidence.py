"""Evidence extraction from a table of pages.

Input: a row per page with ``url`` and ``html`` and, where the crawler recorded them,
``headers``, ``cookies``, ``js_objects``, ``version_hints`` and ``request_urls``. What only a
live page shows (globals, cookies, headers, requests) is never guessed from the HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscan.fixed import JS_GLOBALS
from stackscan.functions import urls
from stackscan.functions.columns import bind, first_group, holds_any, last_per_key, unquote
from stackscan.model import COOKIE, MAX_API_ENDPOINTS, ScanConfig

# Attributes of a start tag up to its end: a quoted value may hold ``>``; a stray quote is taken as it is.
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">]+|['"])*+"""
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

# Quoted API paths in inline scripts, API links and forms in the HTML.
SCRIPT_API_PATTERNS = tuple(
    f"""(?:"({p}[^'"]*)"|'({p}[^'"]*)')""" for p in (
        r"/api/v\d+", "/wp-json/", "/learn/api/", "/d2l/api/", "/canvas/api/", "/rest/"))
HTML_API_PATTERNS = (
    r"""(?i)href=['"](/api/[^'"]*)['"]""",
    r"""(?i)href=['"](/wp-json/[^'"]*)['"]""",
    r"""(?i)action=['"](/api/[^'"]*)['"]""",
)
# Version facts read from the HTML text after a file name.
HTML_VERSION_PATTERNS = {
    "wordpress": ("wp-includes/js/wp-embed.min.js?ver=", r"(\d+\.\d+(?:\.\d+)?)"),
    "drupal": ("drupal.js?", r"(\d+\.\d+)"),
    "joomla": ("joomla.js?", r"(\d+\.\d+)"),
    "moodle": ("moodle/lib/javascript.js?", r"(\d+\.\d+)"),
}
PAGE_INPUTS = {
    "headers": "map<string,string>", "cookies": f"array<{COOKIE}>",
    "js_objects": "map<string,boolean>", "version_hints": "map<string,string>",
    "request_urls": "array<string>",
}


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# Named character references that are decoded besides the numeric ones.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
          "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
          "agrave": "à", "aacute": "á", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é", "iacute": "í", "ntilde": "ñ",
          "oacute": "ó", "ouml": "ö", "uacute": "ú", "uuml": "ü", "szlig": "ß", "euro": "€"}


def _entities(text: Column) -> Column:
    """Decode character references: numeric ones, and the usual named ones. Each is decoded once."""

    def numeric(out: Column, reference: Column) -> Column:
        digits = F.regexp_replace(reference, "[&#;]", "")
        hexadecimal = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.substring(digits, 2, 8)).otherwise(
            F.conv(digits, 10, 16))
        known = reference.rlike("(?i)^&#(?:x0*[1-9a-f][0-9a-f]{0,4}|0*[1-9][0-9]{0,5});$") & ~reference.rlike(_AMPERSAND)
        letter = F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")
        return F.when(known, F.replace(out, reference, letter)).otherwise(out)

    def decode(value: Column) -> Column:
        references = F.array_distinct(_all(value, "(?i)&#(?:x[0-9a-f]+|[0-9]+);"))
        out = F.when(F.contains(value, F.lit("&#")), F.aggregate(references, value, numeric)).otherwise(value)
        for name, char in _NAMED.items():
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
        out = F.regexp_replace(out, _AMPERSAND, "&")
        return F.when(F.contains(value, F.lit("&")), out).otherwise(value)
    return bind(text, decode)


_AMPERSAND = "&(?:amp|#0*38|#[xX]0*26);"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one start tag; empty when absent."""
    return _entities(unquote(F.regexp_extract(tag, rf"(?i)[\s\"'/]{name}{_VALUE}", 1)))


def without_comments(html: Column) -> Column:
    return F.when(holds_any(html, "<!--"), F.regexp_replace(html, r"(?s)<!--.*?-->", "")).otherwise(html)


def markup(html: Column) -> Column:
    """HTML without comments and script bodies: what a DOM query would see."""
    return F.regexp_replace(without_comments(html), rf"(?is)(<script\b{_ATTRS}>).*?</script>", "$1</script>")


def head_tokens(html: Column) -> Column:
    """Scripts with their bodies, meta, base, title and body tags in document order, in one read of
    the HTML. Comments and script bodies are taken as a whole, so tags inside them do not count."""
    pattern = (rf"(?is)<(?:!--.*?(?:-->|\z)|script\b{_ATTRS}>.*?(?:</script>|\z)|(?:meta|base)\b{_ATTRS}>"
               rf"|title\b{_ATTRS}>.*?</title>|body(?:\s{_ATTRS})?>)")
    return F.filter(_all(html, pattern), lambda t: ~F.startswith(t, F.lit("<!")))


def _tokens(tokens: Column, tag: str) -> Column:
    return F.filter(tokens, lambda t: F.startswith(F.lower(F.substring(t, 1, len(tag) + 1)), F.lit(f"<{tag}")))


def _start_tag(token: Column) -> Column:
    return F.regexp_extract(token, rf"^<{_ATTRS}>", 0)


def base_url(tokens: Column, url: Column) -> Column:
    """What the page's links are relative to: its first ``<base href>``, else its own address."""
    href = attribute(F.coalesce(F.get(_tokens(tokens, "base"), F.lit(0)), F.lit("")), "href")
    return F.when(href != "", bind(urls.base_parts(url), lambda own: urls.resolve(own, href))).otherwise(url)


def script_sources(tokens: Column, url: Column) -> Column:
    """External scripts with the version in their query string (E2); ``url`` is the base."""
    sources = F.filter(F.transform(_tokens(tokens, "script"), lambda t: attribute(_start_tag(t), "src")),
                       lambda s: s != "")
    absolute = bind(urls.base_parts(url), lambda base: F.transform(sources, lambda s: urls.resolve(base, s)))
    return F.transform(absolute, lambda s: F.struct(
        s.alias("src"), first_group(s, r"[?&]ver=([^&]+)").alias("version")))


def meta_entries(tokens: Column) -> Column:
    """(key, value) of every named meta tag in document order."""

    def entry(tag: Column) -> Column:
        parts = F.struct(attribute(tag, "name").alias("name"), attribute(tag, "property").alias("property"),
                         attribute(tag, "content").alias("value"))
        return bind(parts, lambda p: F.struct(
            F.lower(F.when(p["name"] != "", p["name"]).otherwise(p["property"])).alias("key"), p["value"].alias("value")))
    return F.filter(F.transform(_tokens(tokens, "meta"), entry), lambda e: (e["key"] != "") & (e["value"] != ""))


def dom_strings(tokens: Column, html: Column) -> Column:
    """Title, body class and id, head content (E5)."""
    body = F.coalesce(F.get(_tokens(tokens, "body"), F.lit(0)), F.lit(""))
    title = F.coalesce(F.get(_tokens(tokens, "title"), F.lit(0)), F.lit(""))
    text = F.regexp_replace(title, r"(?is)^<title[^>]*>|</title>$", "")
    return F.struct(
        F.trim(F.regexp_replace(_entities(text), r"\s+", " ")).alias("title"),
        attribute(body, "class").alias("body_classes"),
        attribute(body, "id").alias("body_id"),
        F.regexp_extract(html, r"(?is)<head(?:\s[^>]*)?>(.*?)</head>", 1).alias("head_content"),
    )


def element_flags(html: Column, low: Column, js_objects: Column, metas: Column) -> Column:
    """Presence of eight element groups (E6); two of them are run-time globals. ``low`` is the
    lower-cased HTML. The tags are searched only where the word occurs at all."""
    def class_holds(dom: Column, *words: str) -> Column:
        word = "(?:" + "|".join(words) + ")"
        return holds_any(html, *words) & dom.rlike(
            rf"""<[A-Za-z][^>]*\s(?i:class)\s*=\s*(?:"[^"]*{word}|'[^']*{word}|[^\s"'>]*{word})""")

    def global_set(name: str) -> Column:
        return F.coalesce(F.try_element_at(js_objects, F.lit(name)), F.lit(False))

    def flags(dom: Column) -> Column:
        found = {
            "drupalSettings": global_set("Drupal.settings"),
            "wpContent": class_holds(dom, "wp-") | (holds_any(html, "wp-content") & dom.rlike(
                r"""<[A-Za-z][^>]*\s(?i:id)\s*=\s*["']?wp-content["'\s>]""")),
            "slateContainer": class_holds(dom, "slate"),
            "joomlaSystem": F.exists(metas, lambda e: (e["key"] == "generator") & F.contains(e["value"], F.lit("Joomla"))),
            "bootstrapClasses": class_holds(dom, "bootstrap", "btn-", "col-"),
            "jqueryPresent": global_set("jQuery"),
            "reactRoot": holds_any(low, "root", "data-react-class") & dom.rlike(
                r"""<[A-Za-z][^>]*\s(?:(?i:id)\s*=\s*["']?root["'\s>]|(?i:data-reactroot|data-react-class)[\s=>/])"""),
            "vueApp": holds_any(low, "data-v-", "v-cloak") & dom.rlike(r"""<[A-Za-z][^>]*\s(?i:data-v-|v-cloak)[\s=>/]"""),
        }
        return F.map_from_arrays(F.array(*map(F.lit, found)), F.array(*found.values()))

    words = ("wp-", "slate", "bootstrap", "btn-", "col-", "root", "data-react-class", "data-v-", "v-cloak")
    return bind(F.when(holds_any(low, *words), markup(html)).otherwise(""), flags)


def js_globals(js_objects: Column) -> Column:
    """Presence of the recorded globals (E7), taken only from what the crawler observed."""
    names = F.array(*map(F.lit, JS_GLOBALS))
    return F.when(js_objects.isNotNull(), F.map_from_arrays(names, F.transform(
        names, lambda n: F.coalesce(F.try_element_at(js_objects, n), F.lit(False)))))


def request_hosts(request_urls: Column) -> Column:
    """Distinct host names a page requested; malformed URLs are ignored."""
    return F.array_distinct(F.array_compact(F.transform(request_urls, urls.host)))


def version_facts(html: Column, low: Column, scripts: Column, metas: Column, js_objects: Column,
                  hints: Column) -> Column:
    """Map of version facts (E9), completed from the HTML text where absent."""

    def generator(product: str) -> Column:
        named = F.filter(metas, lambda e: (e["key"] == "generator") & F.contains(e["value"], F.lit(product)))
        return F.get(named, 0)["value"]

    def script(fragment: str) -> Column:
        return F.get(F.filter(scripts, lambda s: F.contains(s["src"], F.lit(fragment))), 0)["src"]

    def global_set(name: str) -> Column:
        return F.try_element_at(js_objects, F.lit(name))

    canvas = F.get(F.filter(metas, lambda e: e["key"] == "canvas-environment"), 0)["value"]
    dom = {
        "wordpress": first_group(generator("WordPress"), r"WordPress (\d+\.\d+(?:\.\d+)?)"),
        "drupal": F.when(global_set("Drupal.settings"), first_group(script("drupal.js"), r"(\d+\.\d+)")),
        "joomla": first_group(generator("Joomla"), r"Joomla! (\d+\.\d+(?:\.\d+)?)"),
        "canvas": F.when(global_set("webpackChunkcanvas_lms"), canvas),
        "jquery": F.try_element_at(hints, F.lit("jquery")),
        "bootstrap": first_group(script("bootstrap"), r"(?i)bootstrap/(\d+\.\d+(?:\.\d+)?)"),
    }
    text = {name: F.when(holds_any(low, file), first_group(html, f"(?i)\\Q{file}\\E{version}"))
            for name, (file, version) in HTML_VERSION_PATTERNS.items()}
    found = [(name, value) for name, value in dom.items()]
    found += [(name, F.when(dom[name].isNull(), value) if name in dom else value)
              for name, value in text.items()]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in found])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def api_endpoints(html: Column, low: Column, tokens: Column, scripts: Column) -> Column:
    """Distinct API paths from inline scripts, script URLs and HTML attributes; first 20."""
    elements = F.filter(_tokens(tokens, "script"), lambda e: ~e.rlike(r"(?i)^<script\b[^>]*[\s\"'/]src\s*="))

    def quoted(script: Column) -> Column:
        parts = [F.transform(_all(script, p), lambda m: F.substr(m, F.lit(2), F.length(m) - 2))
                 for p in SCRIPT_API_PATTERNS]
        return F.concat(*parts)

    api_scripts = F.filter(scripts, lambda s: s["src"].rlike("/api/|/wp-json/|/rest/"))
    folders = F.transform(api_scripts, lambda s: F.regexp_replace(urls.path(s["src"]), "[^/]*$", ""))
    attributes = F.concat(*[_all(html, p, 1) for p in HTML_API_PATTERNS])
    in_text = F.when(holds_any(low, "/api/", "/wp-json/", "/rest/"), F.struct(
        F.flatten(F.transform(elements, quoted)).alias("scripts"), attributes.alias("attributes")))
    empty = F.array().cast("array<string>")
    return bind(in_text, lambda t: F.slice(F.array_distinct(F.concat(
        F.coalesce(t["scripts"], empty), folders, F.coalesce(t["attributes"], empty))), 1, MAX_API_ENDPOINTS))


def anchors(dom: Column, url: Column) -> Column:
    """Links in document order: absolute address and trimmed lower-case text.

    Every ``<a href>`` start tag is a link. Its text ends at the next end tag, the next link or the
    end of the page. ``url`` is the base.
    """
    parts = F.filter(F.split(dom, r"(?i)(?=<a\s)"), lambda p: p.rlike(r"(?i)^<a\s"))

    def link(part: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(part, rf"^<{_ATTRS}>", ""), r"(?is)</a(?:\s[^>]*)?>.*$", "")
        text = _entities(F.regexp_replace(body, rf"<[A-Za-z/!]{_ATTRS}>", ""))
        return F.struct(attribute(_start_tag(part), "href").alias("ref"),
                        F.lower(F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")).alias("text"))
    found = F.filter(F.transform(parts, link), lambda x: x["ref"] != "")
    return bind(urls.base_parts(url), lambda base: F.transform(found, lambda x: F.struct(
        urls.resolve(base, x["ref"]).alias("href"), x["text"].alias("text"))))


def with_page_inputs(pages: DataFrame) -> DataFrame:
    """Add the optional crawler columns a page table lacks, as nulls."""
    return pages.withColumns({
        name: F.lit(None).cast(kind) for name, kind in PAGE_INPUTS.items() if name not in pages.columns})


def extract_evidence(pages: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """All evidence columns of every page, in one narrow pass over the table.

    Columns nobody reads are pruned by Spark together with the work behind them.
    """
    html, low, url, js = F.col("html"), F.col("html_lower"), F.col("url"), F.col("js_objects")
    tokens, metas = F.col("_tokens"), F.col("_metas")
    none = F.array().cast("array<string>")
    return (
        with_page_inputs(pages)
        .withColumns({"_tokens": head_tokens(html), "html_lower": F.lower(html)})
        .withColumn("_base", base_url(tokens, url))
        .withColumns({"_metas": meta_entries(tokens), "scripts": script_sources(tokens, F.col("_base"))})
        .withColumns({
            "headers": F.transform_keys("headers", lambda k, v: F.lower(k)),
            "meta": last_per_key(metas),
            "dom": dom_strings(tokens, html),
            "has_elements": element_flags(html, low, js, metas),
            "network_hosts": request_hosts(F.col("request_urls")) if config.capture_network else none,
            "version_info": version_facts(html, low, F.col("scripts"), metas, js, F.col("version_hints")),
            "api_endpoints": api_endpoints(html, low, tokens, F.col("scripts")),
            "links": anchors(markup(html), F.col("_base")),
        })
        .drop("_tokens", "_metas", "_base", "version_hints", "request_urls")
    )


def long_evidence(evidence: DataFrame, ids: list[str]) -> DataFrame:
    """One row per piece of evidence: kind, key, value and position."""

    def rows(kind: str, items: Column, key, value) -> Column:
        listed = F.transform(items, lambda e, i: F.struct(
            F.lit(kind).alias("kind"), key(e).cast("string").alias("key"),
            value(e).cast("string").alias("value"), i.alias("ord")))
        empty = F.array().cast("array<struct<kind:string,key:string,value:string,ord:int>>")
        return F.coalesce(listed, empty)

    nothing = lambda e: F.lit(None)
    same = lambda e: e
    pair_key, pair_value = (lambda e: e["key"]), (lambda e: e["value"])
    dom = F.array(*[F.struct(F.lit(n).alias("key"), F.col("dom")[c].alias("value")) for n, c in (
        ("title", "title"), ("bodyClasses", "body_classes"), ("bodyId", "body_id"), ("headContent", "head_content"))])
    parts = F.concat(
        rows("html", F.array("html"), nothing, same),
        rows("script", F.col("scripts"), nothing, lambda e: e["src"]),
        rows("network", F.col("network_hosts"), nothing, same),
        rows("header", F.map_entries("headers"), pair_key, pair_value),
        rows("meta", F.map_entries("meta"), pair_key, pair_value),
        rows("dom", dom, pair_key, pair_value),
        rows("js", F.map_entries("js_objects"), pair_key, pair_value),
        rows("cookie", F.col("cookies"), lambda e: e["name"], pair_value),
    )
    return evidence.select(*ids, F.explode_outer(parts).alias("e")).filter("e is not null").select(*ids, "e.*")
