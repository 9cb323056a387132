"""End-to-end scans: from page tables to site documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.model import ScanConfig
from stackscan.operators import frontier, rollup
from stackscan.operators.evidence import PAGE_INPUTS, anchors, base_url, extract_evidence, head_tokens, markup, with_page_inputs
from stackscan.operators.match import detect
from stackscan.sources.signatures import Library

IDS = ["site", "url", "page_ord"]


def detect_pages(pages: DataFrame, library: Library, ids: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Detections of every page of a table: evidence, matching, scoring, threshold."""
    return detect(extract_evidence(pages, config), library, ids, config)


def site_technologies(pages: DataFrame, library: Library, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Merged technologies of every site over all of its pages (``site``, ``url``, ``page_ord``)."""
    return rollup.merge_sites(detect_pages(pages, library, IDS, config))


def pages_in_budget(pages: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """A site's main page - its first - and the further pages its scan has room for.

    Excluded pages have used up their place before they are dropped; a site whose main page is
    excluded has no scan.
    """
    admitted = pages.filter(urls.rejection(F.col("url")).isNull())
    wider = ScanConfig(max_pages=config.max_pages + 1)
    chosen = frontier.page_budget(admitted, "site", ["page_ord"], wider)
    excluded = frontier.excluded_path(F.col("url"), config)
    # at most the budget's pages of a site are left here
    no_main = F.bool_or((F.col("slot") == 1) & F.col("_out")).over(Window.partitionBy("site"))
    return chosen.withColumn("_out", excluded).withColumn("_no_main", no_main).filter("not _out and not _no_main").drop("_out", "_no_main")


def page_scans(pages: DataFrame) -> DataFrame:
    """The scan rows ``scan_documents`` needs, with absent crawler columns as nulls."""
    for name, kind in (("final_url", "string"), ("response_code", "int"), ("scanned_at", "timestamp")):
        if name not in pages.columns:
            pages = pages.withColumn(name, (F.col("url") if name == "final_url" else F.lit(None)).cast(kind))
    return pages.select("site", "url", "final_url", "page_ord", "response_code", "scanned_at")


def budgeted_scan(pages: DataFrame, library: Library, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Scan documents of sites whose candidate pages are given in order of priority."""
    chosen = pages_in_budget(pages, config)
    return rollup.scan_documents(page_scans(chosen), site_technologies(chosen, library, config))


def linked_scan(seeds: DataFrame, pages: DataFrame, responses: DataFrame, library: Library,
                config: ScanConfig = ScanConfig()) -> DataFrame:
    """Scan documents of seed URLs, choosing the further pages the way a live scan does.

    ``seeds(site, url)``; ``pages`` is the page store, one row per ``url``; ``responses`` the
    crawler's log (``url``, ``fetched_at``, ``status``, ``headers``, ``body``). A site's pages are
    its main page, pages linked from it, derived subdomains or paths that answered, and the pooled
    probes. The store is joined with lists of wanted URLs; only wanted pages' HTML moves on.
    """
    store = with_page_inputs(pages).select("url", "html", *PAGE_INPUTS)

    def fetch(wanted: DataFrame) -> DataFrame:
        return frontier.drop_excluded(store.join(wanted, "url"), config, "url")

    first = seeds.select("site", "url", F.lit(0).alias("source_ord"), F.lit(0).cast("long").alias("page_ord"))
    main = fetch(first)
    links = frontier.candidate_links(
        main.select("site", "url", anchors(markup(F.col("html")), base_url(head_tokens(F.col("html")), F.col("url"))).alias("links")), ["site", "url"], config)
    slots = frontier.page_budget(links, "site", ["pos"], config).filter(F.col("href") != F.col("url"))
    linked = slots.select("site", F.col("href").alias("url"), F.lit(1).alias("source_ord"), F.col("slot").cast("long").alias("page_ord"))
    roots = seeds.select("site", "url")
    answered = frontier.reachable_derived(frontier.derived_candidates(roots, config), responses)
    derived = answered.select(
        "site", F.col("candidate").alias("url"), F.lit(2).alias("source_ord"), F.col("prefix_ord").cast("long").alias("page_ord"))
    scanned = main.unionByName(fetch(linked.unionByName(derived)))
    pooled = frontier.probe_pages(frontier.probe_targets(roots, config), responses)
    probes = pooled.withColumns({"source_ord": F.lit(3), "page_ord": F.lit(0).cast("long")})
    ids = [*IDS, "source_ord"]
    found = detect_pages(scanned, library, ids, config).unionByName(detect(probes, library, ids, config))
    return rollup.scan_documents(page_scans(scanned.filter("source_ord <= 1")), rollup.merge_sites(found))
