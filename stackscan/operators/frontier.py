"""Which pages belong to a site's scan: link and response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.functions.columns import any_contains, first_of_each, last_per_key, unnest
from stackscan.model import ScanConfig


def page_links(pages: DataFrame, ids: list[str]) -> DataFrame:
    """One row per link of a page: position, address, text."""
    return unnest(pages, [*ids, "url"], "links", "link", "pos").select(*ids, "url", "pos", "link.href", "link.text")


def candidate_links(pages: DataFrame, ids: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Links worth scanning on every page: strategic ones, else fallback ones (F1, F2).

    A page's links are one array, so choosing, de-duplicating and the fallback test need no
    shuffle. ``source`` tells which rule chose the link.
    """

    def same_site(link: Column) -> Column:
        here = F.coalesce(urls.host(link["href"]) == F.col("_host"), F.lit(False))
        return urls.host(link["href"]).isNotNull() if config.follow_external_links else here

    def strategic(link: Column) -> Column:
        return (any_contains(F.lower(urls.path(link["href"])), config.strategic_paths)
                | any_contains(link["text"], config.strategic_paths))

    def fallback(link: Column) -> Column:
        words = F.lower(F.concat(link["text"], F.lit(" "), urls.path(link["href"])))
        return any_contains(words, config.fallback_words)

    known = pages.select(*ids, "links", urls.host(F.col("url")).alias("_host")).select(
        *ids, F.filter("links", same_site).alias("_links"))
    split = known.select(*ids, F.filter("_links", strategic).alias("_strategic"),
                         F.filter("_links", fallback).alias("_fallback"))
    # the rule's name travels with each link: as a column of the page, a filter by it would be pushed
    # below and compute the links once more
    any_strategic = F.size("_strategic") > 0
    chosen = split.select(*ids, F.when(any_strategic, "strategic").otherwise("fallback").alias("_source"), first_of_each(
        F.when(any_strategic, F.col("_strategic")).otherwise(F.col("_fallback")), "href").alias("_chosen"))
    named = chosen.select(*ids, F.transform("_chosen", lambda x: F.struct(
        F.col("_source").alias("source"), x["href"].alias("href"), x["text"].alias("text"))).alias("_chosen"))
    return unnest(named, ids, "_chosen", "link", "pos").select(*ids, "link.source", "pos", "link.href", "link.text")


def strategic_links(pages: DataFrame, ids: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Same-host links whose path or text holds a strategic fragment (F1)."""
    return candidate_links(pages, ids, config).filter("source = 'strategic'").drop("source")


def fallback_links(pages: DataFrame, ids: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Links chosen by indicator words on pages without a strategic link (F2)."""
    return candidate_links(pages, ids, config).filter("source = 'fallback'").drop("source")


def excluded_path(url: Column, config: ScanConfig = ScanConfig()) -> Column:
    return F.coalesce(any_contains(F.lower(urls.path(url)), [p.lower() for p in config.excluded_paths]), F.lit(False))


def drop_excluded(pages: DataFrame, config: ScanConfig = ScanConfig(), url_col: str = "final_url") -> DataFrame:
    """Pages whose final URL is not on an excluded path."""
    return pages.filter(~excluded_path(F.col(url_col), config))


def page_budget(candidates: DataFrame, site: str, order: list[str], config: ScanConfig = ScanConfig()) -> DataFrame:
    """The first additional pages of every site that fit the budget.

    Spark keeps at most the budget per site in each map task before the shuffle, so a site
    with very many candidates does not gather in one task.
    """
    w = Window.partitionBy(site).orderBy(*order)
    return candidates.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= config.max_pages - 1)


def not_scanned(candidates: DataFrame, scanned: DataFrame, on: str = "url") -> DataFrame:
    """Candidates that were not scanned already."""
    return candidates.join(scanned.select(on).distinct(), on, "left_anti")


def derived_candidates(sites: DataFrame, config: ScanConfig = ScanConfig(), url_col: str = "url") -> DataFrame:
    """Subdomain and path candidates of every site, in probing order (F6). Other columns of
    ``sites`` are passed on."""
    url = F.col(url_col)
    pairs = []
    for i, prefix in enumerate(config.derived_prefixes):
        subdomain = F.concat(urls.scheme(url), F.lit(f"://{prefix}."), urls.root_host(url), F.lit("/"))
        folder = F.concat(urls.scheme(url), F.lit("://"), urls.host(url), F.lit(f"/{prefix}/"))
        pairs += [F.struct(F.lit(i).alias("prefix_ord"), F.lit(prefix).alias("prefix"),
                           F.lit(k).alias("variant"), c.alias("candidate"))
                  for k, c in enumerate((subdomain, folder))]
    rows = sites.filter(urls.host(url).isNotNull()).select("*", F.explode(F.array(*pairs)).alias("c"))
    return rows.select(*sites.columns, "c.*").filter(
        (F.col("candidate") != url) & (F.col("candidate") != F.concat(url, F.lit("/"))))


def reachable_derived(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """The first candidate per site and prefix that answered.

    ``responses(url, fetched_at, status)`` is the crawler's response log; a URL's latest answer counts.
    """
    latest = responses.groupBy(F.col("url").alias("candidate")).agg(F.max_by("status", "fetched_at").alias("status"))
    status = F.col("status")
    answered = latest.filter((status < 400) | status.isin(401, 403)).select("candidate")
    first = F.min(F.struct("variant", "candidate")).alias("first")
    keys = [c for c in candidates.columns if c not in ("variant", "candidate")]
    return candidates.join(answered, "candidate").groupBy(*keys).agg(first).select(*keys, "first.*")


def probe_targets(sites: DataFrame, config: ScanConfig = ScanConfig(), url_col: str = "url") -> DataFrame:
    """Probe URLs of every site's origin (F7). Other columns of ``sites`` are passed on."""
    paths = F.array(*[F.struct(F.lit(i).alias("probe_ord"), F.lit(p).alias("path"))
                      for i, p in enumerate(config.probe_paths)])
    start = urls.origin(F.col(url_col))
    return sites.filter(start.isNotNull()).select("*", start.alias("origin"), F.explode(paths).alias("p")).select(
        *sites.columns, "origin", "p.*", F.concat("origin", "p.path").alias("target"))


def probe_pages(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """Useful probe answers of a site pooled into one page of evidence.

    ``responses(url, fetched_at, status, headers, body)`` is the crawler's log; the latest answer
    of a probe counts, so a pool holds at most one row per probe path. Bodies are joined in probe
    order, later headers win, and the paths that answered 200 are the API endpoints.
    """
    answer = F.struct("status", "headers", "body")
    latest = responses.groupBy(F.col("url").alias("target")).agg(F.max_by(answer, "fetched_at").alias("r"))
    useful = targets.join(latest, "target").filter(F.col("r.status").isin(200, 301, 302))
    # Maps cannot be ordered, so an answer's headers travel as an array of entries.
    row = F.struct("probe_ord", "path", F.col("r.status").alias("status"), F.col("r.body").alias("body"),
                   F.map_entries("r.headers").alias("headers"))
    keys = [c for c in targets.columns if c not in ("origin", "probe_ord", "path", "target")]
    pooled = useful.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("answers"))
    headers = F.flatten(F.array_compact(F.transform("answers", lambda a: F.transform(a["headers"], lambda h: F.struct(
        F.lower(h["key"]).alias("key"), h["value"].alias("value"))))))
    return pooled.select(
        *keys, F.array_join(F.transform("answers", lambda a: a["body"]), "\n").alias("html"),
        last_per_key(headers).alias("headers"),
        F.transform(F.filter("answers", lambda a: a["status"] == 200), lambda a: a["path"]).alias("api_endpoints"))
