"""From page detections to site results and reports.

Groups here are keyed by site, and one site may own a large part of all pages. Page rows are
therefore first reduced per (site, technology, evidence label) - a map-side aggregate - and only
these rows, whose number is bounded by the signature library, are collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions.columns import bind, union_all, unnest

# Page sources of a site in merge order.
SOURCES = ("main", "additional", "derived", "probe")
ORDER = ("source_ord", "page_ord", "rank")
# Stack slot -> categories that fill it.
STACK_SINGLE = {"cms": ("cms",), "lms": ("lms",), "sis": ("sis",), "crm": ("crm",)}
STACK_LISTS = {"analytics": ("analytics",), "javascript": ("javascript framework", "javascript"),
               "server": ("web server",), "cdn": ("cdn",)}


def union_sources(**parts: DataFrame) -> DataFrame:
    """Detections of a site's page sources in merge order."""
    return union_all([parts[name].withColumn("source_ord", F.lit(i))
                      for i, name in enumerate(SOURCES) if name in parts])


def merge_sites(detections: DataFrame, site: str = "site") -> DataFrame:
    """One row per site and technology (R2).

    Names are merged ignoring case. Evidence and categories are ordered unions, confidence is
    the highest of any page, version the first known, the name that of the first detection.
    ``detections`` carries ``page_ord`` and, if several sources were united, ``source_ord``.
    """
    if "source_ord" not in detections.columns:
        detections = detections.withColumn("source_ord", F.lit(0))
    at = F.struct(*ORDER)
    labels = detections.select(
        site, "tech", "confidence", "categories", "version", "is_higher_ed", "description",
        at.alias("at"), F.posexplode_outer("evidence").alias("pos", "label"))
    per_label = labels.groupBy(site, "tech", "label").agg(
        F.max("confidence").alias("confidence"),
        F.min("at").alias("at"),
        F.min(F.struct("at", "pos")).alias("label_at"),
        F.min(F.when(F.col("version").isNotNull(), F.struct("at", "version"))).alias("versioned"),
        F.first("categories").alias("categories"),
        F.first("is_higher_ed").alias("is_higher_ed"),
        F.first("description").alias("description"))
    first = F.struct("at", "tech", "is_higher_ed", "description")
    merged = per_label.groupBy(site, F.lower("tech").alias("tech_key")).agg(
        F.max("confidence").alias("confidence"),
        F.min(first).alias("first"),
        F.min("versioned").alias("versioned"),
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label_at", "label")))).alias("labels"),
        F.array_sort(F.collect_set(F.struct("at", "categories"))).alias("cats"))
    rank = Window.partitionBy(site).orderBy(F.desc("confidence"), "first.at")
    return merged.select(
        site, "tech_key", F.row_number().over(rank).alias("rank"),
        F.col("first.tech").alias("tech"), "confidence",
        F.array_distinct(F.flatten(F.transform("cats", lambda c: c["categories"]))).alias("categories"),
        F.array_distinct(F.transform("labels", lambda x: x["label"])).alias("evidence"),
        F.col("versioned.version").alias("version"),
        F.col("first.is_higher_ed").alias("is_higher_ed"),
        F.col("first.description").alias("description"))


def has_category(*names: str) -> Column:
    """Whether a detection has one of the categories, ignoring case."""
    lowered = F.transform("categories", lambda c: F.lower(c))
    return F.arrays_overlap(lowered, F.array(*map(F.lit, names)))


def stack_components(merged: DataFrame, site: str = "site", prefer: str = "last") -> DataFrame:
    """Stack slots of every site.

    Single slots go to the last technology in rank order, so the one with the lowest confidence
    wins; ``prefer='highest'`` takes the first instead. Lists keep rank order.
    """
    pick = F.max_by if prefer == "last" else F.min_by
    single = [pick("tech", F.when(has_category(*cats), F.col("rank"))).alias(slot)
              for slot, cats in STACK_SINGLE.items()]
    lists = [F.transform(F.array_sort(F.collect_list(
        F.when(has_category(*cats), F.struct("rank", "tech")))), lambda x: x["tech"]).alias(slot)
        for slot, cats in STACK_LISTS.items()]
    return merged.groupBy(site).agg(*single, *lists)


def stack_inferences(stack: DataFrame) -> DataFrame:
    """Add the conclusions drawn from combinations of slots (R4). Their texts are fixed values."""
    rules = F.array(
        F.when((F.col("cms") == "WordPress") & F.array_contains("javascript", "React"),
               "WordPress with React frontend (likely headless WordPress)"),
        F.when((F.col("lms") == "Canvas LMS") & F.array_contains("server", "Apache"),
               "Canvas LMS hosted on Apache (standard institutional setup)"),
        F.when((F.col("cms") == "Drupal") & F.array_contains("analytics", "Google Analytics"),
               "Enterprise Drupal with Google Analytics integration"),
        F.when(F.col("sis").isNotNull() & F.col("lms").isNotNull(),
               F.concat(F.lit("Integrated SIS ("), "sis", F.lit(") and LMS ("), "lms", F.lit(") environment"))),
    )
    return stack.withColumn("inferences", F.array_compact(rules))


def scan_documents(scans: DataFrame, merged: DataFrame, site: str = "site") -> DataFrame:
    """One nested document per scanned site.

    ``scans`` lists the pages of each scan, which the page budget bounds: ``site``, ``url``,
    ``final_url``, ``page_ord``, ``response_code``, ``scanned_at``.
    """
    technology = F.struct(
        "rank", F.col("tech").alias("name"), "confidence", "categories", "evidence", "version",
        "is_higher_ed", "description")
    techs = merged.groupBy(site).agg(F.array_sort(F.collect_list(technology)).alias("technologies"))
    stack = stack_inferences(stack_components(merged, site))
    slots = [*STACK_SINGLE, *STACK_LISTS]
    stacks = stack.select(site, F.struct(F.struct(*slots).alias("components"), "inferences").alias("inferred_stack"))
    page = F.struct("page_ord", "url", "final_url", "response_code", "scanned_at")
    heads = scans.groupBy(site).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    no_names = F.array().cast("array<string>")
    empty_stack = F.struct(
        F.struct(*[F.lit(None).cast("string").alias(s) for s in STACK_SINGLE],
                 *[no_names.alias(s) for s in STACK_LISTS]).alias("components"),
        no_names.alias("inferences"))
    first = F.get("pages", F.lit(0))
    return heads.join(techs, site, "left").join(stacks, site, "left").select(
        site, first["url"].alias("url"), first["final_url"].alias("final_url"),
        F.array_max(F.transform("pages", lambda p: p["scanned_at"])).alias("timestamp"),
        F.coalesce("technologies", F.array().cast(techs.schema["technologies"].dataType)).alias("technologies"),
        F.size("pages").alias("scanned_pages"),
        F.transform("pages", lambda p: p["final_url"]).alias("scanned_urls"),
        F.coalesce("inferred_stack", empty_stack).alias("inferred_stack"),
        first["response_code"].alias("response_code"))


def category_counts(detections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Technologies per category."""
    keys = [*(by or []), "category"]
    return unnest(detections, by or [], "categories", "category").groupBy(*keys).agg(
        F.count("*").alias("technologies"))


def higher_ed_subset(merged: DataFrame, site: str = "site") -> DataFrame:
    """Higher-education technologies with their confidence."""
    return merged.filter("is_higher_ed").select(site, "tech", "confidence")


def evidence_preview(detections: DataFrame, shown: int = 3) -> DataFrame:
    """First pieces of evidence and how many more there are."""
    return detections.withColumns({
        "shown": F.slice("evidence", 1, shown),
        "more": F.greatest(F.size("evidence") - shown, F.lit(0))})


def confident(detections: DataFrame, at_least: int) -> DataFrame:
    """Detections at or above a confidence."""
    return detections.filter(F.col("confidence") >= at_least)


def in_category(detections: DataFrame, *names: str) -> DataFrame:
    """Detections of a category, ignoring case."""
    return detections.filter(has_category(*[n.lower() for n in names]))


def site_comparison(merged: DataFrame, site: str = "site", top: int = 5) -> DataFrame:
    """Side-by-side figures of sites."""
    best = F.slice(F.array_sort(F.collect_list(F.when(
        F.col("rank") <= top, F.struct("rank", F.col("tech").alias("name"), "confidence")))), 1, top)
    totals = merged.groupBy(site).agg(
        F.count("*").alias("total_tech"), F.count_if("is_higher_ed").alias("higher_ed_tech"),
        F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"))).alias("top_technologies"),
        *[F.max_by("tech", F.when(has_category(slot), F.col("rank"))).alias(slot) for slot in ("cms", "lms", "sis")])
    return totals


def scan_summary(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, successful and failed scans (R11). ``scans`` has an ``error``, null on success."""
    return scans.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"))


def failed_scans(scans: DataFrame) -> DataFrame:
    """The failures themselves, as rows: their number is not bounded."""
    return scans.filter(F.col("error").isNotNull()).select("url", "error")


def versioned_technologies(merged: DataFrame, site: str = "site") -> DataFrame:
    """Detections with a known version."""
    return merged.filter(F.col("version").isNotNull()).select(site, "tech", "version")


def channel_counts(detections: DataFrame) -> DataFrame:
    """Detections, technologies and sole-channel detections per evidence channel."""
    channels = F.array_distinct(F.transform("evidence", lambda e: F.regexp_extract(e, "^([A-Za-z]+):", 1)))
    per_channel = F.transform(channels, lambda c: F.struct(c.alias("channel"), F.lit(False).alias("sole")))
    marked = bind(per_channel, lambda cs: F.transform(cs, lambda c: c.withField("sole", F.size(cs) == 1)))
    rows = unnest(detections, ["tech"], marked, "c").select("tech", "c.*")
    return rows.groupBy("channel").agg(
        F.count("*").alias("detections"), F.count_distinct("tech").alias("technologies"),
        F.count_if("sole").alias("sole_detections"))


def channel_technologies(detections: DataFrame, channel: str) -> DataFrame:
    """Technologies found through a channel, such as requests seen only on the network."""
    through = F.exists("evidence", lambda e: F.startswith(e, F.lit(f"{channel}:")))
    return detections.filter(through).groupBy("tech").agg(F.count("*").alias("detections"))
