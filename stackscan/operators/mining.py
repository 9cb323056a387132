"""Signature mining on a labelled corpus (Q20, Q21).

``institutions(id, name, website_url, tech_profile)``, ``scans(id, institution_id)``,
``scan_pages(scan_id, content struct<url, html>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.functions.regex import to_spark_regex

POSITIVE_SAMPLE = 250
NEGATIVE_SAMPLE = 600
SPOTCHECK_ROWS = 12


def positives(institutions: DataFrame, category: str, vendor: str, historical: bool = False) -> DataFrame:
    """Institutions whose profile lists the vendor in a category, by name or raw name."""
    entry = F.try_element_at("tech_profile.categories", F.lit(category))
    lists = [entry["current"], entry["historical"]] if historical else [entry["current"]]

    def listed(techs: Column) -> Column:
        named = F.exists(techs, lambda t: (t["name"] == vendor) | F.array_contains(t["raw_names"], vendor))
        return F.coalesce(named, F.lit(False))

    member = listed(lists[0])
    for techs in lists[1:]:
        member = member | listed(techs)
    return institutions.filter(member).select("id")


def sample_ids(ids: DataFrame, limit: int | None, seed: int) -> DataFrame:
    """Repeatable random sample: the ``limit`` smallest seeded hashes; all rows without a limit."""
    return ids if limit is None else ids.orderBy(_shuffled(seed), "id").limit(limit)


def _shuffled(seed: int) -> Column:
    return F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}")))


def universe(institutions: DataFrame, scans: DataFrame, scan_pages: DataFrame, category: str, vendor: str,
             historical: bool = False, n_positive: int | None = POSITIVE_SAMPLE,
             n_negative: int | None = NEGATIVE_SAMPLE, seed: int = 0) -> DataFrame:
    """Sampled positives and negatives among institutions with a captured page.

    Only join keys are read here, no page content.
    """
    scanned_scans = scan_pages.select(F.col("scan_id").alias("id")).distinct()
    scanned = scans.join(scanned_scans, "id", "left_semi").select(F.col("institution_id").alias("id")).distinct()
    labelled = positives(institutions, category, vendor, historical).withColumn("is_pos", F.lit(True))
    flagged = scanned.join(labelled, "id", "left").withColumn("is_pos", F.coalesce("is_pos", F.lit(False)))
    if n_positive is None and n_negative is None:
        return flagged
    pos = sample_ids(flagged.filter("is_pos"), n_positive, seed)
    return pos.unionByName(sample_ids(flagged.filter("not is_pos"), n_negative, seed + 1))


def matches(html: Column, signature: str, as_regex: bool = False) -> Column:
    """Whether a page holds the signature: substring ignoring case, or regular expression."""
    if as_regex:
        return html.rlike(to_spark_regex(signature))
    return F.contains(F.lower(html), F.lit(signature.lower()))


def institution_hits(members: DataFrame, scans: DataFrame, scan_pages: DataFrame, signature: str,
                     as_regex: bool = False) -> DataFrame:
    """Per institution of the universe: whether any page matches, one matching URL, pages.

    Every page is tested where it lies and only the outcome moves, never its HTML, whether the
    universe is sampled or not. Flags are combined map-side.
    """
    keys = scans.select(F.col("id").alias("scan_id"), F.col("institution_id").alias("id"))
    tested = scan_pages.filter("content.html is not null").select(
        "scan_id", F.col("content.url").alias("url"), matches(F.col("content.html"), signature, as_regex).alias("hit"))
    per_scan = tested.groupBy("scan_id").agg(
        F.max("hit").alias("hit"), F.min(F.when(F.col("hit"), F.col("url"))).alias("url"), F.count("*").alias("pages"))
    return per_scan.join(keys.join(members, "id"), "scan_id").groupBy("id", "is_pos").agg(
        F.max("hit").alias("hit"), F.min("url").alias("sample_hit_url"), F.sum("pages").alias("pages"))


def signature_metrics(hits: DataFrame, labelled: DataFrame, vendor: str, category: str, signature: str) -> DataFrame:
    """Recall on positives and hit rate on negatives, in percent (Q20).

    ``labelled`` are all positives, scanned or not; their rows are counted along with the hits.
    """
    rows = hits.select("is_pos", "hit", F.lit(False).alias("listed")).unionByName(
        labelled.select(F.lit(None).cast("boolean").alias("is_pos"), F.lit(None).cast("boolean").alias("hit"),
                        F.lit(True).alias("listed")))
    pos, neg, hit = F.col("is_pos"), ~F.col("is_pos"), F.col("hit")

    def pct(part: str, whole: str, digits: int) -> Column:
        share = 100 * F.col(part).cast("decimal(20,0)") / F.nullif(F.col(whole), F.lit(0)).cast("decimal(20,0)")
        return F.round(share, digits).cast("double")

    return rows.agg(
        F.count_if("listed").alias("positives_total"),
        F.count_if(pos).alias("pos_with_html"), F.count_if(pos & hit).alias("pos_hit"),
        F.count_if(neg).alias("neg_with_html"), F.count_if(neg & hit).alias("neg_hit"),
    ).select(
        F.lit(vendor).alias("vendor"), F.lit(category).alias("category"), F.lit(signature).alias("signature"),
        "positives_total", "pos_with_html", "pos_hit", pct("pos_hit", "pos_with_html", 1).alias("recall_pct"),
        "neg_with_html", "neg_hit", pct("neg_hit", "neg_with_html", 3).alias("neg_hit_pct"))


def spotcheck(hits: DataFrame, institutions: DataFrame, limit: int = SPOTCHECK_ROWS, seed: int = 0) -> DataFrame:
    """Sampled negatives that match and positives that do not, with site details (Q21)."""
    kind = F.when(F.col("is_pos"), "pos_miss").otherwise("neg_hit")
    order = Window.partitionBy("kind").orderBy(_shuffled(seed), "id")
    picked = (
        hits.filter(F.col("hit") != F.col("is_pos"))
        .select(kind.alias("kind"), "id", F.when(~F.col("is_pos"), F.col("sample_hit_url")).alias("sample_hit_url"))
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn"))
    names = institutions.select("id", "name", F.col("website_url").alias("website"))
    return names.join(F.broadcast(picked), "id").select("kind", "id", "name", "website", "sample_hit_url")
