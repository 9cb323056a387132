"""URL parts, slugs and admission.

Parts are taken by regular expression: page URLs often hold spaces or non-ASCII letters,
which a strict URI parser rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscan.functions.columns import bind, none_if_empty

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def scheme(url: Column) -> Column:
    return none_if_empty(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def host(url: Column) -> Column:
    """Lower-case host name without user and port; null for a URL without one."""
    return none_if_empty(F.lower(F.regexp_extract(url, _AUTHORITY + r"([^/?#:]+)", 1)))


def path(url: Column) -> Column:
    """Path of a URL, '/' when it has none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url).isNotNull(), F.when(raw == "", F.lit("/")).otherwise(raw))


def origin(url: Column) -> Column:
    return none_if_empty(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def root_host(url: Column) -> Column:
    """Host without a leading ``www.``: the site a page belongs to."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _without_dots(raw: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""

    def step(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == ".", done).when(segment == "..", shorter).otherwise(F.concat(done, F.array(segment)))

    segments = F.split(F.regexp_replace(raw, r"/\.{1,2}$", "$0/"), "/")
    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(raw.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), joined).otherwise(raw)


def normal(url: Column) -> Column:
    """Canonical form of a web address: scheme and host in lower case, no default port, a path
    without dot segments and never empty. Other addresses stay as they are."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    user = F.regexp_extract(url, r"^[^/]*//([^/?#@]*@)", 1)
    name = F.lower(F.regexp_extract(url, _AUTHORITY + r"([^/?#]*)", 1))
    port = F.regexp_replace(name, F.when(head == "https://", F.lit(r":(?:443)?$")).otherwise(F.lit(r":(?:80)?$")), F.lit(""))
    raw = F.regexp_extract(url, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    clean = F.when(raw == "", F.lit("/")).otherwise(_without_dots(raw))
    return F.when(url.rlike(r"(?i)^https?://[^/?#]"), F.concat(head, user, port, clean, rest)).otherwise(url)


def base_parts(url: Column) -> Column:
    """What links on a page are resolved against; taken apart once per page."""
    stem = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.when(stem.rlike(r"^[^:/]+://[^/]*$"), F.concat(stem, F.lit("/"))).otherwise(
        F.regexp_replace(stem, r"[^/]*$", ""))
    return F.struct(
        F.concat(scheme(url), F.lit(":")).alias("scheme"), origin(url).alias("origin"), stem.alias("stem"),
        folder.alias("folder"), F.regexp_extract(url, r"^([^#]*)", 1).alias("page"))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute, canonical form of a link, given the page's ``base_parts``."""
    start = F.substring(ref, 1, 1)
    absolute = (
        F.when(F.startswith(ref, F.lit("//")), F.concat(base["scheme"], ref))
        .when(start == "/", F.concat(base["origin"], ref))
        .when(start == "#", F.concat(base["page"], ref))
        .when(start == "?", F.concat(base["stem"], ref))
        .when(F.contains(ref, F.lit(":")) & ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .otherwise(F.concat(base["folder"], ref))
    )
    return bind(absolute, normal)


def tech_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def host_slug(url: Column) -> Column:
    """File-name form of host and path, at most 100 characters."""
    joined = F.concat(host(url), path(url))
    slug = F.lower(F.regexp_replace(F.regexp_replace(joined, "(?i)[^a-z0-9.]+", "-"), "^-|-$", ""))
    plain = F.regexp_replace(url, "(?i)[^a-z0-9]+", "-")
    return F.substring(F.when(joined.isNotNull(), slug).otherwise(plain), 1, 100)


def rejection(url: Column) -> Column:
    """Why a URL may not be scanned; null when it may."""
    name = host(url)
    private = r"^(?:127\.|192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(~F.coalesce(scheme(url).isin("http", "https"), F.lit(False)) | name.isNull(),
              "invalid")
        .when((name == "localhost") | name.rlike(private), "private")
    )


def admit(rows: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Split rows into those whose URL may be scanned and the rejects with their reason."""
    reason = rejection(F.col(url_col))
    return rows.filter(reason.isNull()), rows.withColumn("reason", reason).filter("reason is not null")
