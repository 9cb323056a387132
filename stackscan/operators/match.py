"""Signature matching and scoring.

A page's evidence is one row, so all of its signatures are tested, summed per technology,
cut at the confidence threshold and ranked inside that row: from the page scan to the
detections there is no shuffle, and a hot site is spread over as many tasks as it has pages.

Signatures that test the same thing (``ALIKE``) are one test: a page's candidates and the tests that fire are
named by the first of them, and only then are all signatures of these tests listed, or summed per technology.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from stackscan.functions.columns import bind, none_if_empty
from stackscan.functions.workers import worker_keeps
from stackscan.model import EVIDENCE_TYPES, KINDS, MAX_HTML_HITS, ScanConfig
from stackscan.operators.candidates import MAPPED, PART, Store, candidate_rows, entry_text, key_trigger, rows_alike, rows_exploded, store
from stackscan.sources.signatures import Library

#: What a candidate carries, its test; what all signatures that share it are found by; and what a match tells.
_CANDIDATE = ["kind", "key", "pattern", "exact"]
ALIKE = ["kind", "key", "pattern"]
_MATCH = ["ord", "tech", "kind", "key", "weight", "label", "categories", "is_higher_ed", "description"]
# What a detection tells, and how many matching signatures are handed over at a time (or those of a page).
_DETECTION = ArrayType(StructType([
    StructField("tech", StringType()), StructField("confidence", IntegerType()), StructField("categories", ArrayType(StringType())),
    StructField("evidence", ArrayType(StringType())), StructField("is_higher_ed", BooleanType()), StructField("description", StringType())]))
_HANDED = 1 << 18
# DOM fields a signature can test.
_DOM_FIELDS = {"title": "title", "bodyClasses": "body_classes", "bodyId": "body_id",
               "headContent": "head_content"}


def with_evidence_columns(pages: DataFrame) -> DataFrame:
    """Add the evidence columns a table lacks, as nulls: no evidence, no matches."""
    return pages.withColumns({
        name: F.lit(None).cast(kind) for name, kind in EVIDENCE_TYPES.items() if name not in pages.columns})


def _sources() -> Column:
    return F.transform("scripts", lambda s: s["src"])


def _dom_field(key: Column) -> Column:
    value = F.lit(None).cast("string")
    for name, column in _DOM_FIELDS.items():
        value = F.when(key == name, F.col("dom")[column]).otherwise(value)
    return value


def _fires(s: Column, kinds: set[str]) -> Column:
    """Whether signature ``s`` matches the row's evidence; only kinds in use are referenced."""
    html = F.col("html")
    regex = s["pattern"]
    header = F.try_element_at("headers", s["key"])
    meta = F.try_element_at("meta", s["key"])
    dom = _dom_field(s["key"])
    cookie = F.get(F.filter("cookies", lambda c: c["name"] == s["key"]), 0)
    tests = {
        "html": F.rlike(html, regex),
        "script": F.exists(_sources(), lambda src: F.rlike(src, regex)),
        "network": F.exists("network_hosts", lambda h: F.rlike(h, regex)),
        "header": (header != "") & F.rlike(header, regex),
        "meta": (meta != "") & F.rlike(meta, regex),
        "dom": (dom != "") & F.rlike(dom, regex),
        "js": F.try_element_at("js_objects", s["key"]),
        "cookie": cookie.isNotNull() & ((regex == "(?i)") | F.rlike(F.coalesce(cookie["value"], F.lit("")), regex)),
    }
    answer = F.lit(False)
    for kind in KINDS:
        if kind in kinds:
            answer = F.when(s["kind"] == kind, tests[kind]).otherwise(answer)
    return F.coalesce(answer, F.lit(False))


def evidence_texts(kinds: set[str]) -> dict[str, Column]:
    """The texts searched for literals, by kind in use."""
    texts = {"html": F.col("html"), "script": F.concat_ws("\n", _sources()),
             "network": F.concat_ws("\n", "network_hosts")}
    return {kind: text for kind, text in texts.items() if kind in kinds}


def _entry_texts(kinds: set[str]) -> dict[str, Column]:
    """Keys and values looked up by the other kinds, each kind's as one text."""
    fields = F.array(*[F.struct(F.lit(name).alias("key"), F.col("dom")[column].alias("value")) for name, column in _DOM_FIELDS.items()])
    texts = {"header": entry_text(F.map_entries("headers")), "meta": entry_text(F.map_entries("meta")),
             "dom": entry_text(fields), "cookie": entry_text(F.col("cookies"), "name")}
    return {kind: text for kind, text in texts.items() if kind in kinds}


def _present_globals() -> Column:
    names = F.map_keys(F.map_filter("js_objects", lambda k, v: v))
    return F.coalesce(F.transform(names, lambda k: F.concat(F.lit(key_trigger("js", "")), k)), F.array().cast("array<string>"))


def _odd_case(text: Column) -> Column:
    """Whether a text holds one of the two non-ASCII letters whose lower case is ASCII. Only then
    can a literal of the lower-cased text be no match of the pattern itself."""
    return F.coalesce(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.lit(False))


def _fired(pages: DataFrame, library: Library, keep: list[str], prefilter: bool, part: int) -> DataFrame:
    """``keep`` columns plus ``_fired``, the tests that match, by the number of their first signature: one row per
    row of ``pages``.

    Pages are read once, whatever the size of the library; ``part`` bounds how many signatures a worker looks at
    together. Without ``prefilter`` every test is made on every page.
    """
    pages = with_evidence_columns(pages)
    kinds = library.kinds
    searched = evidence_texts(kinds) | _entry_texts(kinds)
    found = candidate_rows(library.patterns, _CANDIDATE, searched, _present_globals(), part, not prefilter, ALIKE)
    pages = pages.select(*keep, *[c for c in EVIDENCE_TYPES if c not in keep], found.alias("_candidates"))
    candidates = F.col("_candidates")
    odd = reduce(Column.__or__, map(_odd_case, evidence_texts(kinds).values()), F.lit(False))
    fires = bind(odd, lambda is_odd: F.filter(candidates, lambda s: F.when(
        F.lit(prefilter) & s["exact"] & ~is_odd, F.lit(True)).otherwise(_fires(s, kinds))))
    # The condition always holds. What is not deterministic stays in a select of its own; in the argument of the next
    # Python function Spark cannot tell that lambdas in lambdas are the same expression, and leaves the function unevaluated.
    return pages.select(*keep, F.when(F.spark_partition_id() >= 0, F.transform(fires, lambda s: s["row"])).alias("_fired"))


def matched_signatures(pages: DataFrame, library: Library, keep: list[str], prefilter: bool = True,
                       part: int = PART) -> DataFrame:
    """``keep`` columns plus ``matches``, the signatures that match: one row per row of ``pages``."""
    rows = _fired(pages, library, keep, prefilter, part)
    return rows.select(*keep, rows_alike(library.patterns, _MATCH, F.col("_fired"), part, ALIKE).alias("matches"))


def signature_matches(pages: DataFrame, library: Library, ids: list[str], prefilter: bool = True,
                      part: int = PART) -> DataFrame:
    """One row per page and matching signature (M1-M8)."""
    rows = _fired(pages, library, ids, prefilter, part)
    return rows_exploded(rows, library.patterns, ["ord", "tech", "kind", "key", "weight", "label"], "_fired", part, ALIKE)


class _Scores:
    """What summing needs of every signature, as numbers: its technology, order and weight, and whether it is of HTML."""

    def __init__(self, signatures: Store):
        names: dict[str | None, int] = {}

        def techs(table: pa.Table) -> np.ndarray:
            coded = table["tech"].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = [names.setdefault(name, len(names)) for name in coded.dictionary.to_pylist()]
            return np.array(codes, np.int32)[coded.indices.to_numpy()]

        self.tech = signatures.numbers(techs)
        self.nameless = names.get(None, -1)
        self.ord = signatures.numbers(lambda t: t["ord"].to_numpy())
        # a weight that is null makes a sum null, which counts as the highest score
        self.weight = signatures.numbers(lambda t: pc.fill_null(t["weight"], 100).to_numpy())
        self.html = signatures.numbers(lambda t: pc.equal(t["kind"], "html").to_numpy())
        # a technology's signatures lie together, those of HTML first, unless its place in the library is ambiguous
        runs = np.flatnonzero(np.diff(self.tech, prepend=-1))
        self.together = len(runs) == len(names) and not np.any(self.html[1:] & ~self.html[:-1] & (np.diff(self.tech) == 0))


def _page_detections(signatures: Store, scores: _Scores, pages: int, page: np.ndarray, rows: np.ndarray, config: ScanConfig,
                     kind: pa.DataType) -> pa.Array:
    """Scored detections of some pages in rank order, from their matching signatures in library order."""
    if not len(rows):
        return pa.array([[]] * pages, kind)
    tech = scores.tech[rows]
    if not scores.together:
        first_seen = np.lexsort((rows, tech, page))
        page, rows, tech = page[first_seen], rows[first_seen], tech[first_seen]
    html = scores.html[rows]
    new = (np.diff(page, prepend=-1) != 0) | (np.diff(tech, prepend=-1) != 0)
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(rows))
    named = tech[starts] != scores.nameless
    score = np.where(named, np.minimum(np.add.reduceat(scores.weight[rows].astype(np.int64), starts), 100), 0)
    first = rows[starts]
    if config.include_evidence:
        nth = np.cumsum(html)
        listed = ~html | (nth - np.repeat(nth[starts] - html[starts], sizes) <= MAX_HTML_HITS)
        listed &= np.repeat(named, sizes)
    else:
        listed = np.zeros(len(rows), bool)
    order = np.lexsort((np.where(named, scores.ord[first], -1), -score, page[starts]))
    order = order[score[order] >= config.min_confidence]
    places = np.arange(sizes[order].sum()) + np.repeat(starts[order] - np.cumsum(sizes[order]) + sizes[order], sizes[order])
    owner = np.repeat(np.arange(len(order)), sizes[order])
    if not scores.together:
        places = places[np.lexsort((rows[places], ~html[places], owner))]
    kept = listed[places]
    labels = signatures.take(["label"], rows[places[kept]])["label"]
    label_ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(order)))])
    evidence = pa.ListArray.from_arrays(pa.array(label_ends, pa.int32()), labels.chunk(0) if labels.num_chunks else pa.array([], pa.string()))
    facts = signatures.take(["tech", "categories", "is_higher_ed", "description"], first[order])
    columns = {name: facts[name].chunk(0) if facts[name].num_chunks else pa.array([], facts[name].type) for name in facts.column_names}
    columns |= {"confidence": pa.array(score[order], pa.int32()), "evidence": evidence}
    names = [field.name for field in kind.value_type]
    ends = np.concatenate([[0], np.cumsum(np.bincount(page[starts][order], minlength=pages))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([columns[n] for n in names], names=names)).cast(kind)


def _detections(library: Library, fired: Column, config: ScanConfig, part: int) -> Column:
    """Scored detections of a page in rank order, from the tests that fire."""
    paths, columns, alike = tuple(sorted(library.patterns.inputFiles())), tuple(_MATCH), tuple(ALIKE)
    kind = to_arrow_type(_DETECTION)

    def detected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signatures = store(paths, part, alike, columns)
        scores = worker_keeps(("scores", paths, part), lambda: _Scores(signatures), MAPPED)
        for batch in batches:
            if not signatures.tables and len(batch):
                yield pa.array([[]] * len(batch), kind)
                continue
            for pages, page, rows in signatures.expand(batch, _HANDED):
                yield _page_detections(signatures, scores, pages, page, rows, config, kind)

    return F.arrow_udf(detected, _DETECTION)(fired)


def _version(config: ScanConfig) -> Column:
    """Version of a detected technology (M11): a version fact about it, else, if loose, the
    first versioned script of the page, whatever it belongs to."""
    name = F.lower("tech")
    fact = F.filter("_facts", lambda e: F.contains(name, e["key"]) | F.contains(e["key"], name))
    value = none_if_empty(F.get(fact, 0)["value"])
    return F.coalesce(value, F.col("_asset_version")) if config.loose_version else value


def detect(pages: DataFrame, library: Library, ids: list[str], config: ScanConfig = ScanConfig(),
           prefilter: bool = True, part: int = PART) -> DataFrame:
    """Technologies of every page at or above the confidence threshold, ranked per page.

    ``pages`` holds evidence columns (see ``extract_evidence``); ``ids`` name a page and are
    passed through.
    """
    versions = F.transform(F.filter("scripts", lambda s: s["version"] != ""), lambda s: s["version"])
    pages = with_evidence_columns(pages).withColumns(
        {"_facts": F.map_entries("version_info"), "_asset_version": F.get(versions, 0)})
    keep = [*ids, "_facts", "_asset_version"]
    rows = _fired(pages, library, keep, prefilter, part)
    ranked = rows.select(*keep, _detections(library, F.col("_fired"), config, part).alias("_ranked")).select(
        *keep, F.posexplode_outer("_ranked").alias("pos", "d"))
    found = ranked.filter("d is not null").select(
        *keep, (F.col("pos") + 1).alias("rank"), "d.tech", "d.confidence", "d.categories", "d.evidence", "d.is_higher_ed", "d.description")
    return found.select(*ids, "rank", "tech", "confidence", "categories", "evidence",
                        _version(config).alias("version"), "is_higher_ed", "description")
