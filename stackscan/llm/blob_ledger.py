"""Secret scans over versioned files: an incremental ledger of blobs (DataFrame functions only).

Every version of every file is addressed by its content, so a text that occurs in many versions, or at many
paths, is one blob. The ledger is a table in the shared folder: for each blob, the rules that have read it,
each with its version, and the spans they found, blobs without a finding included. A scan takes the distinct
blobs of its input, leaves out the pairs of blob and rule version that the ledger holds, reads only what is
left, appends that as one part, and joins the ledger's findings to all versions.

The texts of unseen blobs travel once, each as one row that was chosen for it; copies send their address
only, reduced map-side. A part is committed by its writer, so a scan that died leaves nothing that counts,
and the next one reads the same pairs again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stackscan.llm.common import fresh_folder, join_hot, stored


@dataclass(frozen=True)
class Rule:
    """What to look for: a pattern, the least length of a group of it, and the version of both.

    ``probe`` is a pattern that every finding's text matches; ``parts`` are texts one of which it holds.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    probe: str | None = None
    parts: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8,
         probe=r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, parts=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, probe=r"[0-9a-f]{32}"),
)
# Published forms of keys that name their issuer or their kind.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", parts=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", parts=("eyJ",)),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", parts=("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", parts=("xox",)),
)
RULES = BASE + MORE

LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


def _holds(rule: Rule, text: Column) -> Column:
    """Whether a text may hold a finding: decided by plain texts where the rule has them."""
    if rule.parts:
        found = F.lit(False)
        for part in rule.parts:
            found = found | F.contains(text, F.lit(part))
        return found
    return F.rlike(text, F.lit(rule.probe or rule.pattern))


def spans_of(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rule, start, end) of every finding in the texts of ``blobs`` (blob, text, todo).

    A rule reads the blobs whose ``todo`` names it. Places are code points, the end exclusive; matches are
    taken from the left and do not overlap. Between n matches lie n + 1 pieces of the text, so places are
    running sums of lengths, one row per match.
    """
    matches = None
    for rule in rules:
        pattern = F.lit(rule.pattern)
        some = blobs.where(F.array_contains("todo", rule.name) & _holds(rule, F.col("text"))).select(
            "blob", F.split("text", rule.pattern, -1).alias("pieces"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"),
            F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("part"))
        sizes = F.zip_with(F.zip_with("whole", "part", lambda w, p: F.struct(F.char_length(w).alias("n"), F.char_length(p).alias("part"))),
                           F.slice("pieces", 1, F.size("whole")), lambda m, p: F.struct(m["n"].alias("n"), m["part"].alias("part"), F.char_length(p).alias("before")))
        rows = some.select("blob", F.lit(rule.name).alias("rule"), F.lit(rule.least).alias("least"), F.posexplode(sizes).alias("at", "m"))
        matches = rows if matches is None else matches.unionByName(rows)
    upto = F.sum(F.col("m.before") + F.col("m.n")).over(Window.partitionBy("blob", "rule").orderBy("at"))
    found = matches.select("blob", "rule", "least", "m.part", (upto - F.col("m.n")).alias("start"), upto.alias("end"))
    return found.where("part >= least").select("blob", "rule", "start", "end")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All committed parts of a ledger; empty where none was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def addressed(versions: DataFrame, path: Sequence[str], text: str = "text") -> DataFrame:
    """``path`` columns, ``blob`` (the SHA-256 of the text) and ``text`` of every row; a null text counts as empty."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(*path, F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("text"))


def scan(versions: DataFrame, folder: str, path: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> int:
    """Reads what the ledger in ``folder`` does not hold yet and appends it; returns how many blobs were read.

    Two scans of one ledger at a time may read a pair twice; the findings stay right, as readers take the
    distinct ones. A changed rule takes a new version number.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = read_ledger(spark, folder).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    rows = addressed(versions, path, text)
    one = rows.groupBy("blob").agg(F.min(F.struct(*path)).alias("one"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = stored(one.join(seen, "blob", "left").select("blob", "one", todo.alias("todo")).where(F.size("todo") > 0), "unseen-blobs")
    if not (n := unseen.count()):
        return 0
    keys = [rows["blob"] == unseen["blob"]] + [rows[c].eqNullSafe(unseen["one"][c]) for c in path]
    # a text that depends on the other side of the join: none is read before its blob is known to be unseen
    text_to_read = F.when(F.size("todo") > 0, rows["text"]).alias("text")
    chosen = rows.join(unseen, keys).select(unseen["blob"], text_to_read, "todo")
    may = F.lit(False)
    for rule in rules:
        may = may | F.array_contains("todo", rule.name) & _holds(rule, F.col("text"))
    # a path that repeats with the same text gives its blob more than once
    spans = spans_of(stored(chosen.where(may).dropDuplicates(["blob"]), "texts-to-scan"), rules)
    lists = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("rule", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    part = unseen.join(lists, "blob", "left").select("blob", F.col("todo").alias("rules"), F.coalesce("spans", none).alias("spans"))
    part.write.mode("append").parquet(folder)
    return n


def findings(versions: DataFrame, folder: str, path: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``path`` columns, ``blob`` and ``spans`` (kind, start, end) of every row of ``versions``, from the ledger.

    Spans lie in the order of their starts, then of the rules. Only findings of the given rules and versions
    count. A blob at very many paths meets its findings once per path salt, not in one task.
    """
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = (read_ledger(versions.sparkSession, folder).select("blob", F.explode("spans").alias("s"))
             .select("blob", F.col("s.start").alias("start"), order[F.col("s.rule")].alias("k"), F.col("s.end").alias("end"))
             .where("k IS NOT NULL").distinct())
    lists = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end"))).alias("spans"))
    named = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")),
                        lambda s: F.struct(F.element_at(kinds, s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = addressed(versions, path, text).drop("text").withColumn("_path", F.xxhash64(*path))
    return join_hot(rows, lists, ["blob"], "_path").select(*path, "blob", named.alias("spans"))


def scanned(versions: DataFrame, path: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES, folder: str | None = None) -> DataFrame:
    """One row per row of ``versions``: its path columns, blob and spans, after a scan into the ledger ``folder``.

    Without a folder a new ledger is begun in the shared folder. Null texts count as empty, rows that repeat
    are returned each, null paths stay null, other columns are left out, and an empty table gives an empty
    result. Long texts are read whole.
    """
    folder = folder or fresh_folder(versions.sparkSession, "blob-ledger")
    scan(versions, folder, path, text, rules)
    return findings(versions, folder, path, text, rules)


def spans_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """Spans as kind:start:end, joined by commas; only those of ``kinds`` where given."""
    some = F.filter(spans, lambda s: s["kind"].isin(list(kinds))) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, through a ledger of its own."""
    found = scanned(docs, ["doc_id"])
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("spans"), [r.kind for r in BASE]), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))
