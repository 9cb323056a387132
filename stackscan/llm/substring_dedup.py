"""Substring de-duplication by hashing lines, cut further at the ends of sentences.

A unit is a sentence within a line. Normalised (lower-cased, white space collapsed) and hashed, units are
grouped over the whole corpus, and each but the earliest occurrence, by (document id, place), is a
repeat. Neighbouring repeats form a run; a run of at least ``min_words`` words is a repeated passage and
is removed, with its offsets in the original text kept. Shorter runs, such as stock phrases, stay.

With ``edges`` a run is first extended at both ends, word by word, as far into the unit next to it as that
agrees with the text next to the earliest occurrence of the run's outermost unit. Runs that then touch are
one passage, and the test by ``min_words`` comes last. So a passage whose first or last sentence is glued to
the text around it goes whole. Only runs that could reach ``min_words`` with the units next to them ask for
that text.

Units travel packed, one row per batch of documents and slice of the digest space. Of equal units in one
batch only the earliest takes part in the grouping; the others are known to be repeats at once, so a
unit that a third of all documents share meets the grouping once per batch, not once per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import join_hot, stored

MIN_WORDS = 50
#: Characters of text that a batch of units is made from.
BATCH_CHARACTERS = 8_000_000
#: A unit ends at a line break, or at white space after a full stop, an exclamation or a question mark.
_UNIT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|$)", re.MULTILINE)
_FIELDS = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("doc", "<i4"), ("unit", "<i4"), ("start", "<i4"), ("end", "<i4"), ("words", "<i4"),
                    ("left", "<u2"), ("right", "<u2"), ("many", "u1")])
_MOST = np.iinfo("<u2").max
_CHUNK = "key int, units binary, ids binary, texts binary"
_REPEAT = ("doc_id bigint, text_hash bigint, unit int, start int, end int, words int, left int, right int, "
           "of_id bigint, of_hash bigint, of_unit int, many boolean")
_RUN = ("doc_id bigint, text_hash bigint, first int, last int, start int, end int, words int, "
        "ends array<struct<of_id:bigint,of_hash:bigint,of_unit:int,need:int>>")
_WORD = re.compile(r"\S+")


def units_of(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised bytes, words) of every unit that holds a word, in order."""
    found = []
    for m in _UNIT.finditer(text):
        words = m.group().lower().split()
        if words:
            start = m.end() - len(m.group().lstrip())
            found.append((start, m.end(), " ".join(words).encode(), len(words)))
    return found


def _batches(rows: Iterator[pa.RecordBatch], characters: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) with about ``characters`` characters each, at least one text."""
    ids, texts, size = [], [], 0
    for batch in rows:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= characters:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).view(np.int64))


_NO_ID = int(np.iinfo(np.int64).min)


def _packed(units: np.ndarray) -> bytes:
    """The records with equal bytes of all of them side by side, which compresses better."""
    return np.ascontiguousarray(units).view(np.uint8).reshape(-1, _FIELDS.itemsize).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(_FIELDS.itemsize, -1).T.copy().view(_FIELDS).ravel()


def _repeats(ids, texts, units, of_doc, of_unit) -> pa.RecordBatch:
    """Rows of ``_REPEAT`` for records whose ``doc``, like ``of_doc``, points into ids and texts."""
    doc = units["doc"]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc]), pa.array(texts[doc]), *(pa.array(units[c].astype(np.int32)) for c in ("unit", "start", "end", "words", "left", "right")),
         pa.array(ids[of_doc]), pa.array(texts[of_doc]), pa.array(of_unit.astype(np.int32)), pa.array(units["many"] > 0)],
        names=["doc_id", "text_hash", "unit", "start", "end", "words", "left", "right", "of_id", "of_hash", "of_unit", "many"])


def _sorted(units, ids, texts):
    """Records by digest, then by (document id, text hash, unit), each once; which repeat one before, and the place of the first of their kind."""
    doc = units["doc"]
    order = np.lexsort((units["unit"], texts[doc], ids[doc], units["lo"], units["hi"]))
    units, doc = units[order], doc[order]
    again = np.zeros(len(units), bool)
    again[1:] = (units["hi"][1:] == units["hi"][:-1]) & (units["lo"][1:] == units["lo"][:-1])
    twin = np.zeros(len(units), bool)  # the same unit of a document whose row is repeated
    twin[1:] = again[1:] & (ids[doc[1:]] == ids[doc[:-1]]) & (texts[doc[1:]] == texts[doc[:-1]]) & (units["unit"][1:] == units["unit"][:-1])
    many = units["many"][~twin]
    np.maximum.at(many, (np.cumsum(~twin) - 1)[twin], units["many"][twin])
    units, again = units[~twin], again[~twin]
    units["many"] = many
    return units, again, np.maximum.accumulate(np.where(again, 0, np.arange(len(units))))


def repeated_units(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Every unit that is not the earliest of its kind: doc_id, text_hash, unit, start, end, words; left and right,
    the words of the units next to it; of_id, of_hash and of_unit, an earlier one of its kind; and ``many``.

    The earlier one is the earliest of all or, for a repeat within a batch, the earliest there, whose own row
    (if it is a repeat, too) is marked ``many``. Rows that repeat id and text count as one document. Without an id a
    document ranks first, as the smallest number. ``slices`` is the number of slices of the digest space, by
    default four per shuffle partition.
    """
    spark = docs.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_ids, own_texts in _batches(rows, BATCH_CHARACTERS):
            ids = np.array([_NO_ID if i is None else i for i in own_ids], np.int64)
            texts = np.array([_hash(t) for t in own_texts], np.int64)
            records, seen = [], set()
            for d, text in enumerate(own_texts):
                if (ids[d], texts[d]) in seen:
                    continue
                seen.add((ids[d], texts[d]))
                found = units_of(text)
                sizes = [0, *(min(words, _MOST) for _, _, _, words in found), 0]
                for u, (start, end, norm, words) in enumerate(found):
                    digest = xxhash.xxh3_128_intdigest(norm)
                    records.append((digest >> 64, digest & 0xFFFFFFFFFFFFFFFF, d, u, start, end, words, sizes[u], sizes[u + 2], 0))
            units, again, earliest = _sorted(np.array(records, _FIELDS), ids, texts)
            units["many"][earliest[again]] = 1
            known, of = units[again], units[earliest[again]]
            known["hi"], known["lo"], known["many"] = of["doc"], of["unit"], 0  # the digests have done their work
            out = [(slices + int(texts[0]) % slices, known, ids, texts)] if again.any() else []
            first = units[~again]
            key = ((first["hi"] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
            for k, some in zip(*_split(key, first)):
                docs_in, doc = np.unique(some["doc"], return_inverse=True)
                some["doc"] = doc
                out.append((int(k), some, ids[docs_in], texts[docs_in]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()),
                 pa.array([_packed(o[1]) for o in out], pa.binary()),
                 *(pa.array([o[c].tobytes() for o in out], pa.binary()) for c in (2, 3))], names=["key", "units", "ids", "texts"])

    def group(table: pa.Table) -> pa.Table:
        parts, ids, texts, base = [], [], [], 0
        known = table["key"][0].as_py() >= slices
        for row in table.select(["units", "ids", "texts"]).to_pylist():
            units = _unpacked(row["units"])
            units["doc"] += base
            if known:
                units["hi"] += np.uint64(base)
            ids.append(np.frombuffer(row["ids"], np.int64))
            texts.append(np.frombuffer(row["texts"], np.int64))
            base += len(ids[-1])
            parts.append(units)
        units, ids, texts = np.concatenate(parts), np.concatenate(ids), np.concatenate(texts)
        if known:
            return pa.Table.from_batches([_repeats(ids, texts, units, units["hi"].astype(np.int64), units["lo"])])
        units, again, earliest = _sorted(units, ids, texts)
        of = units[earliest[again]]
        return pa.Table.from_batches([_repeats(ids, texts, units[again], of["doc"], of["unit"])])

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _CHUNK)
    return packed.groupBy("key").applyInArrow(group, _REPEAT)


def _split(key: np.ndarray, rows: np.ndarray):
    """(keys, rows of each key); ``rows`` come sorted by key."""
    keys, at = np.unique(key, return_index=True)
    return keys, np.split(rows, at[1:])


def _runs(units: list[tuple]) -> list[list[tuple]]:
    """Repeats (unit, ...) in order, neighbours together; one of several for the same unit."""
    runs: list[list[tuple]] = []
    for _, unit in sorted({u[0]: u for u in units}.items()):
        if runs and unit[0] == runs[-1][-1][0] + 1:
            runs[-1].append(unit)
        else:
            runs.append([unit])
    return runs


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans.

    White space around a removed passage goes with it, but for one line break if it held one, else one
    space; at either end of the text all of it goes.
    """
    if not spans:
        return text
    kept_parts, at = [], 0
    for start, end in [*spans, (len(text), len(text))]:
        kept_parts.append(text[at:start])
        at = end
    out = kept_parts[0]
    for part in kept_parts[1:]:
        left, right = out.rstrip(), part.lstrip()
        gap = out[len(left):] + part[:len(part) - len(right)]
        out = left + ("\n" if "\n" in gap else " " if gap else "") + right if left and right else left + right
    return out


def remove_spans(text: str, units: list[tuple[int, int, int, int]], min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without its repeated passages, and their (start, end), given repeats (unit, start, end, words)."""
    spans = [(run[0][1], run[-1][2]) for run in _runs(units) if sum(u[3] for u in run) >= min_words]
    return _without(text, spans), spans


def _common(a: list[str], b: list[str]) -> int:
    """How many words two lists have in common from their start on."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def extended_spans(text: str, runs: list[tuple[int, int, int, int, int]], near: dict[tuple[int, bool], list[str]], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the repeated passages, given runs (first unit, last unit, start, end, words) and, by (first unit,
    whether on the left), the normalised words next to the earliest occurrence."""
    units = units_of(text) if near else []
    spans: list[list[int]] = []
    for first, last, start, end, words in sorted(runs):
        if n := near and first and _common(units[first - 1][2].decode().split()[::-1], near.get((first, True), [])[::-1]):
            at = units[first - 1][0]
            start = at + [m.start() for m in _WORD.finditer(text[at:units[first - 1][1]])][-n]
            words += n
        if n := near and last + 1 < len(units) and _common(units[last + 1][2].decode().split(), near.get((first, False), [])):
            at = units[last + 1][0]
            end = at + [m.end() for m in _WORD.finditer(text[at:units[last + 1][1]])][n - 1]
            words += n
        if spans and not text[spans[-1][1]:start].strip():
            start, end = spans[-1][0], max(end, spans[-1][1])
            spans[-1] = [start, end, len(text[start:end].split())]
        else:
            spans.append([start, end, words])
    return [(start, end) for start, end, words in spans if words >= min_words]


def runs_of(repeats: DataFrame, min_words: int, edges: bool) -> DataFrame:
    """The runs of every document, as rows of ``_RUN``. ``ends`` says next to which units text is asked for, and how many
    words, at most twice those that can agree: before the unit if negative, else after it."""

    def ends_of(run: list[tuple]) -> list[dict]:
        found = []
        for unit, sign, words in ((run[0], -1, run[0][4]), (run[-1], 1, run[-1][5])):
            if words:
                # _MOST stands for any number of words from there on
                need = 1 << 30 if words == _MOST else 1 << (words - 1).bit_length()
                found.append({"of_id": unit[6], "of_hash": unit[7], "of_unit": unit[8], "need": sign * need})
        return found

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text_hash, units in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["units"]):
                runs = _runs([tuple(u.values()) for u in units.as_py()])
                chains: list[list[list[tuple]]] = []  # runs that could come to touch
                for run in runs:
                    if chains and run[0][0] == chains[-1][-1][-1][0] + 2:
                        chains[-1].append(run)
                    else:
                        chains.append([run])
                for chain in chains:
                    reach = sum(u[3] for run in chain for u in run) + sum(run[0][4] + run[-1][5] for run in chain)
                    for run in chain:
                        out.append((doc_id, text_hash, run[0][0], run[-1][0], run[0][1], run[-1][2], sum(u[3] for u in run),
                                    ends_of(run) if edges and reach >= min(min_words, _MOST) else []))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.list_(pa.struct([("of_id", pa.int64()), ("of_hash", pa.int64()), ("of_unit", pa.int32()), ("need", pa.int32())]))]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "text_hash", "first", "last", "start", "end", "words", "ends"])

    by_doc = repeats.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("unit", "start", "end", "words", "left", "right", "of_id", "of_hash", "of_unit")).alias("units"))
    return by_doc.mapInArrow(join_up, _RUN)


_SOURCE = ["of_id", "of_hash", "of_unit"]


def _near(rows: DataFrame, repeats: DataFrame, runs: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, text_hash, first, need, near): the text that the ends of runs ask for. ``rows`` has row, id and h."""
    links = repeats.where("many").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("unit").alias("of_unit"),
                                         *[F.col(c).alias(f"to_{c}") for c in _SOURCE])
    asked = runs.select("doc_id", "text_hash", "first", F.explode("ends").alias("e")).select("doc_id", "text_hash", "first", "e.*")
    ends = asked.join(links, _SOURCE, "left").select(
        "doc_id", "text_hash", "first", "need", *[F.coalesce(f"to_{c}", c).alias(c) for c in _SOURCE])
    # the earliest occurrence itself stays whole where its own repeat follows it
    ends = ends.where(~((F.col("need") < 0) & (F.col("of_id") == F.col("doc_id")) & (F.col("of_hash") == F.col("text_hash"))
                        & (F.col("of_unit") == F.col("first") - 1)))
    wanted = ends.groupBy("of_id", "of_hash").agg(F.collect_set(F.struct("of_unit", "need")).alias("wanted"))
    asked_of = rows.join(wanted, (F.col("id") == F.col("of_id")) & (F.col("h") == F.col("of_hash"))).select("row", "of_id", "of_hash", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, of_id, of_hash, some in zip(batch["row"].field(text_col), batch["of_id"].to_pylist(), batch["of_hash"].to_pylist(), batch["wanted"].to_pylist()):
                words = [norm.decode().split() for _, _, norm, _ in units_of(text.as_py() or "")]
                for w in some:
                    unit, need = w["of_unit"], w["need"]
                    found: list[str] = []
                    at = unit + (1 if need > 0 else -1)
                    while 0 <= at < len(words) and len(found) < abs(need):
                        found = found + words[at] if need > 0 else words[at] + found
                        at += 1 if need > 0 else -1
                    if found:
                        out.append((of_id, of_hash, unit, need, " ".join(found[:need] if need > 0 else found[need:])))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                                             names=[*_SOURCE, "need", "near"])

    texts = asked_of.mapInArrow(read, "of_id bigint, of_hash bigint, of_unit int, need int, near string").dropDuplicates([*_SOURCE, "need"])
    return join_hot(ends, texts, [*_SOURCE, "need"], "text_hash", how="inner").select("doc_id", "text_hash", "first", "need", "near")


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id",
                    slices: int | None = None, edges: bool = False) -> DataFrame:
    """(row, text, removed, n_removed) of every row: the row as it was, the text without repeated passages, the
    removed (start, end) in code points of the original text, and how many there are.

    ``edges`` extends runs into the units next to them. A null text stays null. Rows that repeat id and text
    are one document and all get the same result. Documents without an id rank first, by the hash of their
    text. A text may end up empty. An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeats = stored(repeated_units(named, slices), "repeated-units")
    runs = stored(runs_of(repeats, min_words, edges), "repeated-runs")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"))
    parts = runs.select("doc_id", "text_hash", "first", "last", "start", "end", "words", F.lit(None).cast("int").alias("need"), F.lit(None).cast("string").alias("near"))
    if edges:
        parts = parts.unionByName(_near(rows, repeats, runs, text_col), allowMissingColumns=True)
    by_doc = parts.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first", "last", "start", "end", "words", "need", "near")).alias("parts"))
    joined = rows.join(by_doc, (F.col("id") == F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left").select("row", "parts")
    kind = joined.schema["row"].dataType.simpleString()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, parts in zip(batch["row"].field(text_col), batch["parts"]):
                text, parts = text.as_py(), parts.as_py()
                spans: list[tuple[int, int]] = []
                if text and parts:
                    spans = extended_spans(text, [(p["first"], p["last"], p["start"], p["end"], p["words"]) for p in parts if p["need"] is None],
                                           {(p["first"], p["need"] < 0): p["near"].split() for p in parts if p["need"] is not None}, min_words)
                    text = _without(text, spans)
                texts.append(text)
                removed.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array([len(r) for r in removed], pa.int32())], names=["row", "text", "removed", "n_removed"])

    return joined.mapInArrow(rewrite, f"row {kind}, text string, removed array<struct<start:int,end:int>>, n_removed int")
