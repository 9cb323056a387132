"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document is the set of its distinct shingles. Documents with equal sets form a class, and classes are
the rows of the matrix. The matrix is cut into blocks by slices of the shingles' hashes. A block counts how
many classes hold each of its shingles; a shingle of a single class adds to no product and leaves. What
is left of a class, its shared shingles, holds every overlap it can have.

Shingles are ordered by (number of classes, place), the rare ones first. For sets of n and m shingles to
link, they must share at least 3 (n + m) / 7. So the first shingle they share stands so early in both
that enough shingles are left behind it in either; pairs that meet later, or whose sizes differ too
much, are discarded. The other pairs' products are accumulated over all shared shingles: the exact
overlap.

A group of near copies does not make all its pairs. First the classes that meet at a shingle are paired
with one of them only, the hub, and linked ones are joined into components. Then only pairs of different
components are left to be tried. That tries every pair that may link and is not joined already, so the
components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import join_hot, kept, stored
from stackscan.llm.components import components
from stackscan.llm.token_ids import MEMO, _Memo

WIDTH = 5
#: Characters of text that a batch of matrix rows is made from, and the most documents in it.
BATCH_CHARACTERS, BATCH_DOCS = 8_000_000, 60_000
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Hashes of a text's distinct shingles; remembers the hashes of words, up to a bound."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, _Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending 64-bit hashes; the whole sequence is one shingle if it is shorter, none without words."""
        if len(self.words) > MEMO:
            self.words.clear()
        words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(w))
        n = len(w) - width + 1
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * _MIX + w[k:k + n]
        h = (h ^ (h >> np.uint64(32))) * _LAST
        return np.unique(h ^ (h >> np.uint64(32)))


_SHINGLERS: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    return _SHINGLERS.setdefault(width, Shingler(width))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    name = np.array([xxhash.xxh3_128_intdigest(shingles.tobytes()) & 0xFFFFFFFFFFFFFFFF, xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64)
    return tuple(name.view(np.int64).tolist())


INFO = "doc_id bigint, n int, set_id bigint, check bigint"


def document_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (shingles), set_id and check (names of the set; null for an empty one) of every row."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(width)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch["text"]]
            names = [class_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int32()), pa.array([x[0] for x in names], pa.int64()),
                 pa.array([x[1] for x in names], pa.int64())], names=["doc_id", "n", "set_id", "check"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(named, INFO)


def _planes(values: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane: the upper planes of ascending values compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


_CHUNK = "slice int, entries binary, owner binary, sets binary, sizes binary"


def _chunks(slices: list[tuple[int, np.ndarray, np.ndarray]], sets: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Packed rows from (slice, entries, owners), owners pointing into sets and sizes."""
    out = []
    for k, entries, owner in slices:
        used, own = np.unique(owner, return_inverse=True)
        out.append((int(k), _planes(entries), own.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes(),
                    sets[used].astype("<i8").tobytes(), sizes[used].astype("<i4").tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*out)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["slice", "entries", "owner", "sets", "sizes"])


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, sets, sizes) of all packed rows, one of each per entry."""
    entries, sets, sizes = [], [], []
    for row in table.select(["entries", "owner", "sets", "sizes"]).to_pylist():
        names, n = np.frombuffer(row["sets"], "<i8"), np.frombuffer(row["sizes"], "<i4")
        owner = np.frombuffer(row["owner"], "<u2" if len(names) < 1 << 16 else "<u4")
        entries.append(_values(row["entries"]))
        sets.append(names[owner])
        sizes.append(n[owner])
    return np.concatenate(entries), np.concatenate(sets), np.concatenate(sizes)


def _cut(at: np.ndarray, *arrays: np.ndarray):
    """The arrays cut where ``at``, which ascends, changes: (value, part, part, ...)."""
    values, first = np.unique(at, return_index=True)
    return zip(values, *(np.split(a, first[1:]) for a in arrays))


def shared_shingles(docs: DataFrame, width: int = WIDTH, slices: int | None = None) -> DataFrame:
    """(set_id, n, shared) of the classes that may link: ``shared`` holds, in order, the numbers of the
    shingles that other classes hold too; equal shingles have equal numbers.

    ``slices`` is the number of blocks, by default two per shuffle partition; a block is held in memory.
    """
    slices = slices or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, waiting, size = shingler(width), {}, 0

        def flush() -> pa.RecordBatch:
            sets = list(waiting.values())
            names, sizes = np.array(list(waiting), np.int64), np.array([len(s) for s in sets], np.int32)
            entries, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(entries, kind="stable")
            entries, owner = entries[order], owner[order]
            at = ((entries >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
            return _chunks(list(_cut(at, entries, owner)), names, sizes)

        for batch in batches:
            for text in batch["text"]:
                text = text.as_py()
                found = shingles(text)
                if len(found):
                    waiting[class_of(found)[0]] = found
                    size += len(text)
                if size >= BATCH_CHARACTERS or len(waiting) >= BATCH_DOCS:
                    yield flush()
                    waiting, size = {}, 0
        if waiting:
            yield flush()

    def block(table: pa.Table) -> pa.Table:
        entries, sets, sizes = _gathered(table)
        order = np.lexsort((sets, entries))
        entries, sets, sizes = entries[order], sets[order], sizes[order]
        once = np.ones(len(entries), bool)
        once[1:] = (entries[1:] != entries[:-1]) | (sets[1:] != sets[:-1])
        entries, sets, sizes = entries[once], sets[once], sizes[once]
        _, column, held = np.unique(entries, return_inverse=True, return_counts=True)
        shared = held[column] > 1
        if (len(held) >> 28) or (slices >> 20):
            raise ValueError("more blocks are needed, or fewer")
        number = (np.minimum(held[column], 0x7FFF) << 48) | (table["slice"][0].as_py() << 28) | column
        number, sets, sizes = number[shared].astype(np.uint64), sets[shared], sizes[shared]
        order = np.lexsort((number, sets))
        number, sets, sizes = number[order], sets[order], sizes[order]
        at = ((sets.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        parts = []
        for k, some, own, n in _cut(at, number, sets, sizes):
            names, first, owner = np.unique(own, return_index=True, return_inverse=True)
            by_number = np.argsort(some, kind="stable")
            parts.append(_chunks([(k, some[by_number], owner[by_number])], names, n[first]))
        return pa.Table.from_batches(parts, parts[0].schema if parts else _chunks([], sets, sizes).schema)

    def classes(table: pa.Table) -> pa.Table:
        number, sets, sizes = _gathered(table)
        order = np.lexsort((number, sets))
        number, sets, sizes = number[order].astype(np.int64), sets[order], sizes[order]
        names, first, m = np.unique(sets, return_index=True, return_counts=True)
        n = sizes[first].astype(np.int64)
        # shingles of the prefix that others share: those before them are the class's own
        use = n - (3 * n + 3) // 4 + 1 - (n - m) > 0
        offsets = np.concatenate([[0], np.cumsum(m[use])])
        return pa.table({"set_id": pa.array(names[use]), "n": pa.array(n[use].astype(np.int32)),
                         "shared": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number[np.repeat(use, m)]))})

    blocks = docs.select("text").mapInArrow(rows, _CHUNK).groupBy("slice").applyInArrow(block, _CHUNK)
    return blocks.groupBy("slice").applyInArrow(classes, "set_id bigint, n int, shared array<bigint>")


def _needed(n: Column, m: Column) -> Column:
    """Shingles that sets of n and m must share to link."""
    return F.floor((3 * (n + m) + 6) / F.lit(7))


def _may_link(left: str, right: str) -> Column:
    """Enough shingles are left in both from the one on at which they meet."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    rest = F.least(n - F.col(f"{left}pos"), m - F.col(f"{right}pos"))
    return rest >= _needed(n, m)


def _prefixed(df: DataFrame, prefix: str, *names: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in names]


def _links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose accumulated product reaches the bound."""
    left = pairs.join(classes.select(F.col("set_id").alias("a"), F.col("n").alias("an"), F.col("shared").alias("as")), "a")
    both = join_hot(left, classes.select(F.col("set_id").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bs")), ["b"], "a", 64, "inner")
    product = F.size(F.array_intersect("as", "bs"))
    return both.where(product >= _needed(F.col("an"), F.col("bn"))).select("a", "b")


def linked_sets(classes: DataFrame) -> DataFrame:
    """(vertex, component) of the classes that link with another one."""
    n, m = F.col("n"), F.size("shared")
    prefix = (n - F.floor((3 * n + 3) / 4) + 1 - (n - m)).cast("int")
    places = kept(classes.select("set_id", "n", (n - m).alias("own"), F.posexplode_outer(F.slice("shared", F.lit(1), prefix)).alias("k", "at"))
                  .select("at", "set_id", "n", (F.col("own") + F.col("k")).alias("pos")))
    hub = F.min(F.struct((F.col("pos") / F.col("n")).alias("part"), "set_id", "n", "pos")).alias("h")
    hubs = places.groupBy("at").agg(hub, F.count("*").alias("size")).where("size > 1").select(
        "at", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("set_id", "n", "pos")])
    met = kept(join_hot(places, hubs, ["at"], "set_id", 64, "inner"))
    first = met.where((F.col("set_id") != F.col("hset_id")) & _may_link("", "h")).select(
        F.col("set_id").alias("a"), F.col("hset_id").alias("b")).distinct()
    near = kept(_links(first, classes))
    joined = components(near)

    def with_component(df: DataFrame, column: str, name: str) -> DataFrame:
        named = joined.select(F.col("vertex").alias(column), F.col("component").alias("_c"))
        return join_hot(df, named, [column], "at", 64).withColumn(name, F.coalesce("_c", column)).drop("_c")

    placed = kept(with_component(with_component(met, "set_id", "c"), "hset_id", "hc"))
    apart = placed.where("c != hc").select("at", *_prefixed(placed, "l", "set_id", "n", "pos", "c"))
    rest = (apart.join(placed.select("at", "set_id", "n", "pos", "c"), "at")
            .where((F.col("lc") != F.col("c")) & _may_link("l", ""))
            .select(F.least("lset_id", "set_id").alias("a"), F.greatest("lset_id", "set_id").alias("b"),
                    F.when(F.col("lset_id") < F.col("set_id"), F.col("lc")).otherwise(F.col("c")).alias("ac"),
                    F.when(F.col("lset_id") < F.col("set_id"), F.col("c")).otherwise(F.col("lc")).alias("bc")).distinct())
    rest = kept(rest)
    late = _links(rest.select("a", "b"), classes).join(rest, ["a", "b"]).select(F.col("ac").alias("a"), F.col("bc").alias("b"))
    merged = components(late).select(F.col("vertex").alias("component"), F.col("component").alias("into"))
    named = joined.union(merged.select("component", "component")).distinct()
    return join_hot(named, merged, ["component"], "vertex", 64).select("vertex", F.coalesce("into", "component").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, slices: int | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Two documents link at a Jaccard similarity of 0.75 or more of their sets of lower-cased (A-Z) word
    shingles; a text of fewer words than ``width`` is one shingle, one without words or a null text has
    none and links with nothing. Rows without an id take part, but never name a component; where no row
    of a component has one, its name is null. Rows with equal ids are separate documents. An empty table
    gives an empty result. Equal names of different sets raise an error rather than join them.
    """
    info = kept(document_sets(docs, width))
    sets = info.where("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("lowest"), F.count("*").alias("rows"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    sets = sets.select("set_id", "lowest", "rows", F.when(F.col("c0") != F.col("c1"), F.raise_error(F.lit("two sets share a name")).cast("int")).alias("bad"))
    classes = stored(shared_shingles(docs, width, slices), "shared-shingles")
    linked = kept(linked_sets(classes))
    grouped = kept(sets.where("bad IS NULL").join(linked, F.col("set_id") == F.col("vertex"), "left")
                   .where("rows > 1 OR vertex IS NOT NULL").select("set_id", "lowest", F.coalesce("component", "set_id").alias("component")))
    names = grouped.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_set = join_hot(grouped, names, ["component"], "set_id", 64).select("set_id", F.lit(True).alias("grouped"), "component_id")
    return join_hot(info, by_set, ["set_id"], "doc_id").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that name their component, so one of each; rows without words or id stay."""
    found = near_duplicates(docs, width).where("doc_id != component_id").select(F.col("doc_id").alias("_near")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(found, F.col("id") == F.col("_near"), "left_anti").select("row.*")
