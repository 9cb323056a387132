"""Candidate signatures of a page: which of many patterns can possibly match it.

Testing every pattern on every page costs (text size x number of patterns). Instead every pattern
states conditions: a match contains, for each of some terms, one of the term's literals (or the
evidence has the key the pattern looks up; keys and values of headers, meta tags, ... are searched
together, so a pattern on a value states its literals, too). A table of all literals by their first bytes
reads a page's text once; a pattern whose rarest term occurs and whose other terms do, too, is a candidate, and only
candidates are then tested by the real regular expression. The step can only name too many
candidates, never too few.

The patterns are a table in the shared folder, written in order. Neither the driver nor the plan holds
them: a worker reads the table's files, makes arrays of numbers of each part of bounded size, and keeps the
parts it used last; what a candidate carries lies in a mapped file. How rare a term is, it learns from
the pages it has read. A worker lower-cases a bounded number of letters at a time (a page at least), remembers of the
candidates of a batch only their numbers, four bytes each and a bounded number of them, and hands them over a few pages
at a time. Patterns that test the same thing can be searched for once a part and made all of them again later.
"""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from stackscan.functions.workers import worker_keeps

# Patterns in one part, and parts a worker keeps: they bound its memory. Rows of a file of patterns.
PART, PARTS_KEPT, FILE_ROWS = 1 << 19, 8, 20_000
# Letters a text is searched in at a time, letters and pairs of page and condition a part looks at together.
SEGMENT, LETTERS, PAIRS = 1 << 17, 1 << 20, 1 << 21
# Candidates whose numbers a worker holds (those of one page always), candidates it hands over at a time
# (as before, a page at least), and libraries whose mapped files it keeps.
NUMBERS, HANDED, MAPPED = 1 << 25, 1 << 14, 4
# Pages after which, and after four times which, a part orders its terms anew by how often they occurred.
LEARN = 32
#: What makes a pattern a candidate: one of these, each a text's name (or "key") and the terms that must all occur.
WANTED = "array<struct<where:string,terms:array<array<string>>>>"


def key_trigger(kind: str, key: str) -> str:
    return f"{kind}\x01{key}"


def entry_mark(key: str) -> str:
    """How an entry of this key begins in an ``entry_text``, in lower case."""
    return f"\x01{key}\x02".lower()


def entry_text(entries: Column, key: str = "key", value: str = "value") -> Column:
    """An array of (key, value) structs as one text, in which keys and values can be searched for together."""
    return F.concat_ws("", F.transform(entries, lambda e: F.concat(
        F.lit("\x01"), F.coalesce(e[key], F.lit("")), F.lit("\x02"), F.coalesce(e[value].cast("string"), F.lit("")))))


def entry_conditions(where: str, key: str, branches: list[list[tuple[str, ...]]]) -> list[dict]:
    """What a pattern wants that is tested on the value of ``key``: the key, and what every match of the value holds."""
    return [{"where": where, "terms": [[entry_mark(key)], *map(list, terms)]} for terms in branches or [[]]]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or under the
    warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_patterns(patterns: DataFrame, order: list[str], place: str) -> DataFrame:
    """``patterns`` written in their order, with ``place``, a number that increases in that order.

    The sort is by ranges and the files are cut at ``FILE_ROWS`` rows, so no task holds the whole. The table
    must have a column ``wanted``.
    """
    spark = patterns.sparkSession
    folder = shared_folder(spark, "patterns")
    rows = patterns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one start after the other."""
    counts = counts.astype(np.int64)
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, one after the other, and where each begins and the last ends."""
    values = values.cast(pa.large_string())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0]:ends[-1]], ends - ends[0]


class Literals:
    """Different literals, found in texts by their first 1, 2, 4 or 8 bytes, then by all of them.

    Numbers in arrays throughout, some 40 bytes a literal; a text is read once, whatever their number.
    """

    def __init__(self, values: pa.Array):
        data, at = _flat(values)
        self.data, self.at, length = data.copy(), at[:-1].copy(), np.diff(at)
        self.known: dict[int, list[tuple]] = {}
        self.tables: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size in np.unique(length[length > 0]).tolist():
            numbers = np.flatnonzero(length == size).astype(np.int32)
            # up to 8 bytes are a number themselves; of longer ones the factor is chosen so that no two agree
            factor = 256 if size <= 8 else 0x9E3779B97F4A7C15
            keys = self._keys(self.data, self.at[numbers], size, factor)
            while size > 8 and len(np.unique(keys)) < len(keys):
                factor = (factor * 6364136223846793005 + 2) % 2**64
                keys = self._keys(self.data, self.at[numbers], size, factor)
            order = np.argsort(keys)
            self.known.setdefault(min(8, 1 << (size.bit_length() - 1)), []).append((size, factor, keys[order], numbers[order]))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        for width, sizes in self.known.items():
            begins = np.unique(self._keys(padded, np.concatenate([self.at[n] for _, _, _, n in sizes]), width, 256, little=True))
            bits = min(23, max(12, int(len(begins) * 64).bit_length()))
            there = np.zeros(1 << bits, bool)
            there[self._slots(begins, bits)] = True
            self.tables[width] = bits, there, begins

    @staticmethod
    def _keys(data: np.ndarray, at: np.ndarray, size: int, factor: int, little: bool = False) -> np.ndarray:
        keys = np.zeros(len(at), np.uint64)
        for i in reversed(range(size)) if little else range(size):
            keys *= np.uint64(factor)
            keys += data[at + i]
        return keys

    @staticmethod
    def _slots(begins: np.ndarray, bits: int) -> np.ndarray:
        return (begins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where literals occur in a text of bytes, their lengths and their numbers."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        text = np.concatenate([text, np.zeros(8, np.uint8)])
        for start in range(0, len(text) - 8, SEGMENT):
            part = text[start:start + SEGMENT + 7]
            windows = {1: part[:SEGMENT]}
            windows[2] = part[:-1] | part[1:].astype(np.uint16) << np.uint16(8)
            if 4 in self.tables or 8 in self.tables:
                windows[4] = windows[2][:-2] | windows[2][2:].astype(np.uint32) << np.uint32(16)
            if 8 in self.tables:
                windows[8] = windows[4][:-4] | windows[4][4:].astype(np.uint64) << np.uint64(32)
            for width, (bits, there, begins) in self.tables.items():
                window = windows[width][:SEGMENT]
                places = np.flatnonzero(there[self._slots(window, bits)])
                seen = window[places].astype(np.uint64)
                places = places[begins[np.minimum(np.searchsorted(begins, seen), len(begins) - 1)] == seen] + start
                for size, factor, keys, numbers in self.known[width]:
                    at = places[:np.searchsorted(places, len(text) - 8 - size, "right")]
                    if not len(at):
                        continue
                    wanted = self._keys(text, at, size, factor)
                    which = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = np.flatnonzero(keys[which] == wanted)
                    at, number = at[hit], numbers[which[hit]]
                    if size > 8:
                        same = np.ones(len(at), bool)
                        for i in range(size):
                            same &= text[at + i] == self.data[self.at[number] + i]
                        at, number = at[same], number[same]
                    found.append((at, np.full(len(at), size), number))
        return tuple(map(np.concatenate, zip(*found)))


class Part:
    """Some patterns: what makes each of them a candidate. Arrays of numbers, whatever the patterns' number."""

    def __init__(self, wanted: list | pa.Array):
        if isinstance(wanted, list):
            wanted = pa.array(wanted, pa.list_(pa.struct([("where", pa.string()), ("terms", pa.list_(pa.list_(pa.string())))])))
        self.size = len(wanted)
        row_of = pc.list_parent_indices(wanted).to_numpy()
        ways = wanted.flatten()
        where, lists = pc.struct_field(ways, "where"), pc.struct_field(ways, "terms")
        way_of = pc.list_parent_indices(lists).to_numpy()
        terms = lists.flatten()
        term_of, literals = pc.list_parent_indices(terms).to_numpy(), terms.flatten()
        sizes = np.bincount(way_of, minlength=len(ways))
        by_key = pc.equal(where, "key").to_numpy(zero_copy_only=False)
        self.by_key: dict[str, list[int]] = {}
        keyed = np.flatnonzero(by_key)
        firsts = np.searchsorted(way_of[term_of], keyed)
        for key, row in zip(literals.take(pa.array(firsts)).to_pylist(), row_of[keyed].tolist()):
            self.by_key.setdefault(key, []).append(row)
        places = pc.dictionary_encode(where)
        place = places.indices.to_numpy()
        self.always: dict[str, np.ndarray] = {}
        self.literals: dict[str, tuple[int, Literals]] = {}
        numbers, self.count = np.zeros(len(literals), np.int64), 0
        lengths = [np.zeros(0, np.int64)]
        for i, name in enumerate(places.dictionary.to_pylist()):
            if name == "key":
                continue
            if len(rows := row_of[(place == i) & (sizes == 0)]):
                self.always[name] = rows
            if len(held := np.flatnonzero(place[way_of[term_of]] == i)):
                different = literals.take(pa.array(held)).dictionary_encode()
                numbers[held] = self.count + different.indices.to_numpy()
                self.literals[name] = self.count, Literals(different.dictionary)
                self.count += len(different.dictionary)
                lengths.append(pc.utf8_length(different.dictionary).to_numpy())
        self.length = np.concatenate(lengths).astype(np.int32)
        # the conditions: rows, and for each its terms, and for each of these its literals
        kept = ~by_key & (sizes > 0)
        kept_terms = kept[way_of]
        self.row = row_of[kept].astype(np.int32)
        self.term_ends = _ends(sizes[kept])
        in_terms = np.bincount(term_of, minlength=len(terms))[kept_terms]
        self.literal_ends = _ends(in_terms)
        self.term_literals = numbers[kept_terms[term_of]].astype(np.int32)
        self.seen, self.pages, self.next = np.zeros(self.count, np.int32), 0, LEARN
        self._order()

    def _order(self) -> None:
        """Hang every condition on its rarest term: by pages it occurred on, then by length."""
        if not len(self.row):
            self.watching, self.watch_ends = np.zeros(0, np.int32), np.zeros(self.count + 1, np.int64)
            return
        seen = np.add.reduceat(self.seen[self.term_literals], self.literal_ends[:-1])
        length = np.minimum.reduceat(self.length[self.term_literals], self.literal_ends[:-1])
        owner = np.repeat(np.arange(len(self.row), dtype=np.int32), np.diff(self.term_ends))
        rarest = np.lexsort((-length, seen, owner))[self.term_ends[:-1]]
        counts = np.diff(self.literal_ends)[rarest]
        literals = self.term_literals[_spans(self.literal_ends[rarest], counts)]
        order = np.argsort(literals, kind="stable")
        self.watching = np.repeat(np.arange(len(self.row), dtype=np.int32), counts)[order]
        self.watch_ends = _ends(np.bincount(literals, minlength=self.count))

    def _hits(self, pages: list[dict[str, str]]) -> np.ndarray:
        """The literals that occur, each once a page, as page x ``count`` + number, ascending."""
        hits = [np.zeros(0, np.int64)]
        for name, (first, literals) in self.literals.items():
            held = [(i, texts[name].encode()) for i, texts in enumerate(pages) if name in texts]
            if not held:
                continue
            ends = np.cumsum([len(text) for _, text in held])
            at, sizes, numbers = literals.find(np.frombuffer(b"".join(text for _, text in held), np.uint8))
            page = np.searchsorted(ends, at, "right")
            whole = at + sizes <= ends[page]
            hits.append(np.unique(np.array([i for i, _ in held])[page[whole]] * self.count + first + numbers[whole]))
        return np.sort(np.concatenate(hits))

    def _holding(self, hits: np.ndarray, page: np.ndarray, watching: np.ndarray) -> np.ndarray:
        """Of conditions on pages, whether all of their terms occur."""
        holds = np.ones(len(page), bool)
        terms = self.term_ends[watching + 1] - self.term_ends[watching]
        more = np.flatnonzero(terms > 1)
        term = _spans(self.term_ends[watching[more]], terms[more])
        owner = np.repeat(more, terms[more])
        counts = self.literal_ends[term + 1] - self.literal_ends[term]
        looked = np.repeat(page[owner], counts) * self.count + self.term_literals[_spans(self.literal_ends[term], counts)]
        there = hits[np.minimum(np.searchsorted(hits, looked), len(hits) - 1)] == looked
        occurs = np.zeros(len(term), bool)
        occurs[np.repeat(np.arange(len(term)), counts)[there]] = True
        holds[owner[~occurs]] = False
        return holds

    def room(self) -> int:
        """So many pages at most are searched together: patterns that are always candidates take room for each."""
        return max(1, PAIRS // (1 + sum(map(len, self.always.values()))))

    def search(self, pages: list[dict[str, str]], keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may match, ascending, page after page, and how many of each page, given of every page
        its lower-cased texts by name and the keys present."""
        hits = self._hits(pages)
        found = [np.zeros(0, np.int64)]
        page, number = np.divmod(hits, max(1, self.count))
        counts = self.watch_ends[number + 1] - self.watch_ends[number] if len(hits) else np.zeros(0, np.int64)
        total = np.cumsum(counts)
        start = 0
        while start < len(hits):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
            its = np.repeat(page[start:stop], counts[start:stop])
            watching = self.watching[_spans(self.watch_ends[number[start:stop]], counts[start:stop])]
            holds = self._holding(hits, its, watching)
            found.append(np.unique(its[holds] * self.size + self.row[watching[holds]]))
            start = stop
        for name, rows in self.always.items():
            its = np.array([i for i, texts in enumerate(pages) if name in texts], np.int64)
            found.append((its[:, None] * self.size + rows).ravel())
        if self.by_key:
            found.append(np.array([i * self.size + row for i, its in enumerate(keys) for key in its or () for row in self.by_key.get(key, ())], np.int64))
        owner, rows = np.divmod(np.unique(np.concatenate(found)), max(1, self.size))
        np.add.at(self.seen, number, 1)
        self.pages += len(pages)
        if self.pages >= self.next:
            self.next *= 4
            self._order()
        return rows.astype(np.int32), np.bincount(owner, minlength=len(pages))


def _read(path: str, columns: list[str]) -> pa.Table:
    files, place = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return pq.read_table(place, filesystem=files, columns=columns, partitioning=None)


def _sizes(paths: tuple[str, ...]) -> list[int]:
    sizes = []
    for path in paths:
        files, place = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        with files.open_input_file(place) as file:
            sizes.append(pq.ParquetFile(file).metadata.num_rows)
    return sizes


def _groups(paths: tuple[str, ...], part: int) -> list[tuple[tuple[str, ...], int]]:
    """(files, rows to leave out at the start) of every part: small files together, a large one in slices."""
    groups: list[tuple[tuple[str, ...], int]] = []
    waiting: list[str] = []
    rows = 0
    for path, n in zip(paths, worker_keeps(("sizes", paths), lambda: _sizes(paths), 4)):
        if waiting and rows + n > part:
            groups.append((tuple(waiting), 0))
            waiting, rows = [], 0
        if n > part:
            groups += [((path,), at) for at in range(0, n, part)]
        elif n:
            waiting.append(path)
            rows += n
    return groups + ([(tuple(waiting), 0)] if waiting else [])


def _rows(files: tuple[str, ...], at: int, part: int, columns: list[str]) -> pa.Table:
    return pa.concat_tables([_read(p, columns) for p in files]).slice(at, part)


def _alike(paths: tuple[str, ...], part: int, alike: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every part's rows equal in some columns: each row's number of a set of equal ones, and the first row of
    each set, ascending; on mapped files."""

    def sets(files: tuple[str, ...], at: int) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros(1, np.int64)
        for name in alike:
            values = _rows(files, at, part, [name])[name].combine_chunks().dictionary_encode(null_encoding="encode")
            _, first, codes = np.unique(codes * len(values.dictionary) + values.indices.to_numpy(), return_index=True, return_inverse=True)
            del values
        order = np.argsort(first)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        return _held(iter([number[codes]])), _held(iter([first[order].astype(np.int32)]))

    return worker_keeps(("alike", paths, part, alike), lambda: [sets(files, at) for files, at in _groups(paths, part)], MAPPED)


def _mapped(tables: Iterator[pa.Table]) -> list[pa.Table]:
    """Tables from a mapped file that leaves the worker's temporary folder at once."""
    with tempfile.NamedTemporaryFile(suffix=".arrow") as file:
        sizes, out = [], None
        for rows in tables:
            rows = rows.combine_chunks()
            out = out or pa.ipc.new_file(file.name, rows.schema)
            out.write_table(rows)
            sizes.append(rows.num_rows)
        if out is None:
            return []
        out.close()
        stored = pa.ipc.open_file(pa.memory_map(file.name)).read_all()
    ends = np.cumsum(sizes)
    return [stored.slice(end - size, size) for end, size in zip(ends, sizes)]


def _held(numbers: Iterator[np.ndarray]) -> np.ndarray:
    """Numbers of all parts as one array, on a mapped file, too."""
    with tempfile.TemporaryFile() as file:
        for its in numbers:
            its.tofile(file)
            kind = its.dtype
        file.flush()
        return np.memmap(file, kind, "r") if file.tell() else np.zeros(0, kind)


def _taken(tables: list[pa.Table], starts: np.ndarray, rows: np.ndarray) -> pa.Table:
    """Rows of consecutive tables by their numbers."""
    if len(tables) == 1:
        return tables[0].take(pa.array(rows)).combine_chunks()
    which = np.searchsorted(starts, rows, "right") - 1
    places = [np.flatnonzero(which == i) for i in range(len(tables))]
    pieces = [table.take(pa.array(rows[its] - start)) for table, start, its in zip(tables, starts, places)]
    order = np.empty(len(rows), np.int64)
    order[np.concatenate(places)] = np.arange(len(rows))
    return pa.concat_tables(pieces).take(pa.array(order)).combine_chunks()


def _structs(rows: pa.Table, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as lists of structs, given where each list ends."""
    items = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(items, names=rows.column_names)).cast(kind)


def _numbers(parts: Iterator[Part], batch: tuple[pa.Array, ...], names: list[str], at: int, pages: int, sizes: list[int],
             everything: bool) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """How many pages from ``at`` on were searched, at most ``pages``, and per part the numbers of their candidates,
    one page after the other, with the ends of the pages. It is as many pages as ``NUMBERS`` has room for, or one."""
    found: list[tuple[array, list[int]]] = []
    held = 0
    for size, some in zip(sizes, parts):
        numbers, ends = array("i"), [0]
        found.append((numbers, ends))
        page = 0
        while page < pages:
            texts, keys, letters = [], [], 0
            while page < pages and letters < LETTERS and len(texts) < (1 if everything else some.room()):
                values = [column[at + page].as_py() for column in batch]
                texts.append({name: text.lower() for name, text in zip(names, values) if text})
                keys.append(values[-1])
                letters += sum(map(len, texts[-1].values()))
                page += 1
            rows, counts = (np.arange(size, dtype=np.int32), [size]) if everything else some.search(texts, keys)
            numbers.frombytes(rows.tobytes())
            ends += (ends[-1] + np.cumsum(counts)).tolist()
            while held + len(numbers) > NUMBERS and pages > 1:
                pages = max(1, pages // 2)
                for its, places in found:
                    del places[pages + 1:], its[places[-1]:]
                held = sum(len(its) for its, _ in found[:-1])
        held += len(numbers)
    return pages, [(np.frombuffer(numbers, np.int32) if numbers else np.zeros(0, np.int32), np.array(ends)) for numbers, ends in found]


def candidate_rows(patterns: DataFrame, columns: list[str], texts: dict[str, Column], keys: Column, part: int = PART,
                   everything: bool = False, alike: list[str] | None = None) -> Column:
    """Array column of structs of ``columns``: the rows of ``patterns`` (see ``write_patterns``) that a page may
    match, in their order; with ``everything`` all of them.

    With ``alike``, text columns that settle whether a row matches, only the first of a part's rows equal in them is
    named, with its number ``row``, which ``rows_alike`` makes all of them again.
    """
    names = list(texts)
    fields = patterns.select(*columns).schema.fields
    schema = StructType([*fields, StructField("row", IntegerType())] if alike else fields)
    paths = tuple(sorted(patterns.inputFiles()))
    named = tuple(alike or ())

    def tables() -> Iterator[pa.Table]:
        before = 0
        for i, (files, at) in enumerate(_groups(paths, part)):
            rows = _rows(files, at, part, columns)
            first = _alike(paths, part, named)[i][1] if named else None
            yield rows.take(pa.array(first)).append_column("row", pa.array(first + before, pa.int32())) if named else rows
            before += rows.num_rows

    def conditions(i: int, files: tuple[str, ...], at: int) -> Part:
        wanted = _rows(files, at, part, ["wanted"])["wanted"]
        some = Part((wanted.take(pa.array(_alike(paths, part, named)[i][1])) if named else wanted).combine_chunks())
        del wanted
        pa.default_memory_pool().release_unused()
        return some

    def parts() -> Iterator[Part]:
        for i, (files, at) in enumerate(_groups(paths, part)):
            yield worker_keeps(("part", files, at, part, named), lambda: conditions(i, files, at), PARTS_KEPT)

    def handed(rows: list[pa.Table], found: list[tuple[np.ndarray, np.ndarray]], start: int, stop: int) -> pa.Array:
        """The candidates of some pages. Parts come one after the other; a page's rows are brought together, in the order of the parts."""
        pieces, owners = [], []
        for table, (numbers, ends) in zip(rows, found):
            if ends[stop] > ends[start]:
                pieces.append(table.take(pa.array(numbers[ends[start]:ends[stop]])))
                owners.append(np.repeat(np.arange(stop - start), np.diff(ends[start:stop + 1])))
        if not pieces:
            return pa.array([[]] * (stop - start), arrow_kind)
        owner = np.concatenate(owners)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=stop - start))])
        flat = (pieces[0] if len(pieces) == 1 else pa.concat_tables(pieces).take(pa.array(np.argsort(owner, kind="stable")))).combine_chunks()
        return _structs(flat, ends, arrow_kind)

    def candidates(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        rows = worker_keeps(("rows", paths, part, tuple(columns), named), lambda: _mapped(tables()), MAPPED)
        sizes, room = [table.num_rows for table in rows], None
        for batch in batches:
            at, length = 0, len(batch[0])
            while at < length:
                wanted = min(length - at, room or length)
                pages, found = _numbers(parts(), batch, names, at, wanted, sizes, everything)
                ends = sum((its for _, its in found), np.zeros(pages + 1, np.int64))
                start = 0
                while start < pages:
                    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HANDED, "right")) - 1)
                    yield handed(rows, found, start, min(stop, pages))
                    start = min(stop, pages)
                # the next pages are searched as many at a time as these had room, or twice as many
                room = pages if pages < wanted or ends[-1] > NUMBERS // 2 else room and 2 * room
                at += pages
                del found

    kind = ArrayType(schema)
    arrow_kind = to_arrow_type(kind)
    # a second column, so that every batch is a tuple
    return F.arrow_udf(candidates, kind)(*(texts.values() or [F.lit("")]), keys)


class Store:
    """All rows of the patterns, on mapped files: ``tables`` part by part, and which rows are alike."""

    def __init__(self, paths: tuple[str, ...], part: int, alike: tuple[str, ...], columns: tuple[str, ...]):
        groups = _groups(paths, part)
        self.tables = _mapped(_rows(files, at, part, list(columns)) for files, at in groups)
        self.starts = np.cumsum([0, *(table.num_rows for table in self.tables)])[:-1]
        spans = []

        def members() -> Iterator[np.ndarray]:
            for (codes, first), before in zip(_alike(paths, part, alike), self.starts):
                counts = np.bincount(codes)
                begin, count = np.zeros((2, len(codes)), np.int32)
                begin[first], count[first] = before + np.cumsum(counts) - counts, counts
                spans.append((begin, count))
                yield (before + np.argsort(codes, kind="stable")).astype(np.int32)

        self.members = _held(members()) if groups else np.zeros(0, np.int32)
        self.begin, self.count = (_held(iter(its)) for its in zip(*spans)) if spans else np.zeros((2, 0), np.int32)
        pa.default_memory_pool().release_unused()

    def numbers(self, make: Callable[[pa.Table], np.ndarray]) -> np.ndarray:
        """Something of every row."""
        return _held(make(table) for table in self.tables) if self.tables else np.zeros(0, np.int32)

    def take(self, columns: list[str], rows: np.ndarray) -> pa.Table:
        return _taken([table.select(columns) for table in self.tables], self.starts, rows)

    def expand(self, firsts: pa.ListArray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some pages at a time, with ``most`` rows or one page: how many, and all rows alike to the given
        ones of each, ascending, with the page of each row."""
        ends = firsts.offsets.to_numpy() - firsts.offsets[0].as_py()
        first = firsts.flatten().to_numpy(zero_copy_only=False)
        counts = self.count[first]
        rows_before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends]
        start = 0
        while start < len(firsts):
            stop = min(len(firsts), max(start + 1, int(np.searchsorted(rows_before, rows_before[start] + most, "right")) - 1))
            some = slice(ends[start], ends[stop])
            page = np.repeat(np.arange(stop - start), np.diff(rows_before[start:stop + 1]))
            both = page << 32 | self.members[_spans(self.begin[first[some]], counts[some])]
            both.sort()
            yield stop - start, both >> 32, both & 0xFFFFFFFF
            start = stop


def store(paths: tuple[str, ...], part: int, alike: tuple[str, ...], columns: tuple[str, ...]) -> Store:
    return worker_keeps(("store", paths, part, alike, columns), lambda: Store(paths, part, alike, columns), MAPPED)


def rows_alike(patterns: DataFrame, columns: list[str], firsts: Column, part: int, alike: list[str]) -> Column:
    """Array column of structs of ``columns``: all rows of ``patterns`` alike to those whose numbers are given, in their order."""
    kind = ArrayType(patterns.select(*columns).schema)
    arrow_kind = to_arrow_type(kind)
    paths, named, wanted = tuple(sorted(patterns.inputFiles())), tuple(alike), tuple(columns)

    def expanded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = store(paths, part, named, wanted)
        for batch in batches:
            if not kept.tables and len(batch):
                yield pa.array([[]] * len(batch), arrow_kind)
                continue
            for pages, page, rows in kept.expand(batch, HANDED):
                ends = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=pages))])
                yield _structs(kept.take(columns, rows), ends, arrow_kind)

    return F.arrow_udf(expanded, kind)(firsts)


def rows_exploded(pages: DataFrame, patterns: DataFrame, columns: list[str], firsts: str, part: int, alike: list[str]) -> DataFrame:
    """All rows of ``patterns`` alike to those whose numbers the pages' column ``firsts`` gives: ``columns`` of each,
    after the other columns of its page. Rows are handed over a bounded number at a time, however many a page has."""
    kept = [c for c in pages.columns if c != firsts]
    schema = StructType([*pages.select(*kept).schema.fields, *patterns.select(*columns).schema.fields])
    paths, named, wanted = tuple(sorted(patterns.inputFiles())), tuple(alike), tuple(columns)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = store(paths, part, named, wanted)
        for batch in batches:
            before = 0
            for number, page, rows in held.expand(batch.column(len(kept)), HANDED) if held.tables else ():
                for at in range(0, len(rows), HANDED):
                    owner = pa.array(page[at:at + HANDED] + before)
                    its = held.take(columns, rows[at:at + HANDED])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(owner) for i in range(len(kept))), *(c.chunk(0) for c in its.columns)], [*kept, *columns])
                before += number

    return pages.select(*kept, firsts).mapInArrow(exploded, schema)
