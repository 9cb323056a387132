"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Both tokenizers cut the same bytes, a space and the text. After full tokenisation the places where tokens
of both end are the shared ends. A shared end before a token that both sides mark with a space is an
anchor. Where neither side joins what a single space divides, every such space follows an anchor, and
these anchors split a document into parts, one word each. What a part's ids are and align to depends on the part
alone, so a portion of texts looks at each different part once, at all of them together, and a worker
remembers the ids of parts. The shared ends inside a part cut it into groups, and the last tokens of a group are linked.

Counts over the corpus need a second step: links are written once, as one array of numbers per document,
and counted by Spark. How many different links there are is bounded by the two vocabularies, whatever the
corpus: of two tokens that end together one is a suffix of the other.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import stored
from stackscan.llm.token_ids import MIXED, ChunkEncoder

#: Most parts of texts whose ids a worker remembers. A memo of its encoder begins anew behind an eighth as many.
CHUNKS = 250_000
#: Parts of more letters than this are not remembered.
LONG_CHUNK = 64
#: New parts go to the two libraries in windows of at most this many, which end behind so many letters.
WINDOWS, LONG_WINDOW = 20_000, 1 << 18
#: A link's number is the first id times this, plus the second id.
STEP = 1 << 15
#: Letters of the texts that are aligned at a time, about.
PORTION = 1 << 21


def _ends(sizes) -> np.ndarray:
    return np.r_[0, np.cumsum(np.asarray(sizes, np.int64))]


def _gather(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the items of lists ``which``, one list after the other, and the ends of these lists."""
    sizes = np.diff(ends)[which]
    after = _ends(sizes)
    return np.repeat(ends[which] - after[:-1], sizes) + np.arange(after[-1]), after


def _lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


class PartIds:
    """Parts of texts, each once, and their ids on both sides; no ids where the bytes of either side are not the part's.

    ``older`` says how many portions ago each part was last asked for. Arrow and numpy hold all, some 50 bytes a part.
    """

    def __init__(self, parts: pa.StringArray, sides: list[tuple[np.ndarray, np.ndarray]]):
        self.parts, self.sides = parts, sides
        self.older = np.zeros(len(parts), np.int32)

    def __len__(self) -> int:
        return len(self.parts)

    def take(self, which: np.ndarray) -> PartIds:
        sides = []
        for ids, ends in self.sides:
            at, after = _gather(ends, which)
            sides.append((ids[at], after))
        taken = PartIds(self.parts.take(pa.array(which)), sides)
        taken.older = self.older[which]
        return taken

    def followed_by(self, *more: PartIds) -> PartIds:
        some, sides = [self, *more], []
        for side in zip(*[x.sides for x in some]):
            sides.append((np.concatenate([ids for ids, _ in side]), _ends(np.concatenate([np.diff(ends) for _, ends in side]))))
        both = PartIds(pa.concat_arrays([x.parts for x in some]), sides)
        both.older = np.concatenate([x.older for x in some])
        return both

    def newest(self, most: int) -> PartIds:
        """These parts, or three quarters of ``most``, those asked for last, where they are more than ``most``."""
        if len(self) <= most:
            return self
        return self.take(np.sort(np.argsort(self.older, kind="stable")[:most * 3 // 4]))


class Aligned:
    """Some documents' ids on both sides, one document after the other, and the alignment of their parts.

    ``docs_a`` and ``docs_b`` hold the numbers of ids before each document, and of all at the end; ``docs``
    likewise of parts. ``which`` names each part's place among the different ones; of these, ``triples`` holds
    the groups, ``after`` the groups before each, ``written`` the groups as text.
    """

    def __init__(self, known: PartIds, which: np.ndarray, docs: np.ndarray):
        self.which, self.docs = which, docs
        self.starts, sides = [], []
        for ids, ends in known.sides:
            at, after = _gather(ends, which)
            self.starts.append(after)
            sides.append((ids[at], after[docs]))
        (self.a, self.docs_a), (self.b, self.docs_b) = sides
        self.triples, self.after, self.written = np.zeros((0, 3), np.int32), np.zeros(len(known) + 1, np.int64), pa.array([], pa.string())

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a before its end, ids of b before its end, link) of every group, and the groups before each document."""
        at, after = _gather(self.after, self.which)
        triples = self.triples[at]
        parts = np.diff(self.docs)
        for column, (starts, before) in enumerate(zip(self.starts, (self.docs_a, self.docs_b))):
            triples[:, column] += np.repeat((starts[:-1] - np.repeat(before[:-1], parts)).astype(np.int32), np.diff(after))
        return triples, after[self.docs]

    def texts(self) -> pa.Array:
        """The groups of every document as text."""
        return pc.binary_join(_lists(self.docs, self.written.take(pa.array(self.which))), ";")


class Aligner:
    """Encodes texts with a byte-level BPE file and a sentencepiece model and aligns the two."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encoder = ChunkEncoder(path_a)
        back = {letter: byte for byte, letter in self.encoder.letters.items()}
        back = {chr(b): b for b in range(256) if b not in self.encoder.letters} | back
        spelled = {i: t for t, i in self.encoder.library.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(back.get(c, 0x3F) for c in spelled.get(i, "")) for i in range(max(spelled) + 1)]
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        if len(self.bytes_a) * STEP >= 1 << 31 or len(self.bytes_b) > STEP:
            raise ValueError("a vocabulary is too large for the numbers of links")
        self.tables = [pa.array(x, pa.binary()) for x in (self.bytes_a, self.bytes_b)]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        # every id as text, before another id of its side in its group, the other side, another group, and the end
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        plain = pa.array(np.arange(self.most)).cast(pa.string())
        self.numbers = pa.concat_arrays([pc.binary_join_element_wise(plain, mark, "") for mark in (",", "|", ";", "")])
        # no piece goes on behind a word's end, so the pieces of two words do not depend on each other
        self.by_word = not any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self.chunks = self._both([])

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _both(self, parts: list[str]) -> PartIds:
        """The parts' ids on both sides, none where the bytes of either differ from a space and the part."""
        a = [self.encoder.new_chunk(p) if " " not in p else self.encoder.encode(" " + p) for p in parts]
        b = self.pieces.encode(parts, num_threads=1)
        known = PartIds(pa.array(parts, pa.string()), [
            (np.frombuffer(b"".join(a), np.uint32).astype(np.uint16), _ends([len(x) // 4 for x in a])),
            (np.fromiter(chain.from_iterable(b), np.uint16), _ends([len(x) for x in b]))])
        want = pa.array([b" " + p.encode() for p in parts], pa.binary())
        same = np.ones(len(parts), bool)
        for table, (ids, ends) in zip(self.tables, known.sides):
            spelled = pc.binary_join(_lists(ends, table.take(pa.array(ids))), b"")
            same &= pc.equal(spelled, want).to_numpy(zero_copy_only=False)
        if not same.all():
            known.sides = [(ids[np.repeat(same, np.diff(ends))], _ends(np.diff(ends) * same)) for ids, ends in known.sides]
        return known

    def _parts(self, text: str) -> list[str]:
        """The text cut at its single spaces, where neither side joins what these divide; else the whole."""
        spaced = " " + text
        if not self.by_word or text[-1:] == " " or "  " in spaced or MIXED.search(spaced) or "▁" in text:
            return [text]
        return text.split(" ")

    def _new(self, parts: list[str]) -> Iterator[PartIds]:
        """The ids of parts that are not remembered, for a bounded number of them, or one, at a time."""
        begin = letters = 0
        for n, part in enumerate(parts, 1):
            letters += len(part)
            if n - begin >= WINDOWS or letters >= LONG_WINDOW or n == len(parts):
                yield self._both(parts[begin:n])
                begin, letters = n, 0

    def _ids_of(self, parts: pa.StringArray) -> PartIds:
        """The ids of different parts. A part met before is looked up; new ones go to both libraries."""
        # what the encoder remembers of new parts is bounded here: only its ``encode`` does so, which words do not reach
        for memo in (self.encoder.pieces, self.encoder.spaced):
            memo.turn(CHUNKS // 8)
        place = pc.index_in(parts, self.chunks.parts)
        fresh = np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        self.chunks.older += 1
        self.chunks.older[at[at >= 0]] = 0
        held = self.chunks.followed_by(*self._new(parts.take(pa.array(fresh)).to_pylist()))
        at[fresh] = np.arange(len(self.chunks), len(held))
        found = held.take(at)
        if len(fresh):
            short = pc.utf8_length(held.parts).to_numpy() <= LONG_CHUNK
            self.chunks = (held if short.all() else held.take(np.flatnonzero(short))).newest(CHUNKS)
        return found

    def encode(self, texts: list[str]) -> tuple[PartIds, np.ndarray, np.ndarray]:
        """The different parts of the texts, the place of each part of the texts among them, and the parts before
        each text. No parts of a text that is empty or not the same bytes on both sides."""
        parts = [self._parts(t) if t else [] for t in texts]
        while True:
            numbered = pa.array([p for some in parts for p in some], pa.string()).dictionary_encode()
            known, which = self._ids_of(numbered.dictionary), numbered.indices.to_numpy()
            before = _ends([len(p) for p in parts])
            lost = np.diff(known.sides[0][1]) == 0
            if not lost.any():
                return known, which, before
            # a part differs: its text is encoded whole, and left out if that differs, too
            failed = _ends(lost[which])[before]
            for i in np.flatnonzero(np.diff(failed)):
                parts[i] = [texts[i]] if len(parts[i]) > 1 else []

    def align(self, texts: list[str]) -> Aligned:
        """The ids of the texts and the alignment of their parts, every different part's taken once."""
        known, which, docs = self.encode(texts)
        found = Aligned(known, which, docs)
        if not len(known):
            return found
        (a, parts_a), (b, parts_b) = known.sides
        # both sides hold the same bytes, part for part, so their running sums can be compared
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(ends_b, ends_a)
        to_a = np.flatnonzero(ends_b[at] == ends_a)
        to_b = at[to_a]
        found.after = np.searchsorted(to_a, parts_a)  # a part's end is shared
        groups = np.diff(found.after)
        found.triples = np.column_stack([
            to_a + 1 - np.repeat(parts_a[:-1], groups), to_b + 1 - np.repeat(parts_b[:-1], groups), a[to_a] * np.int64(STEP) + b[to_b]]).astype(np.int32)
        # the ids as they are written: group by group, those of a before those of b
        numbers = np.empty(len(a) + len(b), np.int32)
        place_a = np.arange(len(a)) + np.repeat(np.r_[0, to_b[:-1] + 1], np.diff(to_a, prepend=-1))
        place_b = np.arange(len(b)) + np.repeat(to_a + 1, np.diff(to_b, prepend=-1))
        numbers[place_a], numbers[place_b] = a, b
        numbers[place_a[to_a]] += self.most
        numbers[place_b[to_b]] += 2 * self.most
        numbers[place_b[parts_b[1:] - 1]] += self.most
        found.written = pc.binary_join(_lists(parts_a + parts_b, self.numbers.take(pa.array(numbers))), "")
        return found


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two files, made once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


ALIGNED = "doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def _portions(batches: Iterator[pa.RecordBatch], own: Aligner) -> Iterator[tuple[list[int | None], Aligned]]:
    """The ids of some documents and their alignment, for a bounded number of letters, or one text, at a time."""
    for batch in batches:
        ids, texts, letters = batch["doc_id"].to_pylist(), [], 0
        done = 0
        for text in batch["text"]:
            texts.append(text.as_py() or "")
            letters += len(texts[-1])
            if letters >= PORTION:
                yield ids[done:done + len(texts)], own.align(texts)
                done, texts, letters = done + len(texts), [], 0
        if texts:
            yield ids[done:], own.align(texts)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, the ids of both sides, and the ends of its groups as numbers of ids before them.

    Group g holds a_ids[a_ends[g - 1]:a_ends[g]] and the like of b. A text that is null or empty, or that a
    tokenizer does not give back byte by byte, has empty arrays. Rows that repeat are aligned each, a null
    doc_id stays null, other columns are left out, and an empty table gives an empty result.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _portions(batches, aligner(path_a, path_b)):
            groups, docs = found.groups()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), _lists(found.docs_a, found.a.astype(np.int32)), _lists(found.docs_b, found.b.astype(np.int32)),
                 _lists(docs, groups[:, 0].copy()), _lists(docs, groups[:, 1].copy())], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(aligned, ALIGNED)


LINKED = "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>"


def linked_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: a number of its own, doc_id, counts, a digest of its groups, and its links in order."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for ids, found in _portions(batches, aligner(path_a, path_b)):
            groups, docs = found.groups()
            digests = [hashlib.sha256(text.as_buffer()).hexdigest() if n else "" for text, n in zip(found.texts(), np.diff(docs))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + len(ids))), pa.array(ids, pa.int64()), pa.array(np.diff(found.docs_a)), pa.array(np.diff(found.docs_b)),
                 pa.array(np.diff(docs)), pa.array(digests, pa.string()), _lists(docs, groups[:, 2].copy())],
                names=["key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
            key += len(ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(linked, LINKED)


def link_counts(linked: DataFrame) -> DataFrame:
    """(link, n, best) of every id pair that is linked somewhere: how often in all documents, and whether no
    other pair with the same second id is linked more often. At most one row per pair of tokens of which one is
    a suffix of the other, some 324,000 for the public files."""
    counts = linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    second = F.pmod("link", F.lit(STEP))
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.join(most, second == F.col("second")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def token_anchors(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the document's links whose pair is linked as often as any with its second id in all
    documents, ``count_sum`` sums their pairs' counts. A text that is null or empty, or that a tokenizer does not
    give back byte by byte, has zeros and an empty digest. Rows that repeat are counted each, a null doc_id
    stays null, other columns are left out, and an empty table gives an empty result.
    """
    found = stored(linked_documents(docs, path_a, path_b), "token-links")
    counts = F.broadcast(stored(link_counts(found), "link-counts"))  # bounded by the vocabularies
    sums = (found.select("key", F.explode("links").alias("link")).join(counts, "link").groupBy("key")
            .agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.drop("links").join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *zero, "groups_sha256")
