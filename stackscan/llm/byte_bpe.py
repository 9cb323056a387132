"""Byte-level BPE encoding and decoding from a file of ranks, with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a piece that is a token itself. It is
built by hash and displace: keys fall into buckets, and each bucket, the largest first, takes the first
displacement that sends its keys to free slots. Second tier: the bytes of any other piece form a linked
list, and a heap yields the neighbouring pair of the lowest rank until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.token_ids import MEMO, MIXED, _Memo, splitter

_MASK = (1 << 64) - 1


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys, without gaps, from one number per bucket of about two keys.

    A number from 0 on is a displacement; -1 - s is the slot s itself, for a bucket with a single key.
    """

    def __init__(self, keys: list[bytes], load: int = 2):
        self.size, self.buckets = len(keys), max(1, len(keys) // load)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append(h)
        taken, self.numbers = bytearray(self.size), [0] * self.buckets
        for b in sorted((b for b in range(self.buckets) if len(groups[b]) > 1), key=lambda b: -len(groups[b])):
            d, slots = 0, []
            while len(set(slots)) < len(groups[b]) or any(taken[s] for s in slots):
                slots, d = [self._place(h, d) for h in groups[b]], d + 1
            self.numbers[b] = d - 1
            for s in slots:
                taken[s] = 1
        free = (s for s in range(self.size) if not taken[s])
        for b in (b for b in range(self.buckets) if len(groups[b]) == 1):
            self.numbers[b] = -1 - next(free)

    def _place(self, h: int, d: int) -> int:
        x = ((h ^ (h >> 29)) + d * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 24) % self.size

    def slot(self, key: bytes) -> int:
        """The key's slot; any slot for bytes that are no key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.numbers[h % self.buckets]
        return self._place(h, d) if d >= 0 else -1 - d


class ByteBpe:
    """Encodes and decodes with a vocabulary of byte strings and ranks; a rank is its token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.hash = PerfectHash(list(ranks))
        self.keys, self.ids = [b""] * len(ranks), [0] * len(ranks)
        for key, rank in ranks.items():
            s = self.hash.slot(key)
            self.keys[s], self.ids[s] = key, rank
        self.bytes = {rank: key for key, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # left id -> right id -> rank, for every way to put a token together
        self.pairs: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
        for key, rank in ranks.items():
            for i in range(1, len(key)):
                if key[:i] in ranks and key[i:] in ranks:
                    self.pairs[ranks[key[:i]]][ranks[key[i:]]] = rank

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.hash.slot(piece)
        return [self.ids[slot]] if self.keys[slot] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost on a tie, until none is left."""
        pairs, ids = self.pairs, [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank of the pair that starts at a place, -1 for none; a heap entry that differs is stale
        now = [pairs[left].get(right, -1) for left, right in zip(ids, ids[1:])] + [-1]
        heap = [(rank << 32) | i for i, rank in enumerate(now) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], now[j] = rank, -1
            if k < n:
                before[k] = i
                now[i] = r = pairs[rank].get(ids[k], -1)
                if r >= 0:
                    heappush(heap, (r << 32) | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = pairs[ids[h]].get(rank, -1)
                if r >= 0:
                    heappush(heap, (r << 32) | h)
        found, i = [], 0
        while i < n:
            found.append(ids[i])
            i = after[i]
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TextCodec:
    """Encodes whole texts piece by piece; a worker remembers the pieces it has met, up to a bound.

    A text is cut before single spaces, where the pattern cuts in any case, into chunks, which repeat
    often; a text with two spaces in a row, or with a space inside or at the end of other white space, is cut
    by the pattern alone.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe, self.split = ByteBpe(read_ranks(path)), splitter(pattern)
        self.pieces = _Memo(lambda piece: array("I", self.bpe.encode_piece(piece.encode())).tobytes())
        self.spaced = _Memo(lambda chunk: self._whole(" " + chunk))

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> array:
        for memo in (self.pieces, self.spaced):
            memo.turn(MEMO)
        if "  " in text or MIXED.search(text):
            return array("I", self._whole(text))
        first, *rest = text.split(" ")
        return array("I", self._whole(first) + b"".join(map(self.spaced.__getitem__, rest)))

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """The worker's codec for a file, made once per worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TextCodec(path, pattern)
    return _CODECS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; a null text is empty, so has no ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for batch in batches:
            ids = pa.array([encode(t.as_py() or "").tolist() for t in batch["text"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of every row's ids; null ids give no bytes. An id outside the vocabulary raises KeyError."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decode
        for batch in batches:
            found = pa.array([decode(ids.as_py() or ()) for ids in batch["ids"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id bigint, bytes binary")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes
    decoded from the ids). The ids stay in the task that made them. A null text counts as empty."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        number = [str(i) for i in range(max(own.bpe.bytes) + 1)].__getitem__
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = own.encode(text.as_py() or "")
                out.append((doc_id, len(ids), hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest(),
                            hashlib.sha256(own.decode(ids)).hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, DIGESTS)
