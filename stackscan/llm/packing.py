"""Packing: vector bin packing by the dot-product heuristic.

An example is a vector (tokens, segments = 1, loss-bearing tokens), a sequence a bin with a limit on each.
The open sequence takes, again and again, the example that fits and whose dot product with the room left
is largest; when none fits, the next sequence is opened. Examples are dealt into groups of bounded size by
a hash of their key and packed group by group, so no task needs more than one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stackscan.llm import token_ids
from stackscan.llm.common import kept

#: Tokens, segments and loss-bearing tokens of a sequence.
LIMITS = (1024, 128, 1024)
#: Examples in a group, on average.
GROUP = 8192
END = 0


def pack(vectors: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place in it) of every example, for ``vectors`` of shape (examples, limits).

    Examples with equal vectors are interchangeable and taken in the order given; a tie of dot products
    goes to the larger vector, by its first differing size. Sizes are measured in parts of their limit.
    An example over a limit raises ValueError.
    """
    if len(vectors) and (vectors > np.asarray(limits)).any():
        raise ValueError("an example exceeds a limit")
    kinds, kind = np.unique(vectors, axis=0, return_inverse=True)
    kinds, kind = kinds[::-1], len(kinds) - 1 - kind.ravel()  # argmax takes the first, so the larger
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    following = np.cumsum(left) - left  # the next example of each kind, as a place in order
    full = np.asarray(limits)
    parts, first = kinds / full, -kinds[:, 0]  # ascending, so that kinds too large for the room are left out by bisection
    sequence, place = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    number, room, filled, placed = 0, full.copy(), 0, 0
    while placed < len(vectors):
        at = int(np.searchsorted(first, -room[0]))
        fits = left[at:] > 0
        for d in range(1, len(full)):
            fits &= kinds[at:, d] <= room[d]
        gain = np.where(fits, parts[at:] @ (room / full), -1.0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or not fits[best]:
            number, room, filled = number + 1, full.copy(), 0
            continue
        best += at
        # a kind that fills an empty sequence by itself is taken again and again, a sequence each
        n = int(left[best]) if not filled and kinds[best, 0] == full[0] and kinds[:, 0].min() > 0 else 1
        some = order[following[best]:following[best] + n]
        sequence[some], place[some] = number + np.arange(n), filled
        following[best] += n
        left[best] -= n
        room = room - kinds[best]
        number, filled, placed = number + n - 1, filled + 1, placed + n
    return sequence, place


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, limits: tuple[int, int, int] = LIMITS,
                  group: int = GROUP) -> DataFrame:
    """``examples`` with sequence_id and offset, the tokens before it in its sequence.

    ``tokens`` and ``loss`` name the sizes (null: 0). Examples are dealt by the hash of ``key`` (its rows stay
    in one group, but those without a key are spread) into groups of about ``group`` examples; ids of sequences are unique and gapless within
    a group, whose number stands in the upper 32 bits. Rows equal in all columns may change places. Columns
    named sequence_id or offset are replaced. An empty table gives an empty result.
    """
    rows = kept(examples.drop("sequence_id", "offset"))
    groups = max(1, -(-rows.count() // group))
    # rows without a key are dealt by their place in the table as it was written
    dealt = F.when(F.col(key).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(key))
    keyed = rows.select(F.pmod(dealt, F.lit(groups)).alias("g"), F.col(tokens).cast("long").alias("t"),
                        F.col(loss).cast("long").alias("l"), F.struct("*").alias("row"), F.xxhash64(*rows.columns).alias("h"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "descending"), ("l", "descending"), ("h", "ascending")])
        sizes = np.column_stack([table["t"].fill_null(0).to_numpy(), np.ones(table.num_rows, np.int64), table["l"].fill_null(0).to_numpy()])
        sequence, place = pack(sizes, limits)
        order = np.lexsort((place, sequence))
        before = np.cumsum(sizes[order, 0]) - sizes[order, 0]
        first = np.r_[True, np.diff(sequence[order]) > 0] if len(order) else np.zeros(0, bool)
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(order) else before
        base = table["g"][0].as_py() << 32 if table.num_rows else 0
        return pa.table({"row": table["row"], "sequence_id": pa.array(sequence + base), "offset": pa.array(offset)})

    # the type itself, not its name: fields that are never null must be said to be so
    schema = StructType([keyed.schema["row"]]).add("sequence_id", "long").add("offset", "long")
    return (keyed.groupBy("g").applyInArrow(packed, schema)
            .select("row.*", "sequence_id", "offset"))


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint"


def token_pieces(docs: DataFrame, path: str, size: int = LIMITS[0], end: int = END) -> DataFrame:
    """The pieces of every document's ids (null text: empty) with ``end`` after them, cut every ``size`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, and loss_tokens: the ids of the piece that have another one
    of the piece before them to be predicted from.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = token_ids.encoder(path).encode, np.uint32(end).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                out += [(doc_id, s, min(size, n - s), zlib.crc32(ids[4 * s:4 * (s + size)]), n, min(size, n - s) - 1)
                        for s in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6,
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, path: str, limits: tuple[int, int, int] = LIMITS, end: int = END, group: int = GROUP) -> DataFrame:
    """The pieces of all documents, packed: see ``token_pieces`` and ``pack_examples``.

    A document longer than a sequence fills whole sequences; its rest is packed with others. Rows that
    repeat each other are packed each; a null doc_id is kept as null.
    """
    return pack_examples(token_pieces(docs, path, limits[0], end), "doc_id", "length", "loss_tokens", limits, group)
