"""Token ids in Arrow's file format: fixed-size-list batches of equal-length sequences and masks.

Documents lie in ascending order of their id. Each writing task holds one range of ids and writes one
file ``part-N.arrow``: its documents' ids one after the other, cut into sequences of equal length, the
last one padded; the mask is true where an id is real. ``part-N.docs.arrow`` says where each document
lies. Lists of fixed size need no offsets, so a reader maps the file and takes any sequence, or any run
of ids, without a copy. Ids take two bytes where the vocabulary allows.

A file is written under a name of its attempt and renamed when complete, so a task that is run again
leaves one whole file. Files lie in the folder that driver and executors share.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscan.llm import token_ids
from stackscan.llm.common import fresh_folder, kept

LENGTH = 1024
END = 2
#: Sequences in a record batch.
BATCH = 1024


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Writes ids as they come, in sequences of ``length``, into one file."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        ids = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError(f"an id does not fit into {self.dtype}")
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.length * BATCH:
            self._write(self.n_waiting // self.length)

    def _write(self, rows: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        size = rows * self.length
        real = min(size, len(flat))
        ids, mask = np.zeros(size, self.dtype), np.zeros(size, bool)
        ids[:real], mask[:real] = flat[:real], True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.waiting, self.n_waiting = ([flat[size:]], len(flat) - size) if len(flat) > size else ([], 0)

    def close(self) -> None:
        if self.n_waiting:
            self._write(-(-self.n_waiting // self.length))
        self.file.close()


class SequenceFile:
    """Random access to a file of sequences; local files are mapped, not read."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.length = self.file.schema.field("ids").type.list_size
        self.ends = np.cumsum([0] + [b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1])

    def _flat(self, batch: int, column: str) -> pa.Array:
        lists = self.batches[batch].column(column)
        return lists.values.slice(lists.offset * self.length, len(lists) * self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; the ids are a view of the file."""
        b = int(np.searchsorted(self.ends, i, "right")) - 1
        at = (i - int(self.ends[b])) * self.length
        mask = self._flat(b, "mask").slice(at, self.length).to_numpy(zero_copy_only=False)
        return self._flat(b, "ids").to_numpy()[at:at + self.length], mask

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """The ``n`` ids from ``start`` on, as views, one for each batch that they touch."""
        found, edges = [], self.ends * self.length
        b = int(np.searchsorted(edges, start, "right")) - 1
        while n > 0:
            view = self._flat(b, "ids").to_numpy()[start - int(edges[b]):][:n]
            found.append(view)
            start, n, b = start + len(view), n - len(view), b + 1
        return found


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_files(docs: DataFrame, folder: str, path: str, length: int = LENGTH, end: int = END, dtype: str = "uint16") -> DataFrame:
    """Writes the ids of all documents (null text: empty) with ``end`` after each; returns (part, n_docs, n_ids).

    Rows with equal ids lie in one file, in the order of their texts' hashes; null ids come first. The
    result is written before it is returned, so the files are complete.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = token_ids.encoder(path).encode, np.array([end], np.uint32).tobytes()
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, root = _place(folder)
        files.create_dir(root, recursive=True)
        names = [posixpath.join(root, f"part-{part:06d}{kind}.arrow") for kind in ("", ".docs")]
        drafts = [posixpath.join(root, f".part-{part:06d}{kind}.{attempt}.draft") for kind in ("", ".docs")]
        ids_of: list[int] = []
        sizes: list[int] = []
        with files.open_output_stream(drafts[0]) as sink:
            sequences = SequenceWriter(sink, length, dtype)
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    ids = np.frombuffer(encode(text.as_py() or "") + last, np.uint32)
                    sequences.add(ids)
                    ids_of.append(doc_id)
                    sizes.append(len(ids))
            sequences.close()
        starts = np.cumsum([0] + sizes)[:-1]
        with files.open_output_stream(drafts[1]) as sink, pa.ipc.new_file(sink, DOCS) as index:
            index.write_table(pa.table([pa.array(ids_of, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS),
                              max_chunksize=1 << 16)
        for draft, name in zip(drafts, names):
            files.move(draft, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(sizes)], pa.int64()),
                                          "n_ids": pa.array([sequences.total], pa.int64())})

    ordered = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    return kept(ordered.mapInArrow(write, "part int, n_docs bigint, n_ids bigint"))


def open_part(folder: str, part: int) -> tuple[SequenceFile, SequenceFile | pa.Table]:
    """(sequences, documents) of a written part."""
    files, root = _place(folder)
    name = posixpath.join(root, f"part-{part:06d}")
    local = isinstance(files, fs.LocalFileSystem)
    source = pa.memory_map(f"{name}.arrow") if local else files.open_input_file(f"{name}.arrow")
    with files.open_input_file(f"{name}.docs.arrow") as index:
        return SequenceFile(source), pa.ipc.open_file(index).read_all()


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_files(parts: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``parts`` is what ``write_files`` returned; the running sum over it has one row per file.
    """
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before in zip(batch["part"].to_pylist(), batch["before"].to_pylist()):
                sequences, docs = open_part(folder, part)
                for some in docs.to_batches(1 << 14):
                    crcs = []
                    for start, n in zip(some["start"].to_pylist(), some["n_tokens"].to_pylist()):
                        crc = 0
                        for view in sequences.ids(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(some["start"].to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([some["doc_id"], starts, some["n_tokens"], pa.array(crcs, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.select("part", base.cast("long").alias("before")).repartition(max(1, parts.count()), "part")
    return spread.mapInArrow(read, READ)


def encode_to_files(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, dtype: str = "uint16") -> DataFrame:
    """Writes the files into a fresh shared folder and reads them back; an empty table gives an empty result."""
    folder = fresh_folder(docs.sparkSession, "arrow-ids")
    return read_files(write_files(docs, folder, path, length, end, dtype), folder)
