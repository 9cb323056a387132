"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of fixed length, the last one padded with
zeros. Filters of several widths run over a window's bytes; the maximum of each filter over the window,
rectified, feeds a softmax over the languages. A text's prediction is the language with the highest mean
log-probability over all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackscan.llm.common import salt_of

LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4, 5), 8
#: Bound of the training sample: documents of each language, and windows of each document.
DOCUMENTS, WINDOWS = 500, 4
#: A language's documents are ranked in this many parts.
SALTS = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Windows that are convolved at a time, so that intermediate values stay in the processor's cache.
_CHUNK = 64


def windows_of(text: str, length: int = LENGTH) -> np.ndarray:
    """The whole text as rows of ``length`` bytes."""
    data = text.encode().lower()
    return np.frombuffer(data.ljust(-(-max(len(data), 1) // length) * length, b"\0"), np.uint8).reshape(-1, length)


class ByteCnn:
    """Filters are tables: ``tables[w][k, b]`` is what byte b at place k adds to the filters of width w."""

    def __init__(self, languages: list[str], filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.widths = languages, widths
        self.params = {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths}
        self.params["bias"] = np.zeros(filters * len(widths), np.float32)
        self.params["out"] = rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32)
        self.params["out_bias"] = np.zeros(len(languages), np.float32)

    def _pooled(self, x: np.ndarray, places: bool = False):
        """The filters' maxima over each window, and where they are reached."""
        found, at = [], []
        for w in self.widths:
            table, n = self.params[w], x.shape[1] - w + 1
            total = table[0][x[:, :n]]
            for k in range(1, w):
                total += table[k][x[:, k:k + n]]
            if places:
                at.append(total.argmax(axis=1))
            found.append(total.max(axis=1))
        return np.concatenate(found, axis=1) + self.params["bias"], np.concatenate(at, axis=1) if places else None

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages)."""
        pooled = np.concatenate([self._pooled(x[i:i + _CHUNK])[0] for i in range(0, len(x), _CHUNK)])
        z = np.maximum(pooled, 0) @ self.params["out"] + self.params["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 12) -> ByteCnn:
        """Minimises cross-entropy by Adam. Half of the windows are shortened at random, for the sake of short texts."""
        rng, p = np.random.default_rng(seed), self.params
        first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                xb, yb = x[rows].copy(), y[rows]
                cut = rng.integers(6, x.shape[1], len(rows))
                xb[(np.arange(x.shape[1]) >= cut[:, None]) & (rng.random(len(rows)) < 0.5)[:, None]] = 0
                pooled, places = self._pooled(xb, True)
                active = np.maximum(pooled, 0)
                z = active @ p["out"] + p["out_bias"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = z / z.sum(axis=1, keepdims=True)
                dz[np.arange(len(rows)), yb] -= 1
                dz /= len(rows)
                back = (dz @ p["out"].T) * (pooled > 0)
                grads = {"out": active.T @ dz, "out_bias": dz.sum(axis=0), "bias": back.sum(axis=0)}
                done = 0
                for w in self.widths:
                    n = p[w].shape[2]
                    g, at_w = np.zeros_like(p[w]), places[:, done:done + n]
                    for k in range(w):
                        np.add.at(g[k], (xb[np.arange(len(rows))[:, None], at_w + k], np.arange(n)[None, :]), back[:, done:done + n])
                    grads[w], done = g, done + n
                step += 1
                pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    p[name] -= (pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None], rows: int = 8192) -> list[tuple[str, float]]:
        """(language, probability) of every text; ``und`` and 0 for a null text and one without a letter."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        totals, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        waiting, owners = [], []

        def flush():
            logs, owner = self.log_probabilities(np.concatenate(waiting)), np.concatenate(owners)
            np.add.at(totals, owner, logs)
            np.add.at(counts, owner, 1)
            waiting.clear(), owners.clear()

        size = 0
        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                cut = windows_of(text)
                for a in range(0, len(cut), rows):
                    waiting.append(cut[a:a + rows])
                    owners.append(np.full(len(waiting[-1]), i))
                    size += len(waiting[-1])
                    if size >= rows:
                        flush()
                        size = 0
        if waiting:
            flush()
        for i in np.flatnonzero(counts):
            mean = totals[i] / counts[i]
            p = np.exp(mean - mean.max())
            best = int(p.argmax())
            found[i] = (self.languages[best], float(p[best] / p.sum()))
        return found


def training_windows(labelled: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> list[tuple[str, bytes]]:
    """(language, window) of at most ``documents`` documents per language, those with the smallest hash of id
    and language, and at most ``windows`` windows of each, spread over its whole text; in a fixed order."""
    named = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    chosen = named.select("doc_id", "lang").distinct().withColumn("salt", salt_of("doc_id", SALTS))
    for within in (["lang", "salt"], ["lang"]):  # first of each salt, so that no task gets a whole language
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.xxhash64("doc_id", "lang"), "doc_id"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= documents)
    chosen = chosen.select("doc_id", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if text and _LETTER.search(text):
                    rows = windows_of(text)
                    out += [(lang, rows[i].tobytes()) for i in sorted({round(j * (len(rows) - 1) / max(windows - 1, 1)) for j in range(windows)})]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["lang", "window"])

    texts = named.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    found = texts.select("lang", "text").mapInArrow(cut, "lang string, window binary").collect()
    return sorted((r["lang"], bytes(r["window"])) for r in found)


def fit(labelled: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> ByteCnn:
    """A network for the languages of ``labelled`` (doc_id, text, lang); rows without a language are not used."""
    sample = training_windows(labelled, documents, windows)
    languages = sorted({lang for lang, _ in sample})
    network = ByteCnn(languages)
    if len(languages) > 1:
        # every language weighs the same: its windows are repeated up to the most frequent one's
        place = {lang: [w for name, w in sample if name == lang] for lang in languages}
        most = max(map(len, place.values()))
        x = np.frombuffer(b"".join(w for lang in languages for w in (place[lang] * -(-most // len(place[lang])))[:most]), np.uint8).reshape(-1, LENGTH)
        network.train(x, np.repeat(np.arange(len(languages)), most))
    return network


def identify(docs: DataFrame, network: ByteCnn) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text. Without a learned language all are ``und``."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                found += model.value.predict(batch["text"].slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
