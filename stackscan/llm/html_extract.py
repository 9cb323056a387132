"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is a sequence of blocks, each inside or outside the article. Features say which elements stand
around a block, what their authors named them, and how its text and its neighbours' look. Weights of
features and of transitions are trained on labelled pages by the gradient of the conditional likelihood;
the best labels of a whole page are found by Viterbi's algorithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.html_blocks import EMBEDDED, Block, Node, blocks_of
from stackscan.llm.labelled_pages import embedding_pages, labelled_pages

#: Labelled pages, such with embedded elements, passes over them, step size, and weight of the square penalty.
PAGES, EMBEDDING, EPOCHS, RATE, PENALTY = 600, 60, 12, 0.15, 1e-4
#: What words in class, id, role and label attributes hint at.
HINTS = {
    "menu": "nav navbar menu breadcrumb breadcrumbs toolbar tabs navigation pagination pager skip",
    "head": "header head masthead topbar branding logo",
    "foot": "footer foot copyright legal colophon bottom contentinfo",
    "side": "sidebar side aside related widget widgets recommended recommendations popular trending tags tag share sharing social toc archive author complementary",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription paywall banner overlay disclaimer",
    "ad": "ad ads adv advert adverts advertisement advertising sponsored sponsor promo promotion promoted adbox adslot adsense",
    "comment": "comment comments commentlist reply replies discussion respond responses disqus",
    "form": "form login search signup signin register",
    "main": "content post entry article story main text body page",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_TELLING = frozenset("article main nav header footer aside form section ul ol li table td th blockquote pre figure figcaption dl menu search dialog h1 h2 h3 h4 h5 h6 p div".split())
_END = re.compile(r"[.!?…:\"»”)]$")


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


class _Around(NamedTuple):
    """What the features ask of a path; bounded, whatever its depth."""

    tags: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()
    near: frozenset[str] = frozenset()
    scope: str = "none"
    hidden: bool = False


def _around(node: Node | None, known: dict[int, _Around]) -> _Around:
    """The summary of the path to ``node``, from that of its parent; ``known`` holds those of a page by path."""
    waiting = []
    while node and node.way not in known:
        waiting.append(node)
        node = node.parent
    found = known[node.way] if node else _Around()
    for node in reversed(waiting):
        tag, own = node.element.tag, frozenset(_HINT[n] for n in node.element.names if n in _HINT)
        # the innermost element that tells an article from its surroundings
        telling = own or tag in ("article", "main", "nav", "header", "footer", "aside", "form", "menu", "dialog", "search")
        found = known[node.way] = _Around(
            found.tags | {tag} if tag in _TELLING or tag in EMBEDDED else found.tags, found.hints | own, own or found.near,
            "+".join([tag if tag in _TELLING else "x", *sorted(own)]) if telling else found.scope, found.hidden or node.element.hidden)
    return found


def _own(block: Block, around: _Around, in_article: bool) -> list[str]:
    """Features of a block by itself."""
    out = ["one", "parent:" + (block.at.element.tag if block.at else "none")]
    out += ["in:" + t for t in sorted(around.tags)]
    out += ["hint:" + h for h in sorted(around.hints)]
    out += ["near:" + h for h in sorted(around.near)]
    out.append("scope:" + around.scope)
    if in_article:
        out.append("page has article, " + ("inside" if {"article", "main"} & around.tags else "outside"))
    else:
        out.append("page has none, " + ("named" if "main" in around.hints else "unnamed"))
    if around.hidden:
        out.append("hidden")
    text, n = block.text, len(block.text)
    out.append(f"length:{_bin(n, (12, 30, 80, 200, 500))}")
    out.append(f"links:{_bin(block.linked / n, (0.01, 0.3, 0.7))}")
    if _END.search(text):
        out.append("ends")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if "|" in text or "·" in text:
        out.append("bar")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of the features that hold for each block."""
    known: dict[int, _Around] = {}
    arounds = [_around(b.at, known) for b in blocks]
    in_article = any({"article", "main"} & a.tags for a in arounds)
    out, n = [_own(b, a, in_article) for b, a in zip(blocks, arounds)], len(blocks)
    parents = [b.at.parent.way if b.at and b.at.parent else 0 for b in blocks]
    for i, block in enumerate(blocks):
        out[i].append("first" if i == 0 else "same as before" if parents[i - 1] == parents[i] else "other than before")
        if i + 1 < n:
            out[i].append(f"next length:{_bin(len(blocks[i + 1].text), (30, 200))}")
        else:
            out[i].append("last")
        if i:
            out[i].append(f"length before:{_bin(len(blocks[i - 1].text), (30, 200))}")
    return out


class Crf:
    """Two labels; ``weights`` (features, 2), ``moves`` (label, next label)."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.weights, self.moves = np.zeros((0, 2)), np.zeros((2, 2))

    def _scores(self, names: list[list[str]]) -> np.ndarray:
        place, weights = self.place, self.weights
        return np.array([weights[[place[f] for f in fs if f in place]].sum(axis=0) for fs in names]).reshape(-1, 2)

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, seed: int = 3) -> Crf:
        """Stochastic gradient ascent of the conditional log-likelihood, page by page, with adaptive steps."""
        for names, _ in pages:
            for fs in names:
                for f in fs:
                    self.place.setdefault(f, len(self.place))
        self.weights = np.zeros((len(self.place), 2))
        square, square_moves = np.full((len(self.place), 2), 1e-6), np.full((2, 2), 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for p in rng.permutation(len(pages)):
                names, labels = pages[p]
                if not labels:
                    continue
                scores, y = self._scores(names), np.asarray(labels)
                forward, backward = self._sums(scores)
                total = np.logaddexp(*forward[-1])
                share = np.exp(forward + backward - total)
                share[np.arange(len(y)), y] -= 1
                moves = np.zeros((2, 2))
                if len(y) > 1:
                    moves = np.exp(forward[:-1, :, None] + self.moves + (scores + backward)[1:, None, :] - total).sum(axis=0)
                    np.add.at(moves, (y[:-1], y[1:]), -1)
                rows = np.array([self.place[f] for fs in names for f in fs])
                grad = np.zeros_like(self.weights)
                np.add.at(grad, rows, np.repeat(share, [len(fs) for fs in names], axis=0))
                grad += penalty * self.weights
                square += grad**2
                square_moves += moves**2
                self.weights -= rate * grad / np.sqrt(square)
                self.moves -= rate * moves / np.sqrt(square_moves)
        return self

    def _sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-sums over all labellings up to each block, and of those after it."""
        n = len(scores)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for i in range(1, n):
            forward[i] = scores[i] + np.logaddexp(forward[i - 1, 0] + self.moves[0], forward[i - 1, 1] + self.moves[1])
        for i in range(n - 2, -1, -1):
            after = scores[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(self.moves[:, 0] + after[0], self.moves[:, 1] + after[1])
        return forward, backward

    def decode(self, names: list[list[str]]) -> list[int]:
        """The labelling of the highest score (Viterbi); 0 on a tie."""
        if not names:
            return []
        (aa, ab), (ba, bb) = self.moves.tolist()
        rows = self._scores(names).tolist()
        a, b = rows[0]
        back = []
        for x, y in rows[1:]:
            back.append((int(b + ba > a + aa), int(b + bb > a + ab)))
            a, b = x + max(a + aa, b + ba), y + max(a + ab, b + bb)
        label = int(b > a)
        found = [label]
        for step in reversed(back):
            label = step[label]
            found.append(label)
        return found[::-1]


def fit(pages: list[tuple[str, list[int]]] | None = None) -> Crf:
    """A field trained on (html, label of each block); by default on pages of ``labelled_pages``."""
    pages = labelled_pages(PAGES) + embedding_pages(EMBEDDING) if pages is None else pages
    known = []
    for html, labels in pages:
        blocks = blocks_of(html)
        if len(blocks) != len(labels):
            raise ValueError("a page has another number of blocks than labels")
        known.append((features(blocks), labels))
    return Crf().train(known)


def main_text(html: str | None, field: Crf) -> str:
    """The article's blocks joined by line breaks; empty for a null or empty page."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(features(blocks))) if label)


def extract(pages: DataFrame, field: Crf) -> DataFrame:
    """(row, text) of every row of ``pages`` with its ``html``; equal pages have equal texts."""
    model = pages.sparkSession.sparkContext.broadcast(field)
    rows = pages.select(F.struct("*").alias("row"), "html")
    kind = rows.schema["row"].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(html.as_py(), model.value) for html in batch["html"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], texts], names=["row", "text"])

    return rows.mapInArrow(extracted, f"row {kind}, text string")
