"""N-gram Jaccard join, components and substring de-duplication against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stackscan.llm import ngram_join, queries, substring_dedup
from stackscan.llm.components import components
from tests.llm.tables import DOCS, SF, documents, edge_docs, edge_rows, empty_docs


class Union:
    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        self.of[self.find(a)] = self.find(b)


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_of(rows):
    """All pairs of rows, one by one."""
    sets, union = [shingles(t) for _, t in rows], Union()
    for a in range(len(rows)):
        union.find(a)
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                union.join(a, b)
    lowest = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            lowest[union.find(a)].append(i)
    return Counter((i, len(sets[a]), min(lowest[union.find(a)], default=None)) for a, (i, _) in enumerate(rows))


def near_copies(seed, groups=6, size=25):
    """Groups of texts that differ from a common one by a few words, around the bound, and chains of them."""
    rng, rows, n = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" if rng.random() < 0.7 else f"common{rng.randrange(30)}" for _ in range(rng.choice([4, 5, 6, 9, 40, 120]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                base = words
            rows.append((n, " ".join(words[:len(words) - rng.choice([0, 0, 0, 1, 3])])))
            n += 1
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies(spark, seed):
    rows = near_copies(seed)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows), slices=3).collect())
    assert got == near_of(rows)


def test_near_duplicate_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert Counter(tuple(r) for r in queries.op2_ngram_join(spark, SF).collect()) == near_of(rows)


def test_near_edges(spark):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(edge_docs(spark)).collect()) == near_of(rows)
    assert ngram_join.near_duplicates(empty_docs(spark)).count() == 0
    rest = ngram_join.without_near_duplicates(edge_docs(spark))
    assert rest.columns == edge_docs(spark).columns
    assert Counter(r["doc_id"] for r in rest.collect()) == Counter(i for i, _, *_ in edge_rows() if i != 8)


def test_packed_integers_survive():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ngram_join._values(ngram_join._planes(values)) == values).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    lowest = {}
    for v in {x for e in edges for x in e}:
        lowest[union.find(v)] = min(v, lowest.get(union.find(v), v))
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: lowest[union.find(v)] for v in {x for e in edges for x in e} - alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cleaned(rows, min_words=50):
    """Documents in order of id and text hash, each unit kept where it comes first."""
    seen, out = set(), {}
    for doc_id, text in sorted(set((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, substring_dedup._hash(r[1]))):
        repeats = []
        for u, (start, end, unit, words) in enumerate(substring_dedup.units_of(text)):
            if unit in seen:
                repeats.append((u, start, end, words))
            seen.add(unit)
        out[doc_id, text] = substring_dedup.remove_spans(text, repeats, min_words)
    return out


@pytest.mark.parametrize("characters", [200, 8_000_000])
def test_substring_dedup(spark, monkeypatch, characters):
    monkeypatch.setattr(substring_dedup, "BATCH_CHARACTERS", characters)
    for docs in (documents(spark), edge_docs(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = cleaned(rows)
        found = substring_dedup.substring_dedup(docs, slices=3).collect()
        assert len(found) == len(rows)
        for r in found:
            text, spans = want[r["row"]["doc_id"], r["row"]["text"] or ""]
            assert [(s["start"], s["end"]) for s in r["removed"]] == spans and r["n_removed"] == len(spans)
            assert r["text"] == (None if r["row"]["text"] is None else text)
    assert substring_dedup.substring_dedup(empty_docs(spark)).count() == 0


def test_repeated_passages_go_and_clean_text_stays(spark):
    rng = random.Random(8)
    sentence = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (20, 12, 25))
    stock = "All rights reserved."
    rows = [(i, f"{sentence(30)} {stock}\n{sentence(15)} {passage}\n{sentence(9)}" if i % 2 else f"{sentence(30)} {stock}\n{sentence(25)}") for i in range(40)]
    found = {r["row"]["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    for i, text in rows:
        if i % 2 == 0 or i == 1:
            assert found[i]["text"] == text
        else:
            assert passage not in found[i]["text"] and stock in found[i]["text"]
            (span,) = found[i]["removed"]
            assert text[span["start"]:span["end"]] == passage
            assert found[i]["text"] == text.replace(" " + passage, "")


def extended(rows, min_words=50):
    """As ``cleaned``, each run extended by the words that agree next to the earliest occurrence of its outermost units."""
    seen, units, out = {}, {}, {}
    for key in sorted(set((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, substring_dedup._hash(r[1]))):
        text = key[1]
        own = units[key] = substring_dedup.units_of(text)
        words = lambda us: [w for _, _, norm, _ in us for w in norm.decode().split()]
        runs = []
        for u, (start, end, norm, n) in enumerate(own):
            of = seen.setdefault(norm, (key, u))
            if of != (key, u):
                if runs and runs[-1][-1][0] == u - 1:
                    runs[-1].append((u, of))
                else:
                    runs.append([(u, of)])
        covered = [False] * len(text)
        for run in runs:
            (first, (d, e)), (last, (d2, e2)) = run[0], run[-1]
            start, end = own[first][0], own[last][1]
            if first and (d, e) != (key, first - 1):
                for m, w in zip(list(re.finditer(r"\S+", text[:start]))[:-own[first - 1][3] - 1:-1], words(units[d][:e])[::-1]):
                    if m.group().lower() != w:
                        break
                    start = m.start()
            if last + 1 < len(own):
                for m, w in zip(list(re.finditer(r"\S+", text[end:]))[:own[last + 1][3]], words(units[d2][e2 + 1:])):
                    if m.group().lower() != w:
                        break
                    after = own[last][1] + m.end()
                    end = after
            covered[start:end] = [True] * (end - start)
        for i, c in enumerate(text):  # white space between covered words does not part them
            if c.isspace() and i and covered[i - 1]:
                rest = text[i:].lstrip()
                covered[i] = bool(rest) and covered[len(text) - len(rest)]
        spans = [m.span() for m in re.finditer("1+", "".join("01"[c] for c in covered))]
        out[key] = [(s, e) for s, e in spans if len(text[s:e].split()) >= min_words]
    return out


@pytest.mark.parametrize("characters", [200, 8_000_000])
def test_passages_extended_at_their_edges(spark, monkeypatch, characters):
    monkeypatch.setattr(substring_dedup, "BATCH_CHARACTERS", characters)
    repeated = spark.createDataFrame(edge_docs(spark, False).union(documents(spark)).rdd.flatMap(lambda r: [r] * (1 + (r["doc_id"] or 0) % 2)), DOCS).repartition(5)
    for docs in (documents(spark), repeated):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = extended(rows)
        for r in substring_dedup.substring_dedup(docs, slices=3, edges=True).collect():
            assert [(s["start"], s["end"]) for s in r["removed"]] == want[r["row"]["doc_id"], r["row"]["text"] or ""], r["row"]["doc_id"]


@pytest.mark.parametrize("size", [51, 55, 60])
def test_passages_glued_to_their_surroundings_go(spark, monkeypatch, size):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows))
    rng = random.Random(size)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}"
    words = lambda n: " ".join(word() for _ in range(n))
    passage = f"{words(size - 35)}. {words(15)}. {words(20)}"
    rows = [(i, f"{words(20)}. {words(9)} {passage} {words(7)}. {words(12)}.") for i in range(6)]
    for r in queries.op7_substring_dedup(spark, SF).collect():
        text = dict(rows)[r["doc_id"]]
        assert [text[s["start"]:s["end"]] for s in r["removed"]] == ([passage] if r["doc_id"] else [])
        assert r["text"] == (text.replace(" " + passage, "") if r["doc_id"] else text)
