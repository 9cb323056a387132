"""The alignment of two tokenizers against the libraries and a plain count."""

import gc
import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stackscan.llm import queries, token_anchors
from tests.llm.tables import SF, documents, edge_docs, edge_rows, empty_docs
from tests.llm.test_tokens import TEXTS, wild

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a \u2581 b", "\u2581", "\ufb01 \u2167 x", "tail ", " head", "<s> </s> <unk> <0x41>", "x" * 300 + " y", "caf\u00e9 \u00e9t\u00e9", "\x00 nul", "\u2028 line"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = _letters()


def slow(libraries, text):
    """(ids of a, ids of b, groups) by the rule: cut wherever both have a token's end."""
    if not text:
        return [], [], []
    first, second = libraries
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    place_a, place_b = ({end: k for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = place_a[end] + 1, place_b[end] + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups


def slow_rows(libraries, rows):
    aligned = [(doc_id, *slow(libraries, text)) for doc_id, text in rows]
    counts = Counter((a[-1], b[-1]) for *_, groups in aligned for a, b in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc_id, a, b, groups in aligned:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_wild_texts(libraries):
    own = token_anchors.Aligner(JSON, MODEL)
    texts = TEXTS + MORE + wild(1500)
    found = own.align(texts)
    groups, docs = found.groups()
    written = found.texts().to_pylist()
    for n, text in enumerate(texts):
        a, b, want = slow(libraries, text)
        assert found.a[found.docs_a[n]:found.docs_a[n + 1]].tolist() == a, repr(text)
        assert found.b[found.docs_b[n]:found.docs_b[n + 1]].tolist() == b, repr(text)
        i = j = 0
        cut = []
        for end_a, end_b, link in groups[docs[n]:docs[n + 1]].tolist():
            cut.append((a[i:end_a], b[j:end_b]))
            assert link == a[end_a - 1] * token_anchors.STEP + b[end_b - 1]
            i, j = end_a, end_b
        assert cut == want, repr(text)
        assert written[n] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)


def test_little_memory_gives_the_same(libraries, monkeypatch):
    for name in ("CHUNKS", "WINDOWS", "LONG_CHUNK", "LONG_WINDOW"):
        monkeypatch.setattr(token_anchors, name, 3)
    own = token_anchors.Aligner(JSON, MODEL)
    for text in wild(200) + MORE:
        found = own.align([text, "", text])
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slow(libraries, text)[2])
        assert found.texts().to_pylist() == [want, "", want]


def test_query_equals_the_rule(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    found = queries.op13_token_anchors(spark, SF)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == slow_rows(libraries, rows)


def test_edges(spark, libraries):
    rows = [(doc_id, text) for doc_id, text, *_ in edge_rows()]
    found = token_anchors.token_anchors(edge_docs(spark), JSON, MODEL)
    assert sorted(map(tuple, found.collect()), key=str) == slow_rows(libraries, rows)
    assert token_anchors.token_anchors(empty_docs(spark), JSON, MODEL).collect() == []
    spans = token_anchors.align_documents(edge_docs(spark), JSON, MODEL).collect()
    want = []
    for doc_id, text in rows:
        a, b, groups = slow(libraries, text)
        want.append((doc_id, a, b, *[np.cumsum([len(g[k]) for g in groups]).astype(int).tolist() for k in (0, 1)]))
    assert sorted(map(str, map(tuple, spans))) == sorted(map(str, want))
    assert token_anchors.align_documents(empty_docs(spark), JSON, MODEL).collect() == []


def test_links_are_bounded_by_the_vocabularies(spark):
    own = token_anchors.Aligner(JSON, MODEL)
    links = token_anchors.linked_documents(documents(spark), JSON, MODEL)
    for r in token_anchors.link_counts(links).collect():
        a, b = own.bytes_a[r["link"] // token_anchors.STEP], own.bytes_b[r["link"] % token_anchors.STEP]
        assert a.endswith(b) or b.endswith(a)
    ends_b = Counter(own.bytes_b)
    ends_a = Counter(own.bytes_a)
    most = sum(ends_b[a[i:]] for a in own.bytes_a for i in range(len(a))) + sum(ends_a[b[i:]] for b in own.bytes_b for i in range(1, len(b)))
    assert most < 1_000_000


def test_what_an_aligner_remembers_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_anchors, "CHUNKS", 100)
    own = token_anchors.Aligner(JSON, MODEL)
    for i in range(40):
        own.align([" ".join(f"word{chr(97 + j)}{chr(97 + i % 26) * (1 + i // 26)}, x{i}-{j}" for j in range(26))])
    for memo in (own.chunks, own.encoder.pieces, own.encoder.spaced):
        assert len(memo) + len(memo.older) <= 400


def test_a_remembered_word_takes_little_memory():
    own = token_anchors.Aligner(JSON, MODEL)
    letters = [chr(97 + i) for i in range(26)]
    own.align(["a word"])
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    own.align([" ".join(f"{x}{y}{z}u" for x in letters for y in letters for z in letters)])
    gc.collect()
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(own.chunks) >= 26 ** 3
    assert taken < 200 * 26 ** 3


def test_the_parts_asked_for_last_are_remembered(libraries, monkeypatch):
    monkeypatch.setattr(token_anchors, "CHUNKS", 8)
    monkeypatch.setattr(token_anchors, "WINDOWS", 2)
    own = token_anchors.Aligner(JSON, MODEL)
    for i in range(30):
        text = f"always here and new{i} words{i} {'long' * 20}{i}"
        found = own.align([text, "bad \u2581 part"])
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slow(libraries, text)[2])
        assert found.texts().to_pylist()[0] == want
        assert len(own.chunks) <= 8 and {"always", "here", "and"} <= set(own.chunks.parts.to_pylist())
    assert max(map(len, own.chunks.parts.to_pylist())) <= token_anchors.LONG_CHUNK
