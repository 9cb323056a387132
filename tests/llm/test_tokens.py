"""Token ids, packing, byte-level BPE and Arrow files against the libraries and against rules."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from stackscan.llm import arrow_ids, byte_bpe, packing, queries, token_ids
from stackscan.llm.common import fresh_folder
from tests.llm.tables import SF, documents, edge_docs, edge_rows, empty_docs

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "  a  b ", "a\n b", "a \nb", "a \n  b", "\n\n", "\t x", "<|endoftext|> x", "it's 'll we're  ok ''s", "é b ß ñ º", "日本語 のテキスト  ",
         "\x1c\x1d a\x85b\xa0c", "a" * 3001, "xyz" * 999, "1234567 890²", "😀 😀😀", "á é", " 　 x", "word.\nNext,line!"] + [t or "" for _, t, *_ in edge_rows()]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.TextCodec(MULTI, public_tokenizers.PATTERN)


def wild(n, seed=4):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", "'s", "'", "a", "the", "Ü", "ñ", "5", "½", "_", "!", "\xa0", "​", "中", "😀", "\x85", "ɏ", "ɐ", "\x1f"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(n)]


def test_chunk_encoder_equals_the_library(library):
    encoder = token_ids.ChunkEncoder(JSON)
    for text in TEXTS + wild(2000):
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_of_chunks_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_ids, "MEMO", 5)
    encoder = token_ids.ChunkEncoder(JSON)
    for text in wild(200):
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.pieces) < 60


def test_byte_bpe_equals_the_library(codec, reference):
    for text in TEXTS + wild(2000):
        ids = codec.encode(text).tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 1000):
        keys = [b"key%d" % i for i in range(n)]
        table = byte_bpe.PerfectHash(keys)
        assert sorted(map(table.slot, keys)) == list(range(n))
        assert 0 <= table.slot(b"another") < n


def test_byte_bpe_query(spark, reference):
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    rows = documents(spark).collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_byte_bpe_tables(spark, reference):
    ids = byte_bpe.encode_texts(edge_docs(spark), MULTI, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((i, tuple(reference.encode_ordinary(t or ""))) for i, t, *_ in edge_rows())
    back = byte_bpe.decode_ids(ids, MULTI, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in edge_rows())
    assert byte_bpe.round_trip(edge_docs(spark), MULTI, public_tokenizers.PATTERN).count() == len(edge_rows())
    assert byte_bpe.round_trip(empty_docs(spark), MULTI, public_tokenizers.PATTERN).count() == 0


def slow_pack(vectors, limits):
    """The number of sequences that the rule makes, by trying every example at every step."""
    left, number, room = list(range(len(vectors))), 0, np.array(limits)
    while left:
        fitting = [i for i in left if (vectors[i] <= room).all()]
        if not fitting:
            number, room = number + 1, np.array(limits)
            continue
        best = max(fitting, key=lambda i: (round(float((vectors[i] / limits) @ (room / limits)), 9), tuple(vectors[i])))
        left.remove(best)
        room = room - vectors[best]
    return number + 1


def test_pack_follows_the_rule():
    rng, limits = np.random.default_rng(1), np.array((16, 4, 12))
    for _ in range(20):
        tokens = rng.integers(0, 17, 50)
        vectors = np.column_stack([tokens, np.ones(50, int), np.minimum(tokens, rng.integers(0, 13, 50))])
        sequence, place = packing.pack(vectors, tuple(limits))
        for s in np.unique(sequence):
            assert (vectors[sequence == s].sum(axis=0) <= limits).all()
            assert sorted(place[sequence == s]) == list(range((sequence == s).sum()))
        assert abs(sequence.max() + 1 - slow_pack(vectors, limits)) <= 1
    with pytest.raises(ValueError):
        packing.pack(np.array([[17, 1, 1]]), tuple(limits))
    assert packing.pack(np.zeros((0, 3), int), tuple(limits))[0].tolist() == []


def check_pieces(rows, ids_of, size=1024, segments=128):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and len(pieces) <= segments
    for doc_id, pieces in by_doc.items():
        want = Counter()
        for ids in ids_of[doc_id]:
            for s in range(0, len(ids), size):
                some = np.array(ids[s:s + size], "<u4")
                want[s, len(some), zlib.crc32(some.tobytes()), len(ids)] += 1
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want
    assert set(by_doc) == set(ids_of)
    return 1 - sum(r["length"] for r in rows) / (size * max(1, len(by_sequence)))


def test_packing_query(spark, library):
    ids = {r["doc_id"]: [library.encode(r["text"], add_special_tokens=False).ids + [0]] for r in documents(spark).collect()}
    assert check_pieces(queries.op8_vector_packing(spark, SF).collect(), ids) < 0.02


def test_packing_edges(spark, library):
    ids = defaultdict(list)
    for i, t, *_ in edge_rows():
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    check_pieces(packing.pack_documents(edge_docs(spark), JSON, group=4).collect(), ids)
    assert packing.pack_documents(empty_docs(spark), JSON).count() == 0


def test_packing_conversations(spark):
    """The limits on segments and on loss-bearing tokens hold as well."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr(
        "conv_id", "turn", "role", "size(split(text, ' ')) as t", "if(role = 'assistant', size(split(text, ' ')), 0) as l")
    sizes = turns.groupBy("conv_id").agg({"t": "sum", "l": "sum"}).selectExpr("conv_id", "`sum(t)` as tokens", "`sum(l)` as loss", "'x' as offset")
    limits = (4096, 3, 1500)
    small = sizes.where(f"tokens <= {limits[0]} and loss <= {limits[2]}")
    got = defaultdict(list)
    for r in packing.pack_examples(small, "conv_id", "tokens", "loss", limits, group=16).collect():
        got[r["sequence_id"]].append(r)
    assert sum(map(len, got.values())) == small.count()
    for rows in got.values():
        assert sum(r["tokens"] for r in rows) <= limits[0] and len(rows) <= limits[1] and sum(r["loss"] for r in rows) <= limits[2]


def stream_of(rows, library, end=2):
    """Documents in order with the ids before each."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_arrow_query(spark, library):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    assert sorted(map(tuple, queries.op10_arrow_ids(spark, SF).collect())) == stream_of(rows, library)


@pytest.mark.parametrize("length", [7, 1024])
def test_arrow_files(spark, library, length):
    folder = fresh_folder(spark, "test-arrow")
    parts = arrow_ids.write_files(edge_docs(spark).repartition(3), folder, JSON, length)
    got = arrow_ids.read_files(parts, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in edge_rows())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, *_ in edge_rows()), key=lambda i: (i is not None, i or 0))
    total = 0
    for part in parts.collect():
        sequences, docs = arrow_ids.open_part(folder, part["part"])
        real = sum(int(sequences.sequence(i)[1].sum()) for i in range(len(sequences)))
        assert real == part["n_ids"] and docs.num_rows == part["n_docs"]
        assert all(len(sequences.sequence(i)[0]) == length for i in range(len(sequences)))
        total += real
    assert total == at


def test_sequences_are_views_of_the_file(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        writer = arrow_ids.SequenceWriter(sink, 4, "uint16")
        for n in (3, 9, 5000):
            writer.add(np.arange(n, dtype=np.uint32))
        writer.close()
    before = pa.total_allocated_bytes()
    sequences = arrow_ids.SequenceFile(pa.memory_map(path))
    assert sequences.sequence(1)[0].tolist() == [1, 2, 3, 4] and sequences.sequence(len(sequences) - 1)[1].tolist() == [True] * 4
    assert np.concatenate(sequences.ids(12, 5000)).tolist() == list(range(5000))
    assert pa.total_allocated_bytes() == before


def test_arrow_empty(spark):
    assert arrow_ids.encode_to_files(empty_docs(spark), JSON).count() == 0


ADDED = ["<|endoftext|>", "hi <|endoftext|> you", "<|endoftext|><|endoftext|>  x\n <|endoftext|>", "<|endoftext|", "no token here"]


def test_added_tokens_are_one_id(spark):
    library, encode = Tokenizer.from_file(JSON), token_ids.encoder(JSON).encode
    for text in TEXTS + ADDED:
        assert np.frombuffer(encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    rows = list(enumerate(ADDED))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(packing.pack_documents(docs, JSON).collect(), {i: [library.encode(t, add_special_tokens=False).ids + [0]] for i, t in rows})
    assert sorted(map(tuple, arrow_ids.encode_to_files(docs, JSON).collect())) == stream_of(rows, library)


SPACES = ["a\n \nb", "a\n ", "\n \t\n a", " \n \n b c\n d", "a\t \n", "\n b", " ", "a \n b\n "]


def test_vocabularies_that_mix_white_space(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"\n ": 256, b" \n": 257, b"\t ": 258}
    (tmp_path / "mixed.tiktoken").write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % r for k, r in ranks.items()))
    codec = byte_bpe.TextCodec(str(tmp_path / "mixed.tiktoken"), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("mixed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(JSON, encoding="utf-8") as file:
        spec = json.load(file)
    for i, pair in enumerate((["\u010a", "\u0120"], ["\u0109", "\u0120"])):
        spec["model"]["vocab"]["".join(pair)] = 50257 + i
        spec["model"]["merges"].insert(0, pair)
    (tmp_path / "mixed.json").write_text(json.dumps(spec), encoding="utf-8")
    encoder, library = token_ids.ChunkEncoder(str(tmp_path / "mixed.json"), added=True), Tokenizer.from_file(str(tmp_path / "mixed.json"))
    for text in SPACES + wild(2000, seed=9):
        assert codec.encode(text).tolist() == reference.encode_ordinary(text), repr(text)
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_examples_without_a_key_are_spread(spark):
    rows = spark.range(900).selectExpr("IF(id % 3 = 0, NULL, id) AS k", "CAST(id % 50 + 1 AS INT) AS t", "1 AS l")
    same = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS k", "7 AS t", "1 AS l")
    for table in (rows, same):
        found = packing.pack_examples(table, "k", "t", "l", (100, 10, 100), group=100)
        placed = found.selectExpr("sequence_id >> 32 AS g", "*").toPandas()
        assert placed[placed["k"].isna()].groupby("g").size().max() < 160
        assert sorted(placed["t"]) == sorted(r.t for r in table.collect())
        assert placed.groupby("sequence_id")["t"].agg(["sum", "size"]).max().tolist() <= [100, 10]
