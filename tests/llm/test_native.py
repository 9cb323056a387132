"""Quality rules, exact de-duplication and sharding against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from stackscan.llm import exact_dedup, quality_rules, queries, sharding
from tests.llm.tables import DOCS, SF, documents, edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORD.findall(text or "")]

    def one(value, seed):
        return signed(xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed=seed & (1 << 64) - 1))

    pairs = [one(b, one(a, 42)) for a, b in zip(hashes, hashes[1:])]
    return [g % buckets for g in hashes + pairs]


def test_measures(spark):
    rows = edge_rows() + [(100 + i, r["text"], None, None, None) for i, r in enumerate(documents(spark).collect())]
    frame = quality_rules.score(spark.createDataFrame(rows, DOCS), [0.0] * 16)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *[r[c] for c in names]) for r in frame.select("doc_id", *names).collect())
    assert got == Counter((i, *measures(t)) for i, t, *_ in rows)


@pytest.mark.parametrize("buckets", [64, 1 << 14])
def test_scores_and_verdicts(spark, buckets):
    docs = documents(spark).select("doc_id", "text").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chosen = {r["chosen"]: r["fits"] for r in quality_rules.chosen_ids(quality_rules.trusted_ids(labels), 20_000).collect()}
    counted = {r["doc_id"]: Counter(grams(r["text"], buckets)) for r in docs}
    raw, target = Counter(), Counter()
    for i, c in counted.items():
        raw += c
        if chosen.get(i):
            target += c
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] * n_raw / raw[b] + buckets) / (n_target + buckets)) for b in raw}
    score = {i: sum(ratio[b] * k for b, k in c.items()) / max(1, sum(c.values())) for i, c in counted.items()}
    held = sorted(score[i] for i, fits in chosen.items() if not fits and i in score)
    at = 0.005 * (len(held) - 1)
    low = held[int(at)] + (held[math.ceil(at)] - held[int(at)]) * (at - int(at))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark), quality_rules.trusted_ids(labels), buckets=buckets).collect()}
    for r in docs:
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9)
        assert row["base_failed"] == measures(r["text"])[-1]
        if abs(row["score"] - min(-0.06, low)) > 1e-9:
            assert row["kept"] == (not row["base_failed"] and row["score"] >= min(-0.06, low))


def test_quality_of_labelled_documents(spark):
    """At a size where counts are dense: nearly all documents labelled bad go, nearly all good ones stay."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality_rules(spark, sf).select("doc_id", "kept", "base_failed").collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.1


def test_quality_edges(spark):
    trusted = spark.createDataFrame([(7,), (None,), (999,)], "doc_id long")
    found = quality_rules.quality_rules(edge_docs(spark), trusted)
    assert found.count() == len(edge_rows())
    assert {r["kept"] for r in found.where("n_words = 0").collect()} == {False}
    assert found.select("row.*").columns == edge_docs(spark).columns
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.quality_rules(empty_docs(spark), none).count() == 0
    assert {r["score"] for r in quality_rules.quality_rules(edge_docs(spark), none).collect()} == {0.0}


def dedup_of(rows, keep=max):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        stays = keep(named) if named else None
        for i in ids:
            out[i, stays, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("leaves,bits,keep", [(256, 4, "largest"), (8, 1, "smallest"), (1, 2, "largest")])
def test_exact_dedup(spark, leaves, bits, keep):
    pick = {"largest": max, "smallest": min}[keep]
    for docs in (edge_docs(spark), documents(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, keep=keep, leaves=leaves, bits=bits).collect())
        assert got == dedup_of(rows, pick)
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0


def test_without_copies(spark):
    docs = edge_docs(spark)
    rest = exact_dedup.without_copies(docs)
    assert rest.columns == docs.columns
    texts = [lower(r["text"]) for r in rest.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t, *_ in edge_rows()})
    assert exact_dedup.without_copies(empty_docs(spark)).count() == 0


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(len(by[s]) for s in range(shards)) <= 1
    for s, members in by.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return by


def test_shards_hold_sources_in_proportion(spark):
    rows = queries.op6_stratified_shards(spark, "/root/testdata/sf0.01").collect()
    given = {r["doc_id"]: r for r in documents(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(given)
    for r in rows:
        data = (given[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by, sources = check_shards(rows, 16), Counter(r["source"] for r in given.values())
    for members in by.values():
        own = Counter(given[r["doc_id"]]["source"] for r in members)
        assert all(abs(own[s] - n / 16) <= 2 for s, n in sources.items())


def test_shard_edges(spark):
    rows = sharding.stratified_shards(edge_docs(spark), order=("doc_id", "text"), cells=8).collect()
    check_shards(rows, 16)
    assert len(rows) == len(edge_rows()) and len({c for c in rows[0].asDict()}) == len(edge_docs(spark).columns)
    assert sharding.stratified_shards(sharding.sized(empty_docs(spark))).count() == 0
    few = sharding.stratified_shards(sharding.sized(edge_docs(spark)), shards=3)
    check_shards(few.collect(), 3)
    again = sharding.stratified_shards(sharding.sized(edge_docs(spark).repartition(5)), shards=3)
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, again.collect()))


def test_texts_that_fail_the_base_rules_do_not_set_the_threshold(spark):
    """Short trusted texts of rare words score low; they must not let a bad document of the same words pass."""
    good = [(i, " ".join(f"w{(i * 7 + k) % 60}" for k in range(60)), None, None, None) for i in range(200)]
    short = [(1000 + i, f"odd{i} rare{i}", None, None, None) for i in range(60)]
    bad = [(2000, " ".join(f"junk{k} junk{k + 1}" for k in range(0, 120, 2)), None, None, None)]
    docs = spark.createDataFrame(good + short + bad, DOCS)
    trusted = docs.where("doc_id < 2000").select("doc_id")
    ratios = quality_rules.fit(docs, trusted)
    assert quality_rules.calibrate(docs, trusted, ratios, sound=True) == -0.06
    assert quality_rules.calibrate(docs, trusted, ratios) < -0.06
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, trusted, sound=True).where("kept").collect()}
    assert kept == set(range(200))


def test_all_held_out_trusted_documents_set_the_threshold(spark):
    docs = documents(spark)
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    ratios = quality_rules.fit(docs, trusted)
    held = {r["chosen"] for r in quality_rules.chosen_ids(trusted, 20_000).where("not fits").collect()}
    scores = [r["score"] for r in quality_rules.score(docs, ratios).collect() if r["doc_id"] in held and not r["base_failed"]]
    assert len(scores) < 200
    for limit in (0, 2, 20_000):
        assert quality_rules.calibrate(docs, trusted, ratios, threshold=1.0, limit=limit, sound=True) == pytest.approx(min(scores))
