"""Matching and scoring on small fixtures."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stackscan.model import ScanConfig
from stackscan.operators.candidates import Part, candidate_rows
from stackscan.operators import candidates, match
from stackscan.operators.match import detect, matched_signatures, signature_matches
from stackscan.sources.signatures import compile_library, signature_rows, with_weights

PAGE = ("page_id long, html string, scripts array<struct<src:string,version:string>>, network_hosts array<string>, "
        "headers map<string,string>, meta map<string,string>, js_objects map<string,boolean>, "
        "cookies array<struct<name:string,value:string>>, version_info map<string,string>")


def pages(spark, *rows):
    names = [c.strip().split(" ")[0] for c in PAGE.split(", ")]
    data = [tuple({"page_id": i, **row}.get(n) for n in names) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, PAGE)


def library(spark, rows, **options):
    return compile_library(*signature_rows(spark, rows), **options)


def scores(frame):
    return {(r.page_id, r.tech): r.confidence for r in frame.collect()}


def test_globals_need_runtime_presence(spark):
    lib = library(spark, [("T", "js", n, "") for n in ("s", "va", "wp", "ga", "PS", "Banner")])
    found = detect(pages(spark, {"html": "s va wp ga PS Banner", "js_objects": {}}), lib, ["page_id"], ScanConfig(min_confidence=0))
    assert found.count() == 0


def test_weights(spark):
    lib = library(spark, [
        ("Search", "js", "algoliasearch", ""), ("Overlay", "html", None, "userway"), ("Widget", "script", None, r"userway\.org"),
        ("Net", "network", None, r"dsn\.algolia"), ("Head", "header", "X-Powered-By", ""), ("Meta", "meta", "Generator", "^WordPress"),
        ("Cook", "cookie", "sid", ""), ("CookValue", "cookie", "sid", "^v[0-9]$")])
    page = {"html": '<script src="https://cdn.USERWAY.org/w.js">', "js_objects": {"algoliasearch": True},
            "scripts": [("https://cdn.userway.org/widget.js", None)], "network_hosts": ["x-DSN.algolia.net"],
            "headers": {"x-powered-by": "PHP"}, "meta": {"generator": "wordpress 6"}, "cookies": [("sid", "v1"), ("sid", "zzz")]}
    assert scores(detect(pages(spark, page), lib, ["page_id"])) == {
        (0, "Search"): 80, (0, "Overlay"): 40, (0, "Widget"): 60, (0, "Net"): 70, (0, "Head"): 80, (0, "Meta"): 100,
        (0, "Cook"): 70, (0, "CookValue"): 70}


def test_first_cookie_of_a_name_counts_and_empty_values_are_absent(spark):
    lib = library(spark, [("A", "cookie", "sid", "^second$"), ("B", "header", "server", ""), ("C", "meta", "x", "")])
    page = {"cookies": [("sid", "first"), ("sid", "second")], "headers": {"server": ""}, "meta": {"x": ""}}
    assert scores(detect(pages(spark, page), lib, ["page_id"])) == {}


def test_score_is_capped_and_html_evidence_stops_at_eleven(spark):
    words = [f"word{i:02d}" for i in range(15)]
    lib = library(spark, [("Many", "html", None, w) for w in words] + [("Many", "script", None, "x")])
    page = {"html": " ".join(words), "scripts": [("x", None)]}
    row = detect(pages(spark, page), lib, ["page_id"]).collect()[0]
    assert row.confidence == 100
    assert row.evidence == [f"HTML: {w}" for w in words[:11]] + ["Script: x"]


def test_threshold_and_rank_ties_follow_library_order(spark):
    lib = library(spark, [("B", "html", None, "tok"), ("A", "html", None, "tok"), ("C", "meta", "k", "v")])
    found = detect(pages(spark, {"html": "tok", "meta": {"k": "v"}}), lib, ["page_id"], ScanConfig(min_confidence=40)).orderBy("rank")
    assert [r.tech for r in found.collect()] == ["C", "B", "A"]
    assert detect(pages(spark, {"html": "tok"}), lib, ["page_id"], ScanConfig(min_confidence=41)).count() == 0


def test_bad_pattern_is_set_aside_and_the_rest_still_scores(spark):
    lib = library(spark, [("T", "html", None, "(open"), ("T", "html", None, "fine"), ("T", "html", None, "a{{b}}")])
    assert [r.pattern for r in lib.rejected.collect()] == ["(open"]
    assert scores(detect(pages(spark, {"html": "fine a{{b}}"}), lib, ["page_id"])) == {(0, "T"): 80}


def test_versions(spark):
    lib = library(spark, [("jQuery UI", "html", None, "ui"), ("Other", "html", None, "ui")])
    page = {"html": "ui", "version_info": {"jquery": "3.6"}, "scripts": [("a", None), ("b", "1.2"), ("c", "9")]}
    loose = {r.tech: r.version for r in detect(pages(spark, page), lib, ["page_id"]).collect()}
    strict = {r.tech: r.version for r in detect(pages(spark, page), lib, ["page_id"], ScanConfig(loose_version=False)).collect()}
    assert loose == {"jQuery UI": "3.6", "Other": "1.2"}
    assert strict == {"jQuery UI": "3.6", "Other": None}


def test_missing_evidence_columns_give_no_matches(spark):
    lib = library(spark, [("T", "header", "server", "x"), ("T", "js", "g", ""), ("T", "dom", "title", "x"), ("U", "html", None, "abc")])
    bare = spark.createDataFrame([(1, "ABC")], "page_id long, html string")
    assert scores(detect(bare, lib, ["page_id"])) == {(1, "U"): 40}


def test_prefilter_and_any_number_of_parts_agree(spark):
    rng = random.Random(7)
    tokens = ["cdn.vendor.com", "wp-content", "K", "Kelvin", "İstanbul", "foo bar", "a+b", "ga(", "$(", "Moodle", "x{2}", "é", "\n"]
    patterns = [r"cdn\.vendor\.com", "wp-(?:content|includes)", "kelvin", "istanbul", r"foo\s+bar", r"a\+b", r"ga\(", r"\$\(", "moodle|sakai",
                "colou?r", "^foo", "b$", "[a-c]+x", "é", "fo{1,2} bar", "a|b", "", "ga", r"\bbar\b"]
    rows = [{"html": " ".join(rng.choices(tokens, k=4)), "scripts": [(rng.choice(tokens), None)],
             "headers": {"server": rng.choice(tokens)}, "js_objects": {"g": rng.random() < 0.5}} for _ in range(60)]
    rules = [(f"T{i % 5}", kind, None, p) for i, p in enumerate(patterns) for kind in ("html", "script")]
    rules += [("H", "header", "Server", p) for p in patterns] + [("J", "js", "g", "")]
    frame = pages(spark, *rows)
    lib = library(spark, rules)
    want = sorted(map(str, signature_matches(frame, lib, ["page_id"], prefilter=False).collect()))
    assert want
    for part in (3, 10, 20_000):
        assert sorted(map(str, signature_matches(frame, lib, ["page_id"], part=part).collect())) == want
        assert sorted(map(str, detect(frame, lib, ["page_id"], part=part).collect())) == sorted(
            map(str, detect(frame, lib, ["page_id"], prefilter=False).collect()))


def test_parts_keep_repeated_pages_and_pages_without_a_match(spark):
    lib = library(spark, [("T", "html", None, f"word{i}") for i in range(4)])
    frame = spark.createDataFrame([(1, "word0"), (1, "word0"), (1, "word1 word3"), (2, "nothing")], "page_id long, html string")
    for part in (1, 20_000):
        rows = matched_signatures(frame, lib, ["page_id"], part=part).collect()
        assert sorted((r.page_id, len(r.matches)) for r in rows) == [(1, 1), (1, 1), (1, 2), (2, 0)]
        found = detect(frame, lib, ["page_id"], part=part).collect()
        assert sorted((r.page_id, r.confidence) for r in found) == [(1, 40), (1, 40), (1, 80)]


def test_detection_needs_no_shuffle(spark):
    lib = library(spark, [("T", "html", None, f"abc{i}") for i in range(50)])
    frame = spark.range(10).select(F.col("id").alias("page_id"), F.lit("abc").alias("html"))
    plan = detect(frame, lib, ["page_id"], part=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_candidates_are_few(spark):
    rules = [("T", "html", None, rf'href="[^"]*/{i}x"') for i in range(300)] + [("U", "html", None, rf"track[(]{i}[)]") for i in range(300)]
    lib = library(spark, rules)
    html = [" ".join(f'<a href="/p/{j}x">track({j})</a>' for j in range(k, k + 5)) for k in range(0, 40, 5)]
    frame = pages(spark, *({"html": h} for h in html))
    found = frame.select(F.size(candidate_rows(lib.patterns, ["ord"], {"html": F.col("html")}, F.array().cast("array<string>"))).alias("n")).collect()
    matches = signature_matches(frame, lib, ["page_id"]).count()
    tested = sum(r.n for r in found)
    print("candidates", tested, "matches", matches)
    assert matches == 80 and tested <= 3 * matches


def test_candidates_are_few_where_many_patterns_share_a_key(spark):
    rules = [("T", "meta", "Generator", f"CMS {i}[.]") for i in range(300)] + [("U", "cookie", "SID", f"^v{i}$") for i in range(300)]
    rules += [("V", "header", "Server", "")]
    lib = library(spark, rules)
    frame = pages(spark, *({"meta": {"generator": f"cms {i}.1"}, "cookies": [("SID", f"v{i}")], "headers": {"server": "x"}} for i in range(100, 140)))
    with_candidates = matched_signatures(frame, lib, ["page_id"])
    tested = with_candidates.select(F.size("matches").alias("n")).collect()
    assert [r.n for r in tested] == [3] * 40
    searched = match.evidence_texts(lib.kinds) | match._entry_texts(lib.kinds)
    found = match.with_evidence_columns(frame).select(F.size(candidate_rows(lib.patterns, ["ord"], searched, match._present_globals())).alias("n"))
    assert sum(r.n for r in found.collect()) <= 3 * 120


def test_no_patterns_and_null_evidence(spark):
    lib = library(spark, [("T", "meta", "k", "v")])
    frame = match.with_evidence_columns(spark.createDataFrame([(1, None)], "page_id long, html string"))
    searched = match.evidence_texts({"html", "meta"}) | match._entry_texts({"html", "meta"})
    assert frame.select(F.size(candidate_rows(lib.patterns, ["ord"], searched, match._present_globals())).alias("n")).collect()[0].n == 0


def test_a_worker_holds_a_bounded_number_of_candidates(monkeypatch):
    wanted = [[{"where": "html", "terms": [[f"word{i % 4}"]]}] for i in range(40)]
    parts = [Part(wanted[:15]), Part(wanted[15:])]
    texts = [" ".join(f"WORD{j}" for j in range(i % 5)) for i in range(30)]
    batch = (pa.array(texts), pa.array([None] * 30, pa.list_(pa.string())))

    def found(numbers, ends):
        return [numbers[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def search(at, pages):
        return candidates._numbers(iter(parts), batch, ["html"], at, pages, [15, 25], False)

    whole = [found(*its) for its in search(0, 30)[1]]
    for room in (1, 50, 90):
        monkeypatch.setattr(candidates, "NUMBERS", room)
        at, pieces = 0, [[], []]
        while at < 30:
            pages, its = search(at, 30 - at)
            assert pages == 1 or sum(len(numbers) for numbers, _ in its) <= room
            for piece, one in zip(pieces, its):
                piece += found(*one)
            at += pages
        assert pieces == whole and at == 30


def test_candidates_are_handed_over_a_few_pages_at_a_time(spark):
    lib = library(spark, [("T", "html", None, f"word{i % 3}|x{i}") for i in range(300)])
    frame = spark.range(200, numPartitions=1).selectExpr("id as page_id", "'word0 word1 word2' as html")
    found = frame.select("page_id", candidate_rows(lib.patterns, ["ord"], {"html": F.col("html")}, F.array().cast("array<string>"), part=70).alias("c"))
    rows = found.select("page_id", F.size("c").alias("n"), (F.array_sort("c") == F.col("c")).alias("sorted")).collect()
    assert [(r.page_id, r.n, r.sorted) for r in rows] == [(i, 300, True) for i in range(200)]
    assert 200 * 300 > 2 * candidates.HANDED


def test_literals_are_found_wherever_they_occur(monkeypatch):
    monkeypatch.setattr(candidates, "SEGMENT", 16)
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé\x01", k=rng.randint(1, 20))) for _ in range(400)})
    texts = ["".join(rng.choices([*words, "xyz"], k=rng.randint(0, 6))) for _ in range(50)]
    literals = candidates.Literals(pa.array(words))
    for text in texts:
        data = text.encode()
        at, sizes, numbers = literals.find(np.frombuffer(data, np.uint8))
        found = sorted(zip(at.tolist(), sizes.tolist(), numbers.tolist()))
        assert found == sorted((i, len(w), n) for n, w in enumerate(map(str.encode, words)) for i in range(len(data)) if data.startswith(w, i))


def test_a_part_finds_the_rows_whose_conditions_hold(monkeypatch):
    monkeypatch.setattr(candidates, "PAIRS", 40)
    rng = random.Random(5)
    words = [f"{rng.choice('abc')}{i % 9}{'z' * (i % 11)}" for i in range(40)]

    def way():
        if rng.random() < 0.1:
            return {"where": "key", "terms": [[f"k{rng.randint(0, 5)}"]]}
        terms = [sorted(set(rng.choices(words, k=rng.randint(1, 3)))) for _ in range(rng.randint(0, 3))]
        return {"where": rng.choice(["html", "meta"]), "terms": terms if terms or rng.random() < 0.2 else [[words[0]]]}

    wanted = [None, [], *([way() for _ in range(rng.randint(1, 3))] for _ in range(200))]
    part = Part(wanted)
    for _ in range(40):
        pages = [{name: text for name in ("html", "meta") if (text := "-".join(rng.choices(words, k=rng.randint(0, 8))))} for _ in range(7)]
        keys = [rng.choice([None, [], ["k1", "none"], ["k2", "k3"]]) for _ in pages]
        rows, counts = part.search(pages, keys)
        for texts, its, found in zip(pages, keys, np.split(rows, np.cumsum(counts)[:-1])):
            assert found.tolist() == [i for i, ways in enumerate(wanted) if any(
                w["terms"][0][0] in (its or ()) if w["where"] == "key" else
                w["where"] in texts and all(any(x in texts[w["where"]] for x in t) for t in w["terms"]) for w in ways or ())]


def test_equal_tests_are_made_once_a_page(spark):
    rules = [(f"T{i % 7}", "html", None, "colou?r") for i in range(300)] + [(f"T{i % 7}", "meta", "Generator", "^CMS") for i in range(200)]
    lib = library(spark, rules)
    frame = match.with_evidence_columns(pages(spark, *({"html": f"a color {i}", "meta": {"generator": "cms"}} for i in range(20))))
    searched = match.evidence_texts(lib.kinds) | match._entry_texts(lib.kinds)
    found = candidate_rows(lib.patterns, match._CANDIDATE, searched, match._present_globals(), alike=match.ALIKE)
    assert [r.n for r in frame.select(F.size(found).alias("n")).collect()] == [2] * 20
    assert signature_matches(frame, lib, ["page_id"]).groupBy("page_id").count().filter("count = 500").count() == 20
    assert {(r.tech, r.confidence) for r in detect(frame, lib, ["page_id"]).collect()} == {(f"T{i}", 100) for i in range(7)}


def test_detections_sum_and_list_all_signatures_of_a_technology(spark):
    """Also where the library names a technology in several places, or with no name at all."""
    rng = random.Random(11)
    kinds = [("html", None), ("script", None), ("header", "server")]
    places = [(None, 2)] + [(f"T{i % 9}", rng.randint(0, 4)) for i in range(60)]
    rules = [(tech, place, *rng.choice(kinds), rng.choice(["abc", "b+c", "x", "a.c", "q"]), i) for i, (tech, place) in enumerate(places * 3)]
    schema = "tech string, tech_ord long, file string, field string, kind string, ord int, key string, pattern string, label string"
    rows = spark.createDataFrame([(t, o, "f", k, k, i, key, p, f"{k}: {i}") for t, o, k, key, p, i in rules], schema)
    techs = spark.createDataFrame([(f"T{i}", ["cms"], i % 2 == 0, f"text {i}") for i in range(9)],
                                  "tech string, categories array<string>, higher_ed boolean, description string")
    lib = compile_library(techs, with_weights(rows))
    texts = ["abc", "xbbc", "q x", "", "a-c q"]
    frame = pages(spark, *({"html": rng.choice(texts), "scripts": [(rng.choice(texts), None)], "headers": {"server": rng.choice(texts)}} for _ in range(30)))
    for part in (7, 1 << 20):
        matched = {r.page_id: r.matches for r in matched_signatures(frame, lib, ["page_id"], part=part).collect()}
        want = []
        for page, its in matched.items():
            own = {}
            for m in its:
                own.setdefault(m.tech, []).append(m)
            scored = [(-min(100, sum(m.weight for m in ms)), ms[0].ord, tech, ms) for tech, ms in own.items() if tech]
            for rank, (score, _, tech, ms) in enumerate(sorted(s for s in scored if s[0] <= -70)):
                labels = [m.label for m in ms if m.kind == "html"][:11] + [m.label for m in ms if m.kind != "html"]
                want.append((page, rank + 1, tech, -score, labels, ms[0].categories, ms[0].is_higher_ed, ms[0].description))
        found = detect(frame, lib, ["page_id"], ScanConfig(min_confidence=70), part=part)
        assert want and sorted(map(tuple, found.select(
            "page_id", "rank", "tech", "confidence", "evidence", "categories", "is_higher_ed", "description").collect())) == sorted(want)
        none = detect(frame, lib, ["page_id"], ScanConfig(min_confidence=70, include_evidence=False), part=part)
        assert {(r.page_id, r.tech, len(r.evidence)) for r in none.collect()} == {(w[0], w[2], 0) for w in want}


def test_matches_of_a_page_are_handed_over_in_pieces(spark):
    lib = library(spark, [("T", "html", None, "word")] * 40_000)
    frame = spark.createDataFrame([(1, None, "word"), (2, ["x"], "none"), (3, ["y", None], "words")], "page_id long, tags array<string>, html string")
    found = signature_matches(frame, lib, ["page_id", "tags"])
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Generate" not in found._jdf.queryExecution().toString()
    rows = found.groupBy("page_id", "tags").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("ords"), F.max("weight").alias("w")).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None, 40_000, 40_000, 40), (3, ["y", None], 40_000, 40_000, 40)]
    assert 40_000 > 2 * candidates.HANDED
