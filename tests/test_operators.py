"""Evidence, frontier, roll-up, quality and sources on small fixtures."""

import json

from pyspark.sql import functions as F

from stackscan.functions import urls
from stackscan.model import ScanConfig
from stackscan.operators import frontier, history, quality, rollup, validate
from stackscan.operators.evidence import extract_evidence
from stackscan.plans import scan
from stackscan.sources import ledgers, signatures, sinks, snapshots

HTML = """<!DOCTYPE html><html><head><title> A &amp;
 B </title><meta charset="utf-8"><meta name="Generator" content="WordPress 6.2.1"><meta content='x' property=og:title>
<meta name="generator" content="Joomla! 4.1"><!-- <script src="/no.js"></script> --><script src="/js/a.js?ver=1.2&x=1"></script>
<script src=//cdn.x.org/bootstrap/4.5.1/b.js></script><script>var u="<a href='/no'>x</a>"; fetch("/api/v1/users"); f('/rest/q')</script>
<script src="https://h.org/wp-json/x/y.js"></script></head><body class="wp-x col-1" id=main>
<a href="/login">  Log <b>In</b>&nbsp;</a><a href="rel?x=1">R</a><a name="z">no</a><a href='https://other.org/x'>O</a>
<div id="root" data-x></div><form action="/api/go"></form></body></html>"""


def page(spark, html=HTML, url="https://www.ex.org/dir/page?q=1", **columns):
    frame = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return frame.withColumns(columns) if columns else frame


def test_evidence_of_a_page(spark):
    row = extract_evidence(page(spark)).collect()[0].asDict(True)
    assert [(s["src"], s["version"]) for s in row["scripts"]] == [
        ("https://www.ex.org/js/a.js?ver=1.2&x=1", "1.2"), ("https://cdn.x.org/bootstrap/4.5.1/b.js", None),
        ("https://h.org/wp-json/x/y.js", None)]
    assert row["meta"] == {"generator": "Joomla! 4.1", "og:title": "x"}
    assert (row["dom"]["title"], row["dom"]["body_classes"], row["dom"]["body_id"]) == ("A & B", "wp-x col-1", "main")
    flags = {k for k, v in row["has_elements"].items() if v}
    assert flags == {"wpContent", "reactRoot", "joomlaSystem", "bootstrapClasses"}
    assert row["version_info"] == {"wordpress": "6.2.1", "joomla": "4.1", "bootstrap": "4.5.1"}
    assert row["api_endpoints"] == ["/api/v1/users", "/rest/q", "/wp-json/x/", "/api/go"]
    assert [(x["href"], x["text"]) for x in row["links"]] == [
        ("https://www.ex.org/login", "log in"), ("https://www.ex.org/dir/rel?x=1", "r"), ("https://other.org/x", "o")]
    assert row["headers"] is None and row["js_objects"] is None and row["network_hosts"] == []


def test_html_versions_only_fill_gaps(spark):
    html = ('<meta name="generator" content="WordPress 6.2"><script src="/wp-includes/js/wp-embed.min.js?ver=5.9"></script>'
            "<p>MOODLE/lib/javascript.js?3.11 joomla.js?3.9</p>")
    row = extract_evidence(page(spark, html)).collect()[0]
    assert row.version_info == {"wordpress": "6.2", "moodle": "3.11", "joomla": "3.9"}


def test_api_endpoints_stop_at_twenty(spark):
    html = "".join(f'<a href="/api/x{i}">x</a>' for i in range(30))
    assert len(extract_evidence(page(spark, html)).collect()[0].api_endpoints) == 20


def test_request_hosts(spark):
    frame = page(spark, request_urls=F.array(F.lit("https://A.b:8/c"), F.lit("bad"), F.lit("https://a.b/d")))
    assert extract_evidence(frame, ScanConfig(capture_network=True)).collect()[0].network_hosts == ["a.b"]
    assert extract_evidence(frame).collect()[0].network_hosts == []


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in (
        "https://www.Ex.org/a b/ü?x", "http://10.0.0.1/", "ftp://x.org/", "https://u:p@172.16.0.1:8/x", "", "nonsense", "http://localhost")], "url string")
    admitted, rejected = urls.admit(rows)
    assert [r.url for r in admitted.collect()] == ["https://www.Ex.org/a b/ü?x"]
    assert {r.reason for r in rejected.collect()} == {"private", "invalid", "empty"}
    got = rows.limit(1).select(urls.root_host(F.col("url")), urls.path(F.col("url")), urls.host_slug(F.col("url"))).collect()[0]
    assert tuple(got) == ("ex.org", "/a b/ü", "www.ex.org-a-b")


def test_links_strategic_first_then_fallback(spark):
    html = '<a href="/x">Student Portal</a><a href="/Login">a</a><a href="/login">b</a><a href="/login">c</a><a href="https://o.org/login">d</a>'
    linked = frontier.candidate_links(extract_evidence(page(spark, html)), ["page_id"]).orderBy("pos").collect()
    assert [(r.source, r.href) for r in linked] == [("strategic", "https://www.ex.org/Login"), ("strategic", "https://www.ex.org/login")]
    html = '<a href="/x">Student Portal</a><a href="/y">y</a>'
    assert [(r.source, r.href) for r in frontier.candidate_links(extract_evidence(page(spark, html)), ["page_id"]).collect()] == [
        ("fallback", "https://www.ex.org/x")]


def test_merge_is_ordered_and_takes_the_best_page(spark):
    schema = ("site string, source_ord int, page_ord long, rank int, tech string, confidence int, categories array<string>, "
              "evidence array<string>, version string, is_higher_ed boolean, description string")
    rows = [("s", 1, 1, 1, "React", 80, ["b"], ["JS: React"], "2", True, "later"),
            ("s", 0, 5, 2, "react", 40, ["a"], ["HTML: x", "JS: React"], None, False, "first"),
            ("s", 0, 5, 1, "Vue", 80, ["a"], [], None, False, "")]
    merged = rollup.merge_sites(spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r.tech, r.confidence, r.categories, r.evidence, r.version, r.description) for r in merged] == [
        ("Vue", 80, ["a"], [], None, ""), ("react", 80, ["a", "b"], ["HTML: x", "JS: React"], "2", "first")]


def test_stack_takes_the_last_of_a_slot(spark):
    schema = "site string, rank int, tech string, categories array<string>"
    merged = spark.createDataFrame([("s", 1, "Drupal", ["CMS"]), ("s", 2, "WordPress", ["cms"]), ("s", 3, "React", ["JavaScript"]),
                                    ("s", 4, "B", ["sis"]), ("s", 5, "L", ["LMS"])], schema)
    row = rollup.stack_inferences(rollup.stack_components(merged)).collect()[0]
    assert (row.cms, row.javascript) == ("WordPress", ["React"])
    assert row.inferences == ["WordPress with React frontend (likely headless WordPress)", "Integrated SIS (B) and LMS (L) environment"]
    assert rollup.stack_components(merged, prefer="highest").collect()[0].cms == "Drupal"


def test_page_budget_uses_a_slot_for_excluded_pages(spark):
    rows = [("s", f"https://s.org/{p}", i) for i, p in enumerate(["", "a", "authors", "b", "c", "d", "e"])]
    frame = spark.createDataFrame(rows, "site string, url string, page_ord int")
    got = scan.pages_in_budget(frame).orderBy("page_ord").collect()
    assert [r.url for r in got] == ["https://s.org/", "https://s.org/a", "https://s.org/b", "https://s.org/c"]


def test_signature_files(spark, tmp_path):
    one = {"_metadata": {"description": "x"}, "A": {"description": "old", "html": ["x"], "cats": [1]}, "B": {"categories": ["LMS", 53], "html": "no list"}}
    two = {"C": {"scripts": [], "scriptSrc": ["y"], "js": {"g": True, "h": ""}}, "A": {"headers": {"X-Y": "z"}, "_legacy_names": ["Old A"]}}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps(two))
    (tmp_path / "bad.json").write_text("{not json")
    files = [str(tmp_path / n) for n in ("one.json", "missing.json", "bad.json", "two.json")]
    techs, sigs = signatures.load_library(spark, files)
    assert [(r.tech, r.file) for r in techs.orderBy("tech_ord").collect()] == [("A", "two.json"), ("B", "one.json"), ("C", "two.json")]
    assert {(r.tech, r.kind, r.key, r.label) for r in sigs.collect()} == {
        ("A", "header", "x-y", "Header: X-Y=z"), ("C", "js", "g", "JS: g"), ("C", "js", "h", "JS: h")}
    b = techs.filter("tech = 'B'").collect()[0]
    assert (b.categories, b.category_ids) == (["LMS", "53"], [53])
    rows = quality.ledger(techs, sigs).collect()
    assert {(r.technology, r.pattern, r.tier, r.legacy_names) for r in rows} == {
        ("A", "X-Y=z", "A", "Old A"), ("C", "g=true", "C", ""), ("C", "h", "C", "")}


def test_tiers(spark):
    cases = [("headers", "x", "A"), ("cookies", "sessid", "A"), ("cookies", "sid", "C"), ("meta", "author", "B"), ("meta", "generator", "C"),
             ("js", "ga", "C"), ("js", "Banner1", "A"), ("js", "banner", "C"), ("js", "kWidget", "B"), ("html", "abc", "C"), ("html", "canvas", "C"),
             ("html", ".*foo.*", "C"), ("html", 'class=".*x', "C"), ("html", r"cdn\.vendor\.com", "A"), ("html", r"/wp_content\b", "B"),
             ("html", "data-vendor", "B"), ("html", "plainword", "C")]
    frame = spark.createDataFrame(cases, "field string, pattern string, want string")
    got = frame.withColumn("got", quality.tier(F.col("field"), F.col("pattern"))).filter("got != want").collect()
    assert got == []


def test_duplicates_are_counted_and_all_places_are_rows(spark):
    _, sigs = signatures.signature_rows(spark, [(f"T{i}", "html", None, "same thing") for i in range(1500)])
    assert [r.message for r in quality.duplicate_issues(sigs).collect()] == ["Duplicate pattern found in 1500 places"]
    assert quality.duplicate_places(sigs).count() == 1500


def test_validation_rules(spark):
    schema = ("ord long, technology string, url string, html string, scripts array<struct<src:string,version:string>>, "
              "headers map<string,string>, meta map<string,string>, cookies array<struct<name:string,value:string>>, js_objects map<string,boolean>")
    shots = spark.createDataFrame([
        (0, "Own ", "u0", "uses g1 here", [("a.js", None)], {"X-A": ""}, {"gen": "v1"}, [("sess_1", "x")], {"off": False}),
        (1, "Other", "u1", "", None, {"x-a": "1"}, None, None, None)], schema)
    patterns = [("js", "off"), ("js", "g1"), ("js", "g"), ("headers", "x-a"), ("headers", "X-A=1"), ("meta", "GEN=V\\d"), ("cookies", "^sess_\\d"),
                ("cookies", "sess=y"), ("scripts", "A\\.js"), ("html", "(bad"), ("html", r"uses\;version:1")]
    ledger = spark.createDataFrame([("own", "f", f, p) for f, p in patterns], "technology string, file string, field string, pattern string")
    hits = lambda mode: {(r.field, r.pattern, r.ord) for r in validate.snapshot_hits(ledger, shots, mode).collect()}
    always = {("meta", "GEN=V\\d", 0), ("scripts", "A\\.js", 0), ("headers", "x-a", 1), ("headers", "X-A=1", 1), ("html", r"uses\;version:1", 0)}
    assert hits("runtime") == always
    assert hits("validate") == always | {("js", "off", 0), ("js", "g1", 0), ("headers", "x-a", 0), ("cookies", "^sess_\\d", 0)}
    results = {(r.field, r.pattern): r.result for r in validate.validation_results(
        ledger.withColumns({c: F.lit("") for c in ("status", "notes", "source_evidence")}), shots).collect()}
    assert results[("headers", "x-a")] == "needs-review" and results[("headers", "X-A=1")] == "false-positive"
    assert results[("js", "g1")] == "verified" and results[("js", "g")] == "suspect"


def test_validation_reads_the_snapshots_once_for_counts_and_notes(spark):
    shots = spark.range(5).selectExpr(
        "id as ord", "if(id % 2 = 0, 'T', 'U') as technology", "'u' as url", "'abc' as html", "cast(null as array<struct<src:string,version:string>>) as scripts",
        "cast(null as map<string,string>) as headers", "cast(null as map<string,string>) as meta",
        "cast(null as array<struct<name:string,value:string>>) as cookies", "cast(null as map<string,boolean>) as js_objects")
    ledger = spark.createDataFrame([("t", "f", "html", "abc")], "technology string, file string, field string, pattern string")
    results = validate.validation_results(ledger, shots)
    assert results.select("own_hits", "other_hits", "fp_note").collect() == [(3, 2, "FP on: U, U")]
    results.collect()
    final = results._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ArrowEvalPython") == 1 and "ReusedExchange" in final


def test_ledger_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("T", 'a "b", c\nd')], "technology string, notes string")
    full = rows.withColumns({c: F.lit("") for c in ledgers.LEDGER_COLUMNS if c not in rows.columns})
    ledgers.write_ledger(full, str(tmp_path / "l"))
    back = ledgers.read_ledger(spark, str(tmp_path / "l")).collect()
    assert [(r.technology, r.notes, r.status) for r in back] == [("T", 'a "b", c\nd', "")]


def test_ledger_csv_is_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "FILE_ROWS", 10)
    rows = spark.range(25).coalesce(1).selectExpr("cast(id as string) as technology", "'said \"x\",\nnext' as notes")
    full = rows.withColumns({c: F.lit("") for c in ledgers.LEDGER_COLUMNS if c not in rows.columns})
    ledgers.write_ledger(full, str(tmp_path / "l"))
    assert len(list((tmp_path / "l").glob("*.csv"))) == 3
    back = ledgers.read_ledger(spark, str(tmp_path / "l")).collect()
    assert sorted((int(r.technology), r.notes) for r in back) == [(i, 'said "x",\nnext') for i in range(25)]


def test_snapshot_files_are_listed_by_folder(spark, tmp_path):
    for tool in ("a", "b"):
        (tmp_path / tool).mkdir()
        for i in range(20):
            (tmp_path / tool / f"p{i}.json").write_text(json.dumps({"technology": tool, "url": f"https://{tool}{i}.org"}))
    rows = snapshots.read_snapshots(spark, str(tmp_path))
    assert rows.count() == 40
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "(2 paths)" in plan and "(40 paths)" not in plan


def test_snapshot_files(spark, tmp_path):
    folder = tmp_path / "evidence" / "tool"
    folder.mkdir(parents=True)
    shot = {"technology": "Tool", "url": "https://a.org", "captured_at": "2024-01-02T03:04:05.000Z", "response_status": 200, "html_file": "tests/evidence/tool/page.html",
            "evidence": {"headers": {"server": "x"}, "dom": {}, "cookies": []}, "probe_results": {"/p": {"url": "u", "status": "timeout"}, "/q": {"status": 200}}}
    (folder / "a.json").write_text(json.dumps(shot))
    (folder / "page.html").write_text("<p>\nhello</p>")
    (folder / "b.json").write_text(json.dumps({**shot, "url": "https://b.org", "html_file": "tests/evidence/tool/gone.html"}))
    (folder / "b.html").write_text("not the companion")
    (folder / "broken.json").write_text("{")
    rows = {r.url: r for r in snapshots.read_snapshots(spark, str(tmp_path / "evidence")).collect()}
    assert {u: r.html for u, r in rows.items()} == {"https://a.org": "<p>\nhello</p>", "https://b.org": ""}
    assert rows["https://a.org"].probe_results["/q"].status == "200"


def test_snapshot_table_round_trip(spark, tmp_path):
    e = extract_evidence(page(spark, cookies=F.array(F.struct(
        F.lit("c").alias("name"), F.repeat(F.lit("v"), 100).alias("value"), F.lit("d").alias("domain"), F.lit("/").alias("path"),
        F.lit(1.0).alias("expires"), F.lit(False).alias("secure"), F.lit(False).alias("http_only")))))
    captures = e.withColumns({
        "technology": F.lit("My Tool"), "final_url": F.col("url"), "captured_at": F.lit("2024-01-01").cast("timestamp"), "response_status": F.lit(200),
        "probe_results": F.lit(None).cast("map<string,struct<url:string,status:string,redirect_to:string,body_excerpt:string>>"),
        "matched_patterns": F.array(F.struct(F.lit("my tool").alias("name"), F.lit(30).alias("confidence"), F.array(F.lit("x")).alias("evidence")))})
    snapshots.write_snapshots(snapshots.snapshot_rows(captures), str(tmp_path / "s"))
    row = snapshots.read_snapshot_table(spark, str(tmp_path / "s")).collect()[0]
    assert row.html == HTML and row.target_tech_matched and len(row.evidence.cookies[0].value) == 64
    assert row.html_file == "my-tool/www.ex.org-dir-page.html"


def test_store_and_documents(spark, tmp_path):
    schema = ("site string, url string, final_url string, timestamp timestamp, technologies array<struct<name:string,confidence:int,"
              "categories:array<string>,version:string,is_higher_ed:boolean>>, inferred_stack struct<inferences:array<string>>, scanned_pages int, response_code int")
    docs = spark.createDataFrame([("s", "u", "u", None, [("A", 80, ["x"], None, True)], ([],), 1, 200)], schema).withColumn(
        "timestamp", F.lit("2024-01-02").cast("timestamp"))
    for _ in range(2):
        sinks.append_store(sinks.detected_rows(docs), str(tmp_path), "detected")
        sinks.append_store(sinks.scan_rows(docs), str(tmp_path), "scans")
    assert spark.read.parquet(str(tmp_path / "detected")).count() == 2
    for batch in ("b1", "b1", "b2"):
        sinks.append_store(sinks.detected_rows(docs), str(tmp_path), "once", batch)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    sinks.write_documents(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).collect()[0].site == "s"
    errors = spark.createDataFrame([("u", None, "boom"), ("v", None, None)], "url string, timestamp timestamp, error string")
    assert sinks.error_rows(errors).count() == 1


def test_change_sets_need_both_scans(spark):
    rows = lambda *r: spark.createDataFrame(r, "url string, tech string")
    got = history.change_sets(rows(("u", "a"), ("u", "b"), ("v", "a")), rows(("u", "b"), ("u", "c"), ("w", "x")))
    assert {tuple(r) for r in got.collect()} == {("u", "a", "removed"), ("u", "b", "unchanged"), ("u", "c", "added")}


def test_files_are_written_whole_and_again(spark, tmp_path):
    folder = str(tmp_path / "files")
    rows = spark.createDataFrame([("a/x.json", "{}"), ("a/x.html", "é\n"), ("b/empty.html", ""), ("b/none.html", None)], "path string, text string")
    for _ in range(2):
        snapshots.write_files(rows, folder)
    found = {str(p.relative_to(folder)): p.read_text() for p in (tmp_path / "files").rglob("*") if p.is_file()}
    assert found == {"a/x.json": "{}", "a/x.html": "é\n", "b/empty.html": ""}
    snapshots.write_files(rows.limit(0), folder)
