"""Whole scans and mining on small fixtures worked out by hand."""

from pyspark.sql import functions as F

from stackscan.operators import mining
from stackscan.plans import scan
from stackscan.sources.signatures import compile_library, signature_rows


def test_linked_scan(spark):
    home = ('<meta name="generator" content="Alpha"><a href="/student/a">Student</a><a href="/portal/x">Portal</a><a href="/">/student home</a>'
            '<a href="https://o.org/student">other</a><a href="/missing/student">gone</a><a href="/student/b">B</a><a href="/student/c">C</a>')
    store = [("https://www.s.org/", home), ("https://www.s.org/student/a", "alpha beta"), ("https://www.s.org/portal/x", "gamma"),
             ("https://www.s.org/student/b", "late"), ("https://www.s.org/student/c", "over budget"),
             ("https://events.s.org/", "delta"), ("https://www.s.org/apply/", "epsilon"), ("https://t.org/admin", "alpha")]
    pages = spark.createDataFrame(store, "url string, html string")
    seeds = spark.createDataFrame([("s.org", "https://www.s.org/"), ("t.org", "https://t.org/admin"), ("u.org", "https://u.org/")], "site string, url string")
    log = [("https://events.s.org/", 1, 500), ("https://events.s.org/", 2, 200), ("https://www.s.org/events/", 1, 200), ("https://apply.s.org/", 1, 404),
           ("https://www.s.org/apply/", 1, 403), ("https://www.s.org/user/login", 1, 200), ("https://www.s.org/cas/login", 1, 302),
           ("https://www.s.org/wp-content/", 1, 404)]
    responses = spark.createDataFrame(log, "url string, n int, status int").select(
        "url", F.timestamp_seconds("n").alias("fetched_at"), "status", F.create_map(F.lit("Server"), F.concat(F.lit("zeta"), F.col("status").cast("string"))).alias("headers"),
        F.concat(F.lit("body of "), "url").alias("body"))
    words = ["alpha beta", "gamma", "late", "over budget", "delta", "epsilon"]
    rules = [(w, "html", None, w) for w in words] + [("Gen", "meta", "generator", "^alpha$"), ("Login", "html", None, "user/login\nbody of .*cas/login$"),
                                                    ("Zeta", "header", "Server", "^zeta302$")]
    library = compile_library(*signature_rows(spark, rules))
    rows = {r.site: r for r in scan.linked_scan(seeds, pages, responses, library).collect()}
    # t.org starts on an excluded path and u.org was never fetched: no scan.
    assert list(rows) == ["s.org"]
    found = {t.name: t.confidence for t in rows["s.org"].technologies}
    # Four links fit: /student/a, /portal/x (chosen, then dropped), / (the main page), /missing/student.
    assert found == {"Gen": 100, "Zeta": 80, "alpha beta": 40, "delta": 40, "epsilon": 40, "Login": 40}
    assert rows["s.org"].scanned_urls == ["https://www.s.org/", "https://www.s.org/student/a"]


def corpus(spark):
    techs = lambda vendor: [(vendor, [vendor.lower()])]
    data = [(f"i{i}", f"Inst {i}", f"https://i{i}.edu", ({"Search": (techs("One" if i % 3 == 0 else "Two"), [])},)) for i in range(30)]
    tech = "array<struct<name:string,raw_names:array<string>>>"
    institutions = spark.createDataFrame(data, f"id string, name string, website_url string, tech_profile struct<categories:map<string,struct<current:{tech},historical:{tech}>>>")
    scans = spark.createDataFrame([(i, f"i{i}") for i in range(27)], "id long, institution_id string")
    shots = [(i, (f"https://i{i}.edu/{k}", f"<p>{'ONE.js' if (i % 3 == 0 and i % 2 == 0 and k) or i == 4 else 'none'}</p>")) for i in range(27) for k in (0, 1)]
    return institutions, scans, spark.createDataFrame(shots, "scan_id long, content struct<url:string,html:string>")


def test_mining_with_and_without_samples(spark):
    institutions, scans, shots = corpus(spark)
    label = mining.positives(institutions, "Search", "One")

    def metrics(n_pos, n_neg):
        members = mining.universe(institutions, scans, shots, "Search", "One", False, n_pos, n_neg)
        hits = mining.institution_hits(members, scans, shots, "one.js")
        return mining.signature_metrics(hits, label, "One", "Search", "one.js").collect()[0], hits

    whole, hits = metrics(None, None)
    assert (whole.positives_total, whole.pos_with_html, whole.pos_hit, whole.neg_with_html, whole.neg_hit) == (10, 9, 5, 18, 1)
    assert (whole.recall_pct, whole.neg_hit_pct) == (55.6, 5.556)
    assert metrics(250, 600)[0] == whole
    few = metrics(4, 5)[0]
    assert (few.pos_with_html, few.neg_with_html) == (4, 5) and metrics(4, 5)[0] == few
    assert metrics(0, 5)[0].recall_pct is None
    picked = mining.spotcheck(hits, institutions, limit=3).collect()
    assert sorted((r.kind, r.sample_hit_url) for r in picked if r.kind == "neg_hit") == [("neg_hit", "https://i4.edu/0")]
    misses = [r for r in picked if r.kind == "pos_miss"]
    assert len(misses) == 3 and {r.id for r in misses} <= {"i3", "i9", "i15", "i21"} and all(r.sample_hit_url is None for r in misses)
