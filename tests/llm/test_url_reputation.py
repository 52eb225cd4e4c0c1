from pyspark.sql import functions as F

from tessera.llm import url_reputation as U


def one(spark, urls):
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    return d, {r.page_id: r for r in U.judge(d, spark.createDataFrame([], "host string, bad int")).collect()}


def test_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/de/", "x://NET", "http://net/", "http://www.example.com/de/a", "http://example.com/de",
            "http://notexample.com/de/", "ftp://a.org/fr/1", "http://a.org?u=http://b.net/", None, "no scheme", "", "http://É.net/ä#x", "a://b://c/d",
            "http://example.netx/en/", "http://h.org#/fr/", "line\nbreak://x.net/y\nz"]
    _, got = one(spark, urls)
    parts = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert parts == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("net", "", None, "allow"), ("net", "/", "net/", "block"),
        ("www.example.com", "/de/a", "example.com/de/", "block"), ("example.com", "/de", None, "allow"), ("notexample.com", "/de/", None, "allow"),
        ("a.org", "/fr/1", "org/fr/", "allow"), ("a.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("É.net", "/ä", "net/", "block"), ("b:", "//c/d", None, "allow"), ("example.netx", "/en/", None, "allow"), ("h.org", "", None, "allow"),
        ("x.net", "/y\nz", "net/", "block")]


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.one.com", 1)] * 60 + [("new.one.com", 1)] * 1 + [("good.two.com", 0)] * 300 + [("good.two.com", 1)] * 3 + [("a.three.org", 0)] * 50 + [(None, 1), ("x.org", None)]
    rep = {r.host: r for r in U.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rep["bad.one.com"].blocked and not rep["good.two.com"].blocked and not rep["new.one.com"].blocked
    assert 0.01 < rep["new.one.com"].rate < 1 and rep["good.two.com"].rate < 0.1 and "x.org" not in rep
    assert all(r.bound < r.rate for r in rep.values())


def test_edge_rows(spark):
    d = spark.createDataFrame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (None, None, None)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = U.judge(d, U.page_outcomes(d, labels))
    assert out.count() == 3 and out.where("host = 'x'").count() == 0
    assert U.judge(d.limit(0), U.page_outcomes(d, labels)).count() == 0


def test_wide_suffixes(spark):
    h = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("x",)], "h string")
    got = [tuple(r) for r in h.select(U.suffix_of(F.col("h")), U.domain_of(F.col("h"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("com", "b.com"), ("x", "x")]


def test_unlabelled_hosts_are_judged_by_domain_then_suffix(spark):
    rows = [(f"h{i}.bad.com", 1) for i in range(40) for _ in range(30)] + [(f"h{i}.good{i}.com", 0) for i in range(40) for _ in range(30)]
    rows += [(f"w.d{i}.xyz", 1) for i in range(40) for _ in range(30)]
    labels = spark.createDataFrame(rows, "host string, bad int")
    hosts = ["new.bad.com", "bad.com", "new.good1.com", "new.other.com", "new.other.xyz", "new.elsewhere.org", "h1.bad.com", "h1.good1.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)] + [(99, "no host"), (98, None)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, labels, rules=()).collect()}
    assert got.pop(99) == got.pop(98) == "allow"
    assert {hosts[i]: v for i, v in got.items()} == {
        "new.bad.com": "block", "bad.com": "block", "new.good1.com": "allow", "new.other.com": "allow", "new.other.xyz": "block",
        "new.elsewhere.org": "allow", "h1.bad.com": "block", "h1.good1.com": "allow"}
    rep = {r.host: r for r in U.reputations(labels, hosts_too=pages.select(U.url_host(F.col("url")).alias("host"))).collect()}
    assert rep["new.bad.com"].n == 0 and "" not in rep and len(rep) == 120 + 6
    # the further away the level that has labels, the wider the bound
    near, far = rep["new.bad.com"], rep["new.elsewhere.org"]
    assert near.rate - near.bound < far.rate - far.bound


def labelled(*groups):
    """Labels of (host, bad ones, all)."""
    return [(h, int(i < bad)) for h, bad, n in groups for i in range(n)]


def test_one_label_blocks_no_host(spark):
    rows = labelled(("solo.tiny.com", 1, 1), ("new.one.com", 1, 1), ("bad.one.com", 59, 61), ("good.two.com", 3, 303), ("a.three.org", 0, 50), ("b.four.org", 2, 40))
    rep = {r.host: r for r in U.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert {h for h, r in rep.items() if r.blocked} == {"bad.one.com"}


def test_own_labels_count_once_and_doubt_is_handed_down(spark):
    many = labelled(*[(f"h{i}.bad.com", 30, 30) for i in range(20)], *[(f"h{i}.good.com", 0, 30) for i in range(20)])
    few = labelled(("h.bad.com", 30, 30), ("h.good.com", 0, 30))
    asked = spark.createDataFrame([("new.bad.com",), ("new.good.com",)], "host string")
    wide, narrow = ({r.host: r for r in U.reputations(spark.createDataFrame(x, "host string, bad int"), hosts_too=asked).collect()} for x in (few, many))
    assert narrow["new.bad.com"].blocked and not wide["new.bad.com"].blocked and not narrow["new.good.com"].blocked
    # thirty labels of one host are less evidence for its domain than as many of thirty hosts
    spread = labelled(*[(f"h{i}.bad.com", 1, 1) for i in range(30)], ("h.good.com", 0, 30))
    apart = {r.host: r for r in U.reputations(spark.createDataFrame(spread, "host string, bad int"), hosts_too=asked).collect()}
    assert apart["new.bad.com"].bound > wide["new.bad.com"].bound


def test_sql_is_the_very_rule(spark):
    import duckdb

    from tessera.llm.queries import url_sql
    rng = __import__("random").Random(4)
    rows = [("solo.tiny.com", 1), ("x", 1), ("x", 1)]
    for suffix in ("com", "org", "co.uk", "xyz"):
        for d in range(12):
            for h in range(rng.randrange(1, 6)):
                p = rng.choice((0.02, 0.05, 0.5, 0.97, 1.0)) if suffix != "xyz" else 0.99
                rows += [(f"h{h}.d{d}.{suffix}", int(rng.random() < p)) for _ in range(rng.choice((1, 1, 2, 5, 30)))]
    rows += [(None, 1), ("h1.d1.com", None)]
    labels = spark.createDataFrame(rows, "host string, bad int")
    hosts = sorted({h for h, _ in rows if h}) + [f"new.d{d}.{s}" for d in range(14) for s in ("com", "org", "co.uk", "xyz", "net")] + ["d1.com", "co.uk", "y"]
    urls = [(i, f"http://{h}/p") for i, h in enumerate(hosts)] + [(9998, None), (9999, "none")]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(urls, "page_id bigint, url string"), labels, rules=()).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", urls)
    con.execute("CREATE TABLE outcomes (host VARCHAR, bad INTEGER)")
    con.executemany("INSERT INTO outcomes VALUES (?, ?)", rows)
    expected = {r[0]: r[4] for r in con.execute(url_sql(False, "SELECT host, bad FROM outcomes")).fetchall()}
    assert got == expected
    by = {hosts[i]: v for i, v in got.items() if i < len(hosts)}
    assert by["solo.tiny.com"] == "allow" and {"block", "allow"} <= {by[h] for h in by if h.startswith("new.")} and "block" in {by[h] for h in by if h.startswith("h")}
