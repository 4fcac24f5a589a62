import math
import random

import pytest

from panelspark.llm import queries, url_filter

URLS = [
    (1, "HTTP://WWW.Example.NET/en/1?x"), (2, "https://a.example.net/de/1"), (3, "http://example.com/de/#f"), (4, "http://sub.example.com/fr/"), (5, "http://x.org/fr/2"), (6, "http://x.org/de/2"),
    (7, "http://foo.net"), (8, None), (9, "no scheme"), (10, "http://"), (11, "a://b?c://d/"), (12, "http://notexample.net.com/en/"), (13, "http://bad.example.com/x"), (13, "http://bad.example.com/x"),
    (14, "http://" + "h" * 50_000 + "/" + "p" * 200_000 + "?q"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(*u, "h") for u in URLS], "page_id long, url string, host string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}
    assert got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/1", "net/", "block")
    assert got[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow") and got[6][2] is None
    assert got[7] == ("foo.net", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("b", "", None, "allow") and got[12][2] is None
    assert len(got[14][0]) == 50_000 and len(got[14][1]) == 200_001
    assert url_filter.judge(pages.limit(0), none).count() == 0 and url_filter.judge(pages, none).count() == len(URLS)


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "a.de:8080": ("a.de", "de"), "co.example.com": ("example.com", "com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filter.domain_and_suffix(url_filter.F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_quantile_of_the_beta_law(spark):
    cases = [(0.5, 3.0), (2.0, 5.0), (30.0, 200.0), (1.0, 1.0), (1200.0, 9000.0), (0.05, 0.9), (40.0, 0.4)]
    df = spark.createDataFrame(cases, "a double, b double")
    for r in df.withColumn("x", url_filter.beta_quantile(url_filter.F.col("a"), url_filter.F.col("b"), 0.1)).collect():
        u = random.Random(1)
        below = sum(u.betavariate(r.a, r.b) <= r.x for _ in range(40_000)) / 40_000
        assert below == pytest.approx(0.1, abs=0.006), r
    assert df.select(url_filter.beta_quantile(url_filter.F.lit(1.0), url_filter.F.lit(1.0), 0.25).alias("x")).first().x == pytest.approx(0.25, abs=1e-3)


def brute(outcomes):
    """{host: (n, bad)} -> ({host: posterior mean}, strengths of suffix, domain and host)."""
    overall = sum(b for _, b in outcomes.values()) / sum(n for n, _ in outcomes.values())
    above, strengths, mean = {None: overall}, [], {}
    for cut in (1, 2, 99):
        groups = {}
        for h, (n, b) in outcomes.items():
            name = ".".join(h.split(".")[-cut:])
            up = None if cut == 1 else ".".join(h.split(".")[-cut + 1 :]) if cut == 2 else ".".join(h.split(".")[-2:])
            g = groups.setdefault(name, [0, 0, above[up]])
            g[0] += n
            g[1] += b
        over = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in groups.values())
        room = sum(n * (n - 1) * m * (1 - m) for n, b, m in groups.values())
        strengths.append(1 / min(max(over / room if room else 0, 1e-4), 0.5) - 1)
        mean = {k: (b + strengths[-1] * m) / (n + strengths[-1]) for k, (n, b, m) in groups.items()}
        above = mean
    return mean, strengths


def test_strengths_follow_the_data(spark):
    r = random.Random(4)
    outcomes = {}
    for d in range(12):
        rate = r.choice((0.02, 0.05, 0.6))
        for h in range(6):
            n = r.randrange(0, 60)
            outcomes[f"h{h}.d{d}.{'io' if d % 2 else 'com'}"] = (n, sum(r.random() < rate for _ in range(n)))
    df = spark.createDataFrame([(h, n, b) for h, (n, b) in outcomes.items()], "host string, n long, bad long")
    want, strengths = brute(outcomes)
    got = {x.host: x for x in url_filter.reputation(df).collect()}
    assert strengths[1] < 10 < strengths[2]  # domains differ, hosts of a domain do not
    for h, x in got.items():
        assert x["mean"] == pytest.approx(want[h]) and 0 < x.bound < x["mean"]


def test_hosts_without_labels_take_the_posterior_above(spark):
    urls = [(i, f"http://spam.bad.io/{i}") for i in range(60)] + [(100 + i, f"http://fine.good.io/{i}") for i in range(60)] + [(200 + i, f"http://x.clean.dev/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 60), "x") for i, _ in urls] + [(None, 1, "z"), (5, None, "z"), (5, 1, "z")], "doc_id long, toxic int, verdict string")
    new = [(900, "http://new.bad.io/"), (901, "http://new.good.io/"), (902, "http://other.io/"), (903, "http://new.dev/"), (905, "none"), (None, "http://null.bad.io/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls + new, "page_id long, url string"), labels).collect()}
    assert got[5].verdict == got[900].verdict == got[None].verdict == "block"
    assert got[100].verdict == got[200].verdict == got[901].verdict == got[903].verdict == "allow"
    assert got[901].bound < got[902].bound < got[900].bound < got[5].bound
    assert got[905].bound is None and got[905].verdict == "allow"


def test_the_method_blocks_and_allows_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_url_filter(spark, sf).collect()
    method = [r.verdict for r in got if r.rule is None]
    assert method.count("allow") > method.count("block")
    judged = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), rules=())
    by_host = {r.host: (r.bound, r.verdict) for r in judged.collect()}
    assert {v for _, v in by_host.values()} == {"allow", "block"}
    least = min(b for b, v in by_host.values() if v == "block")
    assert all(b < least for b, v in by_host.values() if v == "allow" and b is not None) and not math.isnan(least)
