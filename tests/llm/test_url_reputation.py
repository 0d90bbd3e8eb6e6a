"""URL filters: rules, the host hierarchy against brute force, and outcomes of whole pages."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollbook.llm import url_reputation

OUTCOMES = "name string, good int"


def outcomes(spark, rows):
    return spark.createDataFrame(rows, OUTCOMES)


def test_url_rules(spark):
    urls = {
        1: ("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("https://a.net", "a.net", "", None, None),
        3: ("https://a.net/", "a.net", "/", "net/", "block"),
        4: ("https://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        5: ("https://example.org/fr/", "example.org", "/fr/", "org/fr/", "allow"),
        6: (None, "", "", None, None),
        7: ("no scheme/net/", "", "", None, None),
        8: ("http://notexample.net?q=/en/", "notexample.net", "", None, None),
        9: ("http://a.b://c/d\ne", "a.b:", "//c/d\ne", None, None),
        10: ("http://me@good.example.org:8080/", "me@good.example.org:8080", "/", None, "allow"),
    }
    rows = [(k, u[0], "x") for k, u in urls.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, name string")
    seen = outcomes(spark, [("good.example.org", 1)] * 40 + [("", None), ("a.net", 0)])
    got = {r.page_id: r for r in url_reputation.judge(pages, seen).collect()}
    assert len(got) == len(urls)
    for key, (_, host, path, rule, verdict) in urls.items():
        assert (got[key].host, got[key].path, got[key].rule) == (host, path, rule)
        assert got[key].verdict == verdict or (verdict is None and got[key].verdict in ("allow", "block"))
    assert url_reputation.judge(pages.limit(0), seen.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("host", "name", "domain", "suffix"),
    [
        ("a.b.example.com", "a.b.example.com", "example.com", "com"),
        ("dept.gov.uk:80", "dept.gov.uk", "dept.gov.uk", "gov.uk"),
        ("www.dept.gov.uk", "www.dept.gov.uk", "dept.gov.uk", "gov.uk"),
        ("shop.com.br.", "shop.com.br", "shop.com.br", "com.br"),
        ("x.y.com.museum", "x.y.com.museum", "com.museum", "museum"),
        ("u:p@1.2.3.4:8080", "1.2.3.4", "1.2.3.4", "1.2.3.4"),
        ("[2001:db8::1]:443", "[2001:db8::1]", "[2001:db8::1]", "[2001:db8::1]"),
        ("localhost", "localhost", "localhost", "localhost"),
        ("co.uk", "co.uk", "co.uk", "co.uk"),
        ("", "", "", ""),
    ],
)
def test_names(spark, host, name, domain, suffix):
    row = spark.createDataFrame([(host,)], "host string")
    row = row.withColumn("name", url_reputation.name_of(F.col("host")))
    parts = (url_reputation.domain_of(F.col("name")), url_reputation.suffix_of(F.col("name")))
    assert tuple(row.select("name", *parts).first()) == (name, domain, suffix)


def strength(children):
    used = [(n, good, m) for n, good, m in children if n and 0 < m < 1]
    n, units = sum(x[0] for x in used), len(used)
    if not units or n <= units:
        return 1 / url_reputation.MOST_RHO - 1
    chi = sum(n * (good / n - m) ** 2 / (m * (1 - m)) for n, good, m in used)
    rho = (chi - units) / (n - units)
    return 1 / min(url_reputation.MOST_RHO, max(url_reputation.LEAST_RHO, rho)) - 1


def by_hand(rows):
    """Mean and bound of every host, level by level; all hosts here are ``x.domain.suffix``."""
    hosts = defaultdict(lambda: [0, 0])
    for name, good in rows:
        hosts[name][0] += good is not None
        hosts[name][1] += good or 0
    levels = []
    for labels in (1, 2, 3):
        level = defaultdict(lambda: [0, 0])
        for name, (n, good) in hosts.items():
            key = ".".join(name.split(".")[-labels:])
            level[key][0] += n
            level[key][1] += good
        levels.append(level)
    n, good = (sum(x[k] for x in hosts.values()) for k in (0, 1))
    means = {"": (good + 1) / (n + 2) if n else 0.5}
    for level in levels:
        parent = {k: means[k.split(".", 1)[1] if "." in k else ""] for k in level}
        weight = strength([(*level[k], parent[k]) for k in level])
        means = {k: (level[k][1] + weight * parent[k]) / (level[k][0] + weight) for k in level}
    out = {}
    for name, mean in means.items():
        total = hosts[name][0] + weight
        out[name] = mean, max(0.0, mean - 1.645 * math.sqrt(mean * (1 - mean) / (total + 1)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reputation_by_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = []
    for domain in range(6):
        share = draw.random()
        for host in range(draw.randint(1, 5)):
            name = f"h{host}.d{domain}.{draw.choice(['com', 'org'])}"
            rows += [
                (name, None if draw.random() < 0.2 else int(draw.random() < share))
                for _ in range(draw.randint(1, 30))
            ]
    want = by_hand(rows)
    got = {r.name: (r.mean, r.lower) for r in url_reputation.host_reputation(outcomes(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for name, pair in want.items():
        assert got[name] == pytest.approx(pair, abs=1e-9)


def test_reputation_without_outcomes(spark):
    rows = url_reputation.host_reputation(outcomes(spark, [("a.com", None), ("b.org", None)])).collect()
    assert [(r.n, r.mean) for r in rows] == [(0, 0.5)] * 2


def test_pages_of_spam_hosts_are_blocked(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("aeioustrnlm") for _ in range(draw.randint(2, 8))) for _ in range(400)]

    def prose(extra=(), share=0.0):
        drawn = [draw.choice(extra) if draw.random() < share else draw.choice(words) for _ in range(120)]
        return ". ".join(" ".join(drawn[k : k + 12]) for k in range(0, 120, 12)) + "."

    def junk():
        return " ".join(draw.choice(words) + draw.choice(["###", "***", "%%%"]) for _ in range(120))

    def insult():
        return prose(["vileinsult", "wretchling"], 0.2)

    kinds = [(prose, 1, 0)] * 90 + [(junk, 0, 0)] * 45 + [(insult, 1, 1)] * 45
    docs = [(k, make(), "clash") for k, (make, _, _) in enumerate(kinds)]
    labels = [(k, quality, toxic) for k, (_, quality, toxic) in enumerate(kinds)] + [(None, 0, 1)]
    hosts = {"fine.example.org": prose, "junk.example.org": junk, "vile.example.org": insult}
    pages = []
    for host, make in hosts.items():
        for _ in range(12):
            body = "".join(f"<p>{make()}</p>" for _ in range(3))
            html = f"<html><body><nav><a href='/'>Home</a></nav><article>{body}</article></body></html>"
            pages.append((len(pages), f"http://{host}/{len(pages)}", html, None))
    pages += [(None, "http://empty.example.org/", None, None), (99, None, "", None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string, stats string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = url_reputation.page_outcomes(pages, docs, labels).cache()
    shares = {r.name: (r.n, r.share) for r in seen.groupBy("name").agg(
        F.count("good").alias("n"), F.avg("good").alias("share")).collect()}
    assert shares["fine.example.org"] == (12, 1.0)
    assert shares["junk.example.org"] == shares["vile.example.org"] == (12, 0.0)
    assert shares["empty.example.org"] == shares[""] == (0, None)
    got = {(r.host, r.verdict) for r in url_reputation.judge(pages, seen).collect()}
    assert ("fine.example.org", "allow") in got
    assert {("junk.example.org", "block"), ("vile.example.org", "block")} <= got
    none = url_reputation.page_outcomes(pages.limit(0), docs.limit(0), labels.limit(0))
    assert url_reputation.judge(pages.limit(0), none).collect() == []
