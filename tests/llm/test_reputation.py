import math
import random
from collections import Counter

import pytest

from framekiln.llm import reputation


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:end]


def plain(pages, outcomes, limit=0.5, z=1.645):
    """Verdicts by the same model, with dictionaries."""
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, False), b)
    place = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    hosts = {split(u)[0] for _, u in pages}
    n, y = Counter(), Counter()
    for i, u in pages:
        if i in bad:
            n[split(u)[0]] += 1
            y[split(u)[0]] += bad[i]

    def level(nodes, above_of):
        prior = {}
        for k, (c, b) in nodes.items():
            count, sick, mean, weight = above_of(k)
            prior[k] = (weight * mean + sick - b) / (weight + count - c)
        over = sum((b - c * prior[k]) ** 2 - c * prior[k] * (1 - prior[k]) for k, (c, b) in nodes.items())
        under = sum(c * (c - 1) * prior[k] * (1 - prior[k]) for k, (c, _) in nodes.items())
        w = 1 / (min(max(over / under, 0.001), 0.5) if under else 0.5) - 1
        return {k: (c, b, prior[k], w) for k, (c, b) in nodes.items()}

    def pooled(name):
        out = {}
        for h in hosts:
            c, b = out.get(name(h), (0, 0))
            out[name(h)] = (c + n[h], b + y[h])
        return out

    suffixes = level(pooled(lambda h: place(h)[1]), lambda k: (sum(n.values()), sum(y.values()), 0.5, 2))
    domains = level(pooled(lambda h: place(h)[0]), lambda k: suffixes[k.split(".")[-1]])
    means = {}
    for h, (c, b, m, w) in level({h: (n[h], y[h]) for h in hosts}, lambda h: domains[place(h)[0]]).items():
        means[h] = (w * m + b) / (w + c)
    out = []
    for i, u in pages:
        h, p = split(u)
        fits = [(len(on + at), on + at, v) for on, at, v in reputation.RULES if (h == on or h.endswith("." + on)) and p.startswith(at)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        bound = means[h] - z * math.sqrt(means[h] * (1 - means[h]) / (w + n[h] + 1))
        out.append((i, h, p, rule, verdict or ("block" if bound > limit else "allow"), n[h], y[h]))
    return sorted(out, key=repr)


def made(seed, count=1200):
    rng = random.Random(seed)
    hosts = ["bad.example.com", "www.Good.example.com", "a.b.org", "one.net", "www.example.net", "spam.xyz", "m.spam.xyz", "shop.xyz"]
    rate = [0.95, 0.05, 0.2, 0.4, 0.1, 0.9, 0.99, 0.5]
    pages, outcomes = [], []
    for i in range(count):
        h = 0 if i % 3 == 0 else rng.randrange(len(hosts))  # a third of all rows on one host
        path = rng.choice(["", "/", "/en/1", "/de/2?x=/fr/", "/fr/3#top", "?q=a://b/c", "/En/"])
        pages.append((i, f"{rng.choice(['http', 'HTTPS'])}://{hosts[h]}{path}"))
        if rng.random() < 0.5:
            outcomes.append((i, rng.random() < rate[h]))
    pages += [(5000, None), (5001, ""), (5002, "no scheme"), (5003, "://"), (None, "http://bad.example.com/x"), (7, pages[7][1]), (7, pages[7][1])]
    pages += [(5004, "http://" + "x" * 40_000 + ".com/" + "y" * 40_000), (5005, "http://fresh.xyz/"), (5006, "http://a\nb.org/fr/\n?")]
    outcomes += [(None, True), (5001, None), (8, True), (8, False), (99_999, True)]
    return pages, outcomes


def tables(spark, pages, outcomes):
    from pyspark.sql import functions as F

    p = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "n", "bad", "mean", "rule", "pages", "m")})
    o = spark.createDataFrame(outcomes, "page_id long, bad boolean").withColumns({c: F.lit("own") for c in ("host", "url", "n")})
    return p, o


def got(frame):
    return sorted((tuple(r)[:-1] for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_model(spark, seed):
    pages, outcomes = made(seed)
    result = got(reputation.judge(*tables(spark, pages, outcomes)))
    assert result == plain(pages, outcomes)
    own = {(r[1], r[4]) for r in result if r[3] is None}
    assert ("spam.xyz", "block") in own and ("www.good.example.com", "allow") in own


def test_few_outcomes_block_nothing(spark):
    pages = [(1, "http://new.xyz/"), (2, "http://other.com/")]
    assert {r[4] for r in got(reputation.judge(*tables(spark, pages, [(1, True)])))} == {"allow"}


def test_empty_tables(spark):
    pages, outcomes = made(3, 20)
    p, o = tables(spark, pages, outcomes)
    assert reputation.judge(p.filter("false"), o).collect() == []
    assert got(reputation.judge(p, o.filter("false"))) == plain(pages, [])


def test_public_suffixes_and_addresses(spark):
    from pyspark.sql import functions as F

    hosts = [("www.shop.co.uk",), ("user@shop.co.uk:80",), ("co.uk",), ("10.0.0.1:8080",), ("a.b.c.d",), ("local",), ("",)]
    frame = spark.createDataFrame(hosts, "h string")
    found = [tuple(r) for r in frame.select(*reputation.domains_of(F.col("h"), ["co.uk"])).collect()]
    assert found == [("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk"), ("10.0.0.1", ""), ("c.d", "d"), ("local", "local"), ("", "")]


def test_native(spark):
    pages, outcomes = made(4, 30)
    plan = reputation.judge(*tables(spark, pages, outcomes))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
