from __future__ import annotations

import random

from runhealth.llm import url_filter

PAGES = "page_id long, url string, html string, host string, path string, key string, found int, block int"


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:stop], tail[stop:]


def canonical(url):
    host, path, tail = split(url)
    query = tail[1:].split("#")[0] if tail.startswith("?") else ""
    params = sorted((p for p in query.split("&") if p and not p.startswith("utm_")
                     and p.split("=")[0] not in ("ref", "fbclid", "gclid", "sessionid")), key=lambda p: p.encode())
    return (host[4:] if host.startswith("www.") else host) + path.rstrip("/") + ("?" + "&".join(params) if params else "")


def brute(url, listed):
    host, path, _ = split(url)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if canonical(url) in listed else "allow"


def urls():
    rng = random.Random(3)
    hosts = ["a.net", "www.a.net", "A.Net", "x.example.org", "example.org", "notexample.org", "b.com", "com", "c.de:80", "é.net", ""]
    paths = ["", "/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/", "/fr/x/", "/de/3", "/x//", "/a b"]
    tails = ["", "?", "?b=2&a=1", "?utm_source=x&a=1", "?ref=q", "#top", "?a=1#t", "#?x", "?x=://y"]
    found = [f"{rng.choice(['http', 'https', 'HTTP', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(600)]
    return found + [None, "", "no scheme", "a.net/x", "http:/a.net", "x\n://A.NET\n/p?q", "://", "http://a.net/" + "y" * 70_000] * 2


def test_verdicts_equal_brute_force(spark):
    found = urls()
    pages = spark.createDataFrame([(i, u, "h", "clash", "clash", "clash", 7, 7) for i, u in enumerate(found)], PAGES)
    chosen = [u for u in found[::5] if u and "://" in u] + ["nonsense"]
    listed = spark.createDataFrame([(u,) for u in chosen], "url string")
    keys = {canonical(u) for u in chosen if "://" in u}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {i: brute(u, keys) for i, u in enumerate(found)}
    assert sum(v[2] is None and v[3] == "block" for v in got.values()) > 50


def test_the_bloom_filter_has_no_false_negatives_and_few_hits(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    n_blocks = 20_000 * url_filter.BITS_PER_KEY // 512
    blocks = url_filter.bloom_blocks(keys, n_blocks)
    from functools import reduce

    from pyspark.sql import functions as F
    probe = spark.range(40_000).selectExpr("id", "concat('k', id) as key")
    masks = url_filter._masks(F.col("key"))
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    found = probe.withColumn("block", url_filter._block(F.col("key"), n_blocks)).join(blocks, "block", "left") \
        .withColumn("hit", F.coalesce(hit, F.lit(False)))
    assert found.where("id < 20000 and not hit").count() == 0
    assert found.where("id >= 20000 and hit").count() < 400


def test_empty_tables(spark):
    pages = spark.createDataFrame([], PAGES)
    some = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(pages, some).count() == 0
    assert url_filter.filter_urls(some, nothing).first()["verdict"] == "allow"


def test_no_python_on_the_main_path(spark, small):
    from runhealth.llm.queries import url_filters

    plan = url_filters(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
