import random

import pytest

from seriesmill.llm.url_filters import filter_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(LOWER), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, a in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (len(h + (p or "")), len(h), h + (p or ""), a)
            best = key if best is None or key[:3] > best[:3] or (key[:3] == best[:3] and a < best[3]) else best
    return host, path, best and best[2], best[3] if best else default


def test_equals_brute_force(spark):
    rng = random.Random(6)
    labels, parts = ["a", "b", "com", "net", "x-y", "é", "A"], ["", "/", "/a", "/a/", "/ab/c", "/é", "/a/b/c?q=/a", "/#/a", "?x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host().lower(), rng.choice(parts[:6]), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/", "block"), (None, "/", "block"), ("com", None, "block")]
    urls = [(k, f"http://{host()}{rng.choice(parts)}{rng.choice(['', 'z', '/a'])}") for k in range(1500)]
    urls += [(9001, None), (9002, ""), (9003, "no scheme/a"), (9004, "://com/a"), (9005, "x://y://com/"), (9006, "http://com" + "/a" * 5000), (9007, "HTTP://B.COM\n/a"), (None, "http://com/"), (3, urls[3][1]), (3, urls[3][1])]
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in urls], "page_id long, url string, host string, id int")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    got = sorted(((r.id or 0, r.host, r.path, r.rule or "", r.verdict) for r in filter_urls(pages, frame).collect()))
    want = sorted((k or 0, h, p, r or "", v) for k, u in urls for h, p, r, v in [brute(u, [(x, y or "", a) for x, y, a in rules])])
    assert got == want
    assert len({x[3] for x in want}) > 20
    assert {r.verdict for r in filter_urls(pages, frame.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), frame).count() == 0


@pytest.mark.parametrize("partitions", ["1", "61"])
def test_a_hot_host_in_as_many_shares_as_partitions(spark, partitions):
    rules = spark.createDataFrame([("hot.org", "/", "block"), ("hot.org", "/a/", "allow"), ("b.hot.org", "/a/b", "block")], "host string, path string, action string")
    urls = [f"http://{host}/{path}{k}" for k in range(300) for host in ("hot.org", "b.hot.org") for path in ("", "a/", "a/b/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: (r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, url in enumerate(urls):
        host, path = url[7:].split("/", 1)
        if not path.startswith("a/"):
            want = ("hot.org/", "block")
        elif host == "b.hot.org" and path.startswith("a/b"):
            want = ("b.hot.org/a/b", "block")
        else:
            want = ("hot.org/a/", "allow")
        assert got[k] == want, url
    assert len(got) == len(urls)
