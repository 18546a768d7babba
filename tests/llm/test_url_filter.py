"""The URL filter against a plain rule loop, colliding digests included."""
import random

import pytest

from qualitas.llm import queries, url_filter
from qualitas.session import work_folder


def plain(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:cut + 1] == "/" else ""
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(f[:2] for f in fit)
    same = [f for f in fit if f[:2] == best]
    return host, path, same[0][2], "block" if any(f[3] == "block" for f in same) else "allow"


URLS = ["http://Example.ORG/es/1", "https://a.example.org/en/12?x=/es/", "http://b.org", "http://b.org/", "//x", None,
        "", "no scheme", "ftp://u@c.com/fr/", "http://c.com/de/#a", "http://c.com?/de/", "http://xorg/", "http://.org/",
        "http:///path", "a://b://c.org/", "http://example.org:80/es/", "http://com/fr/é", "http://ÉX.org/" + "x" * 9000]


def test_contract_rules(spark):
    rng = random.Random(5)
    urls = URLS + ["http://" + rng.choice(["a.", ""]) + rng.choice(["example.org", "b.com", "net", "org"])
                   + rng.choice(["/es/", "/en/1", "/en/2", "/fr/x", "/de/", "", "?", "#/"]) for _ in range(200)]
    folder = url_filter.build(spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"),
                              work_folder(spark, "rules"))
    pages = spark.createDataFrame([(i, u, "taken", 3) for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, folder).collect()}
    assert got == {i: plain(u, queries.URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), folder).count() == 0


def test_many_rules_and_collisions(spark, monkeypatch):
    rng = random.Random(7)
    hosts = [f"h{i}.{t}" for i in range(60) for t in ("org", "com")]
    rules = [(rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(300)]
    folder = url_filter.build(spark.createDataFrame(rules, "host string, path string, verdict string"),
                              work_folder(spark, "rules"))
    index = url_filter.Index(folder)
    probes = [h + p for h in hosts for p in ("", "/", "/a", "/a/b", "/c")]
    want = [(any(h + p == x for h, p, _ in rules), any(h + p == x and v == "block" for h, p, v in rules)) for x in probes]
    assert index.find(probes) == want
    for shard in index.shards:                      # the same search with every digest of a shard alike
        assert list(shard[0]) == sorted(shard[0])
    keys = [k.copy() for k, *_ in index.shards]
    for k in keys:
        k[:] = 0
    index.shards = [(k, *rest) for k, (_, *rest) in zip(keys, index.shards)][:1]
    index.firsts = index.firsts[:1] * 0
    monkeypatch.setattr(url_filter, "digest", lambda raw: 0)
    _, offsets, strings, _ = index.shards[0]
    there = {strings[offsets[i]:offsets[i + 1]].decode() for i in range(len(offsets) - 1)}
    assert [f for f, _ in index.find(probes)] == [x in there for x in probes]


def test_odd_rules(spark):
    schema = "host string, path string, verdict string"
    empty = url_filter.build(spark.createDataFrame([], schema), work_folder(spark, "rules"))
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert url_filter.judge(pages, empty, default="block").first().verdict == "block"
    for rule in ((None, "/", "allow"), ("a.org", "x", "allow")):
        with pytest.raises(Exception, match="a rule needs"):
            url_filter.build(spark.createDataFrame([rule], schema), work_folder(spark, "rules"))


def test_input_columns_of_the_results_names_are_replaced(spark):
    rules = url_filter.build(spark.createDataFrame([("a.org", "/", "block")], "host string, path string, verdict string"),
                             work_folder(spark, "rules"))
    pages = spark.createDataFrame([(1, "http://a.org/x", "own", 7)], "page_id long, url string, host string, rule int")
    assert url_filter.judge(pages, rules).first().asDict() == {
        "page_id": 1, "url": "http://a.org/x", "host": "a.org", "path": "/x", "rule": "a.org/", "verdict": "block"}


def test_oracle(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP8_SQL}) ORDER BY 1").fetchall()
    got = queries.op8_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id")
    assert [tuple(r) for r in got.collect()] == want
