import random

import pytest

from lyrebird.llm import urls

RULES = [*urls.RULES, ("block", "example.net", "/en/private"), ("allow", "a.example.net", ""), ("block", "www.a.example.net", "/x"), ("allow", "www.a.example.net", "/x"), ("block", "xexample.net", "/")]


def brute(url, rules):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, "allow"
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def pages():
    rng = random.Random(2)
    hosts = ["net", "example.net", "EXAMPLE.NET", "a.example.net", "www.a.example.net", "xexample.net", "example.com", "b.example.com", "org", "x.org", "example.net:80", "..net", ".net", "", "日本.net", "u@net"]
    paths = ["", "/", "/en/", "/en", "/en/private/1", "/de/a", "/fr/", "/x", "/x/y", "//", "/EN/"]
    out = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/fr/', '?a://b/'])}" for _ in range(400)]
    return [*out, None, "", "no scheme", "http:/x", "a\nb://net/\n", *["http://www.a.example.net/x"] * 300]


def test_verdicts_equal_brute_force(spark):
    rows = list(enumerate(pages()))
    table = spark.createDataFrame([(i, u, "extra") for i, u in rows] + [(None, "http://net/", "extra")], "page_id long, url string, host string")
    found = urls.judge(table, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect()
    expected = [(i, *brute(u, RULES)) for i, u in [*rows, (None, "http://net/")]]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_without_rules_pages_or_sound_rules(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    table = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(table, none).collect()] == [(1, "net", "/", None, "allow")]
    rules = spark.createDataFrame(RULES, none.schema)
    assert urls.judge(table.limit(0), rules).count() == 0
    with pytest.raises(Exception, match="a rule needs"):
        urls.judge(table, spark.createDataFrame([("deny", "net", "/")], none.schema)).collect()
