"""URL filters against rules tried one by one."""

import random
import re

import pytest

from nbquarry.llm import urls
from nbquarry.llm.queries import URL_RULES


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def plain(url, rules):
    host, path = split(url)
    fitting = [
        (len(h) + len(p), len(h), v, h + p) for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fitting, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://com/", "http://example.com", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/a",
    "http://notexample.com/en/", "ftp://x.net/es/", "http://net/fr/", "http://x.net/es", "http://x.net?/es/", "http://x.com/?u=http://y.net/es/", "http://x.org/en/",
    "http://.com/", "http://x..com/", "http://" + "a." * 300 + "com/x", "http://x.com/" + "p/" * 3000, "\nhttp://x.net/es/\nz", "http://\u00c4.net/es/", "a://b://c.com/", "http://x.com:80/",
]


@pytest.mark.parametrize("rules", [
    URL_RULES, URL_RULES + URL_RULES, [("block", "", ""), ("allow", "com", "/")], [("block", "x.com", "/"), ("allow", "com", "/"), ("allow", "x.com", "/")],
    [("block", "com", "/p/p/"), ("allow", "x.com", "/p"), ("block", "net", "/e")], [("block", "b.c.d", "/a"), ("block", "c.d", "/a/b"), ("allow", "d", "/a/b/c")],
])
def test_rules(spark, rules):
    rng = random.Random(1)
    made = ["http://" + ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) + "".join("/" + rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(80)]
    given = URLS + made + made[:10]
    pages = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate(given)], "page_id long, url string, url_host string, verdict int, won string")
    found = {r.page_id: r for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    assert len(found) == len(given)
    for i, u in enumerate(given):
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == plain(u, rules), u


def test_empty_tables(spark):
    rules = urls.rule_table(spark, URL_RULES)
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert [(r.rule, r.verdict) for r in urls.judge(pages, rules.limit(0)).collect()] == [(None, "allow")]
