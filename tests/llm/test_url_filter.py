import random

from genolith.llm import url_filter as uf
from genolith.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url[url.index("://") + 3 :]
    n = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host, tail = rest[:n].translate(LOWER), rest[n:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.org/es/x?y#z", "http://example.org/en/123", "http://example.org/en/2", "http://notorg/", "http://org", "http://x.org?/es/", "http://example.com/fr/", "http://example.com/FR/",
    "http://a..com/de/", "://com/de/1", "http://u@example.com:80/de/", "http://É.com/fr/é?x", "http://example.org//es/", "http://com/de/" + "x" * 20_000, "a://b://example.org/es/", "http://" + "a." * 300 + "org/es/",
]


def test_against_brute_force(spark):
    r = random.Random(6)
    urls = URLS + [f"http://{'.'.join(r.choices(['a', 'example', 'org', 'com', ''], k=r.randrange(4)))}{''.join(r.choices(['/', 'es', 'en', '1', 'fr', 'de', '?', '#'], k=r.randrange(6)))}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(1, "http://org/", "x"), (None, "http://org/", "x"), (1, "http://org/", "x")], "page_id long, url string, rule string")
    many = [*uf.RULES, ("block", "a.example.org", "/"), ("allow", "com", ""), ("block", "com", ""), ("allow", "", "/x"), ("block", "Example.COM", "/fr/x")]
    for rules in (uf.RULES, many, []):
        known = [(v, h.translate(LOWER), p) for v, h, p in rules if h]
        got = uf.filter_urls(pages, uf.rule_table(spark, rules), Scratch(spark, "t")).collect()
        assert len(got) == len(urls) + 3
        for x in got:
            url = urls[x.page_id] if x.page_id is not None and x.path != "/" else None
            if url is not None:
                assert (x.host, x.path, x.rule, x.verdict) == brute(url, known), url
    assert uf.filter_urls(pages.limit(0), uf.rule_table(spark, uf.RULES), Scratch(spark, "t")).count() == 0
