import itertools
import re

import pytest

from evisift.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/f", "block")]
URLS = [
    None, "", "no scheme", "http://x.net/", "http://net/a", "http://xnet/a", "HTTP://WWW.Example.NET/en/1?q#f", "http://example.net/EN/1", "http://example.net",
    "http://example.net?x=/en/", "https://example.com/de/x", "https://example.com/de", "s://t.a.org/fr/", "s://a.org/fr/", "s://a.org/f", "x://y://z.net/en/", "://net/",
    "http:///path", "http://b.example.net.:80/en/", "http://é.org/fr/ü", "http://example.net/en/\nx", "a\nb://org/fr/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string, _key string")


def test_rows_equal_brute_force(spark, pages, monkeypatch):
    rules = spark.createDataFrame([*RULES, ("net", "/", "drop"), (None, "/", "block")], urls.SCHEMA)
    want = [(k, *brute(u)) for k, u in enumerate(URLS * 2)]
    assert sorted(map(tuple, urls.judge_urls(pages, rules).collect())) == want
    monkeypatch.setattr(urls, "BLOCK_RULES", 2)
    assert sorted(map(tuple, urls.judge_urls(pages, rules).collect())) == want


def test_collisions_are_told_apart(spark, pages, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda key: len(key) % 2)
    rules = RULES + [(f"h{k}.net", "/", "allow") for k in range(50)]
    packed = urls.pack(rules)
    path = urls.scratch_root(spark).removeprefix("file://") + "/packed-test"
    with open(path, "wb") as out:
        out.write(packed)
    array = urls.DigestArray(path)
    keys, hosts = zip(*((h + p, len(h)) for h, p, _ in rules), strict=True)
    assert array.find([*keys, "h99.net/", "net"], [*hosts, 7, 3]) == [v for _, _, v in rules] + [None, None]


def test_empty(spark, pages):
    none = spark.createDataFrame([], urls.SCHEMA)
    assert {r.verdict for r in urls.judge_urls(pages, none).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(RULES, urls.SCHEMA)).count() == 0


def test_all_parts():
    assert len({brute(u) for u in itertools.chain(URLS)}) > 12
