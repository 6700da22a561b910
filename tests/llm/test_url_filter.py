import re

from sievelight.llm.url_filter import RULES, judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def canon(url):
    host, path = parts(url)
    return re.sub(r"^www\.", "", host) + path.rstrip("/") if host else None


def brute(rows, listed):
    bad = {canon(u) for u in listed} - {None}
    out = []
    for page, url in rows:
        host, path = parts(url)
        fit = [(len(r), r, a) for a, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = (max(fit)[1:]) if fit else (None, "block" if canon(url) in bad else "allow")
        out.append((page, host, path, rule, verdict, canon(url) in bad))
    return sorted(out, key=str)


URLS = ["http://A.Example.COM/de/1?x", "https://example.net/en/2", "https://www.example.net/fr/2#t", "http://net", "http://net/", "http://internet/", "ftp://x.org/fr/", "x.org/fr/", "", None, "http://x.org?q=/fr/", "http://x.org/fr", "://", "a://b://c/d", "http://É.org/fr/é", "http://www.x.org/a/", "http://x.org/a//", "http://x.org/a?b", "http://y.org/a\nb", "http://example.com/de/9"]


def test_matches_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[0])]
    listed = ["http://x.org/a", "https://y.org/a\nb", None, "junk", "http://É.org/fr/é", "http://EXAMPLE.net/en/2"]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as URL")
    got = judge_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, listed)


def test_empty(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "x.com", "/", None, "allow", False)]
    assert judge_urls(pages.limit(0), none).count() == 0
