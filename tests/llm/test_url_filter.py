import math

import numpy as np

from tablecare.llm import url_filter
from tablecare.llm.queries import URL_RULES

from .helpers import LOWER, SMALL


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    return host.translate(LOWER), rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def rule_of(host, path):
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def test_rules_and_model(spark):
    more = [(9001, "http://cheappills.example.net/x"), (9002, "http://onlinecasinowin.net/"), (9003, None), (9004, "no scheme"), (9005, "HTTP://A.ORG?x://y/z"),
            (9006, "http://EXAMPLE.org/en/12#://"), (9007, "http://xexample.org/es/"), (9008, "ftp://org/"), (9008, "ftp://org/"), (9009, "://"), (9010, "http://é.com/fr/é")]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(more, "page_id long, url string"))
    got = url_filter.judge_urls(pages.selectExpr("*", "'x' as host", "1 as score"), URL_RULES).collect()
    assert len(got) == pages.count()
    for r in got:
        assert (r["host"], r["path"]) == plain(r["url"])
        best = rule_of(r["host"], r["path"])
        assert r["rule"] == (best and best[0])
        assert r["verdict"] == (best[1] if best else "block" if r["score"] > math.log(10) else "allow")
    plain_hosts = [r for r in got if r["rule"] is None and r["page_id"] < 9000]
    bad = [any(x in r["host"] for x in ("spam", "pills", "casino", "bets", "ads-", "track")) for r in plain_hosts]
    assert all(r["verdict"] == "block" for r, b in zip(plain_hosts, bad) if b) and any(bad)
    assert sum(r["verdict"] == "block" for r, b in zip(plain_hosts, bad) if not b) <= 0.05 * len(bad)
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[9001] == by[9002] == "block" and by[9003] == by[9004] == by[9009] == "allow"
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_segmentation():
    counts = np.zeros(2 * url_filter.SLOTS, np.int64)
    for w, n in (("green", 50), ("house", 60), ("news", 80), ("the", 500)):
        for s in url_filter._slots(w):
            counts[s] += n
    words = url_filter.Words(counts)
    assert words.split("thegreenhousenews") == ["the", "green", "house", "news"] and words.split("casinowin") == ["casino", "win"]
    assert words.split("") == [] and "".join(words.split("qzxv" * 30)) == "qzxv" * 30


def test_joined_names_do_not_vouch_for_themselves(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    n = pages.count()
    for copies in (1, n // 2):
        joined = ["http://www.freecasino.net/en/{}", "http://cheappills.example.net/en/{}", "https://m.onlinecasinowin.org/{}"]
        more = [(10**6 + 3 * i + k, u.format(i)) for k, u in enumerate(joined) for i in range(copies if k == 0 else 1)]
        got = url_filter.judge_urls(pages.union(spark.createDataFrame(more, "page_id long, url string")), []).toPandas()
        new = got["page_id"] >= 10**6
        assert (got["verdict"][new] == "block").all() and new.sum() == len(more)
        wanted = ~got["host"].str.contains("spam|pills|casino|bets|ads-|track")
        assert (got["verdict"][wanted] == "block").mean() <= 0.05


def test_what_counts_as_a_word(spark):
    assert url_filter.vouched("www.freecasino.co.uk:80", "/news/1") == ("freecasino.co.uk", {"www", "co", "uk", "news"})
    assert url_filter.vouched("free-casino.net", "") == ("free-casino.net", {"free", "casino", "net"})
    assert url_filter.vouched("", "") == ("", set()) and url_filter.vouched("localhost", "/a")[1] == {"localhost", "a"}
    urls = [(f"h{'abc'[i % 3]}.site{'xyz'[i % 3]}.net", "/green/freecasino") for i in range(90)] + [("freecasino.org", "/house")] * 50
    counts = url_filter._unigrams(spark.createDataFrame(urls, "host string, path string"))
    n = {w: min(int(counts[s]) for s in url_filter._slots(w)) for w in ("green", "house", "freecasino", "net", "org")}
    assert n == {"green": 2, "house": 0, "freecasino": 2, "net": 2, "org": 0}
    words = url_filter.Words(counts)
    assert words.split("freecasino") == ["free", "casino"] and words.split("greencasino") == ["green", "casino"]
    assert [words.split(w) for w in ("winter", "window", "freedom", "example")] == [["winter"], ["window"], ["freedom"], ["example"]]
