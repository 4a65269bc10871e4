"""URL filters: rules against plain Python, features by hand, the trees on held-out URLs."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.llm import urls
from wordloom.llm.queries import QUERIES

ODD = [
    "http://Example.COM/en/1", "https://www.example.com/en/", "http://a.www.example.com/en/x?y=1#z", "http://xexample.com/en/",
    "http://example.com/en", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "x://NET/es/", "net/es/",
    "http://a.net/es/1", "http://a.net/ES/1", "http://a.net/fr/", "http://anet/fr/", "http://b.com//en/", "http://É.com/É", "://.com/",
    "a://b://c.com/en/", "http://user@www.example.com:80/en/", "http://c.com/\n/x", "", " ", None, "://", "http:///en/", "ftp://x.org/a.b/c.tar.gz?a=1&&b#f",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        on, start = rule.split("/", 1)
        if (host == on or host.endswith("." + on)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").toPandas()
    rows = list(pages.itertuples(index=False, name=None)) + [(-i, u) for i, u in enumerate(ODD, 1)] + [(-1, ODD[0]), (None, ODD[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "rule", "half", "bucket", "label")})
    got = urls.judge_urls(df).collect()
    expected = Counter()
    for page, url in rows:
        host, path = plain_parts(url)
        expected[page, host, path, plain_rule(host, path)[0]] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == expected
    for r in got:
        verdict = plain_rule(r["host"], r["path"])[1]
        assert r["verdict"] == (verdict or ("block" if r["blocked"] >= 0.5 else "allow"))


def test_longest_rule_wins():
    assert plain_rule("www.example.com", "/en/x") == ("www.example.com/en/", "allow")
    assert plain_rule("blog.example.com", "/en/x") == ("example.com/en/", "block")
    assert plain_rule("example.com", "/de/x") == ("com/", "allow")


def test_features(spark):
    rows = [(u, *plain_parts(u)) for u in ODD]
    df = urls.described(spark.createDataFrame(rows, "url string, host string, path string"))
    for r in df.collect():
        url = r["url"] or ""
        n = len(url)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
        query = url.split("?", 1)[1].split("#")[0] if "?" in url.split("#")[0] and "://" in url else ""
        assert r["entropy"] == pytest.approx(bits)
        assert r["url_length"] == n and r["digit_ratio"] == pytest.approx(len(re.findall("[0-9]", url)) / max(n, 1))
        assert r["depth"] == len([p for p in r["path"].split("/") if p])
        assert r["labels"] == (len(r["host"].split(".")) if r["host"] else 0)
        assert r["parameters"] == len([p for p in query.split("&") if p])
        assert all(0 <= r[s] < urls.BUCKETS for s in urls.SUFFIXES)


def test_own_label_stays_out(spark):
    """A labelled URL is described by the counts of the other half only."""
    rows = [("u", "h", "p", 0, 1, 5), ("v", "h", "p", 0, 0, 5), ("w", "h", "p", 1, 1, 5)]
    df = spark.createDataFrame(rows, "url string, host string, path string, half int, blocked int, top int")
    df = df.withColumns({s: F.lit(100 + i) for i, s in enumerate(urls.SUFFIXES[1:])})
    counts = urls.suffix_counts(df)
    seen = {r["url"]: (r["top_blocked"], r["top_seen"]) for r in urls.with_suffixes(df, counts, F.col("half")).collect()}
    assert seen["u"] == seen["v"] == (pytest.approx(2 / 3), pytest.approx(math.log(2)))
    assert seen["w"] == (pytest.approx(2 / 4), pytest.approx(math.log(3)))
    assert urls.with_suffixes(df, counts).first()["top_blocked"] == pytest.approx((1 + 1) / (1.5 + 2))


def test_held_out(spark):
    """Trained on four fifths of the URLs that rules decide, the trees find most verdicts of the others."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    df = df.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    df = df.withColumn("found", urls.longest_rule(F.col("host"), F.col("path"))).where("found is not null").distinct()
    held = F.pmod(F.crc32(F.encode("url", "UTF-8")), F.lit(5)) == 0
    model = urls.train(df.where(~held).select("url", "found.verdict"))
    tested = model.scored(df.where(held).select("url", "host", "path", "found.verdict")).collect()
    right = sum((r["blocked"] >= 0.5) == (r["verdict"] == "block") for r in tested)
    assert len(tested) > 200 and right / len(tested) > 0.9
    again = urls.train(df.where(~held).select("url", "found.verdict"))
    assert sorted(map(tuple, again.scored(df.where(held)).select("url", "blocked").collect())) == sorted((r["url"], r["blocked"]) for r in tested)


@pytest.mark.parametrize("only, verdict", [([], "allow"), (["http://a.com/x"], "allow"), (["http://a.net/es/x"], "block")])
def test_labels_of_one_kind(spark, only, verdict):
    rows = [(i, u) for i, u in enumerate([*only, "http://a.org/x", None])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["verdict"] for r in got} == {verdict} and len(got) == len(rows)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty).collect() == []
    rows = [(1, "http://a.com/" + "x" * 300_000), (2, "http://a.net/es/" + "y/" * 100_000), (3, "z" * 200_000)] * 2
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter((r["page_id"], r["rule"]) for r in got) == {(1, "com/"): 2, (2, "net/es/"): 2, (3, None): 2}


def test_registered(spark, sf_dir):
    df = QUERIES["op11_url_filters"](spark, sf_dir)
    assert df.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert df.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
