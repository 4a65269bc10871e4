import datetime
import json

import wordloom as wl
from wordloom.functions import text as tx
from wordloom.schemas import ITEM
from pyspark.sql import functions as F

from .conftest import rows

LINE = {
    "website": "spiegel", "date": "2020-03-18", "index": 0, "url": "https://u/1",
    "rubrics": "politics", "paywall": False, "title": "T", "text": "ein\nText",
}


def lines(spark, *records):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_ingest_and_rejects(spark):
    without = {k: v for k, v in LINE.items() if k not in ("title", "url")}
    df = lines(
        spark,
        {**LINE, "index": 3, "title": "later"},
        LINE,
        {**LINE, "text": "other"},
        without,
        "{broken",
        "",
        {k: v for k, v in {**LINE, "text": "third"}.items() if k not in ("rubrics", "paywall")},
    )
    articles, rejects = wl.ingest_articles(df, "Spiegel", datetime.date(2020, 3, 19))
    assert rows(articles, "title", "rubric", "paywall", "num_characters", "text") == [
        ("T", None, None, 5, "third"),
        ("T", "politics", False, 5, "other"),
        ("T", "politics", False, 8, "ein Text"),
    ]
    first = articles.first()
    assert (first["media"], first["date"]) == ("Spiegel", datetime.date(2020, 3, 19))
    assert rows(rejects, "reject_reason") == [("malformed JSON",), ("missing url, title",)]
    again, _ = wl.ingest_articles(df, "Spiegel", "2020-03-20")
    assert rows(again, "text_id") == rows(articles, "text_id")


def items(spark, *data):
    full = [
        {"url": f"https://u/{n}", "website": "w", "index": n, "rubrics": "homepage", "paywall": True, **d}
        for n, d in enumerate(data)
    ]
    return spark.createDataFrame(full, ITEM)


def test_assembly_of_items(spark):
    df = items(
        spark,
        {"title": [" Titel ", "x"], "text": ["a" * 25, "b" * 24]},  # 50 characters
        {"title": [], "text": ["a" * 25, "é" * 25 + " "]},  # 51 after trimming
        {"title": ["t"], "text": ["...", "c" * 60]},
        {"title": ["t"], "text": []},
        {"title": [" t\n"], "text": ["É" * 51]},
    )
    got = wl.assemble_articles(df, "2020-03-18")
    assert rows(got, "index", "title") == [(1, ""), (4, "t")]
    line = json.loads(got.where("index = 4").first()["line"])
    assert line["text"] == "É" * 51 and line["date"] == "2020-03-18" and line["paywall"] is True
    articles, rejects = wl.ingest_articles(got.select(F.col("line").alias("value")), "FAZ", "2020-03-18")
    assert articles.count() == 2 and rejects.count() == 0


def site(spark, url, expected, literal=False):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(tx.website_of_url(F.col("url"), literal)).first()[0] == expected


def test_website_names(spark):
    site(spark, "https://www.spiegel.de/politik/x.html", "spiegel")
    site(spark, "https://elpais.com/a", "elpais")
    site(spark, "http://elpais.com/a", "elpais")
    site(spark, "https://elpais.com/a", "elpais", literal=True)
    site(spark, "https://www.lemonde.fr", "lemonde", literal=True)


def pages(spark, *data):
    return spark.createDataFrame(list(data), "media string, url string, html string")


def test_links_of_every_kind(spark):
    df = pages(
        spark,
        ("Spiegel", "https://www.spiegel.de", """
            <a class="text-black block" href="https://s/politik/a">A</a>
            <a class='text-black block' href="/relative">B</a>
            <a class="block" href="https://s/no">C</a>
            <A HREF="https://s/wirtschaft/d?x=1&amp;y=2" CLASS="text-black block">D</A>
            <a class="text-black block" href="https://s/sport"><img src="x">E</a>"""),
        ("Bild", "https://www.bild.de", '<a href="/x.html">1</a><a href="http://o/y.html">2</a><a href="/z">3</a>'),
        ("Elpais", "https://elpais.com", '<article class="articulo x"><h2><a href="https://elpais.com/economia/1">1</a></h2></article><a href="https://elpais.com/2">2</a>'),
        ("Lemonde", "https://www.lemonde.fr", '<div class="articles"><p><a href="/politique/1">1</a></div><a href="/2">2</a>'),
        ("Unknown", "https://x", '<a href="/2">2</a>'),
    )
    got = wl.extract_links(df)
    assert rows(got, "media", "index", "url", "rubrics") == [
        ("Bild", 0, "https://www.bild.de/x.html", None),
        ("Elpais", 0, "https://elpais.com/economia/1", "economics"),
        ("Lemonde", 0, "/politique/1", "politics"),
        ("Spiegel", 0, "https://s/politik/a", "politics"),
        ("Spiegel", 1, "https://s/wirtschaft/d?x=1&y=2", "economics"),
        ("Spiegel", 2, "https://s/sport", "homepage"),
    ]


def item(spark, media, url, html):
    got = wl.extract_articles(pages(spark, (media, url, html))).first()
    return got["title"], got["text"], got["paywall"], got["rubrics"], got["website"]


def test_articles_of_every_medium(spark):
    spiegel = """<article><header><h1><span class="x align-middle">Ti<b>tel</b></span></h1></header>
        <div><p>Eins <a href="x">zwei</a><p>drei &amp; vier<br>f&uuml;nf</p></div>nicht</article><p>draussen</p>"""
    url = "https://www.spiegel.de/politik/a.html"
    got = item(spark, "Spiegel", url, spiegel)
    assert got == (["Ti", "tel"], ["Eins ", "zwei", "drei & vier", "fünf"], False, "politics", "spiegel")
    walled = spiegel + '<div data-component="Paywall"><i>pay</i></div>'
    assert item(spark, "Spiegel", url, walled)[2] is True
    assert item(spark, "Spiegel", url, '<div data-component="Paywall"></div>')[2] is False

    faz = '<span class="atc-HeadlineText">H</span><p class="x atc-TextParagraph">T</p><div class="xPaywall">p</div>'
    assert item(spark, "FAZ", "https://www.faz.net/a", faz) == (["H"], ["T"], True, "homepage", "faz")

    sz = '<h2><span class="css-dtx5jp">H</span></h2><div class="sz-article__body"><p class="a">T</p><p>no</p></div>'
    got = item(spark, "Sueddeutsche", "https://www.sueddeutsche.de/wirtschaft/a?reduced=true", sz)
    assert got == (["H"], ["T"], True, "economics", "sueddeutsche")
    assert item(spark, "Sueddeutsche", "https://www.sueddeutsche.de/a?x=reduced", sz)[2] is False

    bild = '<h2><span class="headline">H</span></h2><div class="txt"><div>no</div><p>T</p></div>'
    assert item(spark, "Bild", "https://www.bild.de/a.html", bild) == (["H"], ["T"], None, None, "bild")

    elpais = '<h1 class="articulo-titulo x">H</h1><div class="articulo-cuerpo"><div><p>T</p></div></div><div><p>no</p></div>'
    assert item(spark, "Elpais", "https://elpais.com/politica/a", elpais) == (["H"], ["T"], False, "politics", "elpais")

    elmundo = '<h1 class="article__headline">H</h1><div class="article__body"><p>T</p></div><div class="article__premium">p</div>'
    assert item(spark, "Elmundo", "https://www.elmundo.es/economia/a", elmundo)[2:4] == (True, "economics")

    figaro = '<h1 class="a eziudsn0">H</h1><p class="ekabp3u0">T</p><div class="live-article">live</div>'
    url = "https://www.lefigaro.fr/economie/a"
    assert item(spark, "Lefigaro", url, figaro) == (["H"], ["T"], False, "economics", "lefigaro")
    live = figaro + '<h1 class="css-1ivsdme">L</h1><div class="essq5k66">p</div>'
    assert item(spark, "Lefigaro", url, live)[1:3] == (["live"], True)

    monde = '<h1 class="article__title">H</h1><p class="article__paragraph x">T</p><section id="js-paywall-content">p</section>'
    assert item(spark, "Lemonde", "https://www.lemonde.fr/politique/a", monde) == (["H"], ["T"], True, "politics", "lemonde")


def test_missing_page_and_broken_markup(spark):
    got = wl.extract_articles(pages(spark, ("FAZ", "https://www.faz.net/a", None))).first()
    assert got["text"] == [] and got["title"] == [] and got["index"] is None
    cut = '<p class="atc-TextParagraph">a &amp b &amp</p>'
    assert item(spark, "FAZ", "https://www.faz.net/a", cut)[1] == ["a & b &"]
    broken = '<p class="atc-TextParagraph">a</b></i><p class="atc-TextParagraph">b<div>c</div>d</p'
    assert item(spark, "FAZ", "https://www.faz.net/a", broken)[1] == ["a", "b"]


def test_metadata(spark):
    articles, _ = wl.ingest_articles(lines(spark, LINE), "Lemonde", "2020-03-18")
    meta = wl.article_metadata(articles, wl.media_language(F.col("media")))
    assert rows(meta, "language", "num_characters") == [("FR", 8)]
