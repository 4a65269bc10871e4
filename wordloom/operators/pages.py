"""Raw pages to article links and article items, by rules per medium.

A page is parsed once, in Arrow batches on the executors: HTML is not XML, and Spark's own XPath
functions fail on it. Everything after the parse is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..schemas import require_columns


@dataclass(frozen=True)
class Step:
    """An element on the way down: tag (any if empty) and a test on one attribute.

    ``test``: "" none, "has" attribute present, "is" equal to value, "in" contains value.
    """

    tag: str = ""
    attribute: str = ""
    test: str = ""
    value: str = ""

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        if not self.test:
            return True
        if self.attribute not in attributes:
            return False
        actual = attributes[self.attribute]
        if self.test == "is":
            return actual == self.value
        return self.test == "has" or self.value in actual


Path = tuple[Step, ...]


@dataclass(frozen=True)
class MediaRule:
    """What to read from the pages of one medium."""

    links: Path
    title: Path
    text: Path
    link_prefix: str = ""  # keep links that start so
    link_host: str = ""  # keep relative links and put this in front
    politics: str | None = None  # URL path part of the rubric
    economics: str | None = None
    has_rubrics: bool = True
    paywall: Path | None = None  # any text under it means paywall
    paywall_query: str = ""  # or this query parameter does
    has_paywall: bool = True
    live_title: Path | None = None  # when found, text comes from live_text
    live_text: Path | None = None


def _cls(tag: str, value: str, test: str = "in") -> Step:
    return Step(tag, "class", test, value)


# Where each medium keeps links, title, text and its paywall mark.
MEDIA_RULES: dict[str, MediaRule] = {
    "Spiegel": MediaRule(
        links=(_cls("a", "text-black block", "is"),),
        link_prefix="https",
        politics="politik",
        economics="wirtschaft",
        title=(Step("article"), Step("header"), _cls("span", "align-middle")),
        text=(Step("article"), Step("p")),
        paywall=(Step("div", "data-component", "is", "Paywall"),),
    ),
    "FAZ": MediaRule(
        links=(
            _cls("a", "js-hlp-LinkSwap js-tsr-Base_ContentLink tsr-Base_ContentLink", "is"),
        ),
        link_prefix="https",
        politics="politik",
        economics="wirtschaft",
        title=(_cls("span", "atc-HeadlineText", "is"),),
        text=(_cls("p", "atc-TextParagraph"),),
        paywall=(_cls("div", "Paywall"),),
    ),
    "Sueddeutsche": MediaRule(
        links=(_cls("a", "sz-teaser"),),
        link_prefix="https",
        politics="politik",
        economics="wirtschaft",
        title=(Step("h2"), _cls("span", "css-dtx5jp", "is")),
        text=(_cls("div", "sz-article__body"), Step("p", "class", "has")),
        paywall_query="reduced=true",
    ),
    "Bild": MediaRule(
        links=(Step("a", "href", "in", ".html"),),
        link_host="https://www.bild.de",
        has_rubrics=False,
        title=(Step("h2"), _cls("span", "headline", "is")),
        text=(_cls("div", "txt", "is"), Step("p")),
        has_paywall=False,
    ),
    "Elpais": MediaRule(
        links=(_cls("article", "articulo"),),
        link_prefix="https://elpais.com",
        politics="politica",
        economics="economia",
        title=(_cls("h1", "articulo-titulo"),),
        text=(_cls("div", "articulo-cuerpo"), Step("p")),
    ),
    "Elmundo": MediaRule(
        links=(_cls("a", "cover-content"),),
        link_prefix="https://www.elmundo.es",
        politics="politica",
        economics="economia",
        title=(_cls("h1", "article__headline"),),
        text=(_cls("div", "article__body"), Step("p")),
        paywall=(_cls("div", "article__premium"),),
    ),
    "Lefigaro": MediaRule(
        links=(_cls("a", "css-m47150 esdb6og4"),),
        link_host="https://www.lefigaro.fr",
        politics="politique",
        economics="economie",
        title=(_cls("h1", "eziudsn0"),),
        text=(_cls("p", "ekabp3u0"),),
        live_title=(_cls("h1", "css-1ivsdme"),),
        live_text=(_cls("div", "live-article"),),
        paywall=(_cls("div", "essq5k66"),),
    ),
    "Lemonde": MediaRule(
        links=(_cls("div", "article"),),
        politics="politique",
        economics="economie",
        title=(_cls("h1", "article__title"),),
        text=(_cls("p", "article__paragraph"),),
        paywall=(Step("section", "id", "in", "js-paywall-content"),),
    ),
}

# Elements without an end tag; elements whose start ends an open paragraph.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)


class _PathReader(HTMLParser):
    """Collects text parts under paths and href values under link paths."""

    def __init__(self, text_paths: dict[str, Path], link_path: Path | None):
        super().__init__(convert_charrefs=True)
        self._paths = dict(text_paths)
        if link_path:
            self._paths["links"] = link_path
        self.found: dict[str, list[str]] = {name: [] for name in self._paths}
        self._texts = list(text_paths)
        # Per open element: its tag and, per path, how many steps are met down to here.
        self._open: list[tuple[str, dict[str, int]]] = []
        self._none = dict.fromkeys(self._paths, 0)

    def _met(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> dict[str, int]:
        above = self._open[-1][1] if self._open else self._none
        attributes = {name: value or "" for name, value in attrs}
        met = {}
        for name, path in self._paths.items():
            done = above[name]
            met[name] = done + (done < len(path) and path[done].fits(tag, attributes))
        if "links" in met and met["links"] == len(self._paths["links"]) and "href" in attributes:
            self.found["links"].append(attributes["href"])
        return met

    def _drop(self, tag: str) -> None:
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                del self._open[at:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_PARAGRAPH:
            self._drop("p")
        met = self._met(tag, attrs)
        if tag not in _VOID:
            self._open.append((tag, met))

    def handle_startendtag(self, tag, attrs):
        self._met(tag, attrs)

    def handle_endtag(self, tag):
        self._drop(tag)

    def handle_data(self, data):
        if not self._open:
            return
        met = self._open[-1][1]
        for name in self._texts:
            if met[name] == len(self._paths[name]):
                self.found[name].append(data)


def _read(html: str | None, rule: MediaRule, links: bool) -> dict[str, list[str]]:
    paths = {}
    if not links:
        paths = {"title": rule.title, "text": rule.text}
        for name in ("paywall", "live_title", "live_text"):
            if getattr(rule, name):
                paths[name] = getattr(rule, name)
    reader = _PathReader(paths, rule.links if links else None)
    if html is not None:
        reader.feed(html)
        reader.close()
    return reader.found


def _medium_rule(rules: dict[str, MediaRule], value) -> Column:
    """Per medium a literal of its rule, looked up by the ``media`` column."""
    entries = [x for name, rule in rules.items() for x in (F.lit(name), value(rule))]
    return F.try_element_at(F.create_map(*entries), F.col("media"))


def _rubric(rules: dict[str, MediaRule], url: Column) -> Column:
    return reduce(
        lambda rest, item: F.when(
            F.col("media") == item[0], tx.rubric_of_url(url, item[1].politics, item[1].economics)
        ).otherwise(rest),
        [(n, r) for n, r in rules.items() if r.has_rubrics],
        F.lit(None).cast("string"),
    )


def extract_links(
    pages: DataFrame, rules: dict[str, MediaRule] | None = None, media: Column | str | None = None
) -> DataFrame:
    """Article links of overview pages: (media, page_url, index, url, rubrics).

    ``pages`` has url, html and media (or ``media`` is given). The index is the position among the
    links kept from the page. Pages of media without a rule yield nothing.
    """
    rules = MEDIA_RULES if rules is None else rules
    pages = _with_media(pages, media, rules)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["links"] = [
                _read(html, rules[medium], True)["links"]
                for html, medium in zip(batch["html"], batch["media"])
            ]
            yield batch[["media", "page_url", "links"]]

    found = pages.select("media", F.col("url").alias("page_url"), "html").mapInPandas(
        read, "media string, page_url string, links array<string>"
    )
    prefix = _medium_rule(rules, lambda r: F.lit(r.link_prefix))
    host = _medium_rule(rules, lambda r: F.lit(r.link_host))
    found = found.withColumns({"prefix": prefix, "host": host})
    kept = F.filter(
        "links",
        lambda link: F.when(F.col("host") != "", ~link.startswith("http")).otherwise(
            link.startswith(F.col("prefix"))
        ),
    )
    full = F.transform(kept, lambda link: F.concat(F.col("host"), link))
    rows = found.select("media", "page_url", F.posexplode(full).alias("index", "url"))
    return rows.select(
        "media",
        "page_url",
        F.col("index").cast("bigint").alias("index"),
        "url",
        _rubric(rules, F.col("url")).alias("rubrics"),
    )


def _with_media(
    pages: DataFrame, media: Column | str | None, rules: dict[str, MediaRule]
) -> DataFrame:
    require_columns(pages, ["url", "html"], "pages")
    if media is not None:
        pages = pages.withColumn("media", F.lit(media) if isinstance(media, str) else media)
    require_columns(pages, ["media"], "pages")
    return pages.where(F.col("media").isin(list(rules)))


def pages_without_rule(
    pages: DataFrame, rules: dict[str, MediaRule] | None = None, media: Column | str | None = None
) -> DataFrame:
    """Pages that no rule can read: media, url, reject_reason."""
    rules = MEDIA_RULES if rules is None else rules
    if media is not None:
        pages = pages.withColumn("media", F.lit(media) if isinstance(media, str) else media)
    require_columns(pages, ["url", "media"], "pages")
    known = F.coalesce(F.col("media").isin(list(rules)), F.lit(False))
    return pages.where(~known).select("media", "url", F.lit("no rule").alias("reject_reason"))


def extract_articles(
    pages: DataFrame, rules: dict[str, MediaRule] | None = None, media: Column | str | None = None
) -> DataFrame:
    """Items (url, title, text, website, index, comments, rubrics, paywall) of article pages.

    ``index`` is taken over when the pages carry it (the position of the link), else NULL.
    """
    rules = MEDIA_RULES if rules is None else rules
    pages = _with_media(pages, media, rules)
    if "index" not in pages.columns:
        pages = pages.withColumn("index", F.lit(None).cast("bigint"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages_found = [
                _read(html, rules[medium], False)
                for html, medium in zip(batch["html"], batch["media"])
            ]
            batch["title"] = [found["title"] for found in pages_found]
            batch["text"] = [
                found["live_text"] if found.get("live_title") else found["text"]
                for found in pages_found
            ]
            batch["marked"] = [bool(found.get("paywall")) for found in pages_found]
            yield batch[["media", "url", "index", "title", "text", "marked"]]

    found = pages.select("media", "url", F.col("index").cast("bigint"), "html").mapInPandas(
        read,
        "media string, url string, index bigint, title array<string>, text array<string>, "
        "marked boolean",
    )
    query = _medium_rule(rules, lambda r: F.lit(r.paywall_query))
    has_paywall = _medium_rule(rules, lambda r: F.lit(r.has_paywall))
    paywall = F.when(
        has_paywall, F.col("marked") | ((query != "") & tx.has_query_parameter(F.col("url"), query))
    )
    return found.select(
        "url",
        "title",
        "text",
        tx.website_of_url(F.col("url")).alias("website"),
        "index",
        F.lit(None).cast("string").alias("comments"),
        _rubric(rules, F.col("url")).alias("rubrics"),
        paywall.alias("paywall"),
        "media",
    )
