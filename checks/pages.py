"""Pages of the eight media, written out by hand as the sites mark them up, and what has to be read from them.

Nothing here is made from the rules of the library: each page is literal markup around a document's id and
lines, with parts beside them that must not be read. Marks: {id}, {rubric}, {body}, {line}, {wall}.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Site:
    url: str
    website: str
    rubrics: tuple[str, str, str] | None  # path parts of politics, economics and another
    page: str
    line: str  # markup of one line of text
    parts: str  # SQL: what is read of one line ``x``, a list
    wall: str = ""
    wall_in_url: str = ""


SITES = {
    "Spiegel": Site(
        "https://www.spiegel.de/{rubric}/deutschland/a-{id}", "spiegel", ("politik", "wirtschaft", "kultur"),
        '<html><head><title>Not this</title></head><body><header><span class="align-middle">Nor this</span></header><article>'
        '<header class="pt-16"><h2><span class="text-primary">Kicker</span><span class="leading-tight align-middle">Nr. {id}</span>'
        "</h2></header>{body}<div>aside</div></article><p>footer</p>{wall}</body></html>",
        '<p class="RichText">{line}</p>', "[x]",
        '<div data-area="x" data-component="Paywall"><span>Weiterlesen</span></div>',
    ),
    "FAZ": Site(
        "https://www.faz.net/aktuell/{rubric}/a-{id}.html", "faz", ("politik", "wirtschaft", "sport"),
        '<html><body><h2><span class="atc-HeadlineEmphasis">Kicker</span><span class="atc-HeadlineText">Nr. {id}</span>'
        '<span class="atc-HeadlineText atc-Other">not this</span></h2><p class="teaser">nor this</p><div>{body}</div>{wall}</body></html>',
        '<p class="First atc-TextParagraph">{line}<a href="#"> mehr</a></p>', "[x, ' mehr']",
        '<div class="atc-ContainerPaywall Paywall">F+</div>',
    ),
    "Sueddeutsche": Site(
        "https://www.sueddeutsche.de/{rubric}/a-1.{id}", "sueddeutsche", ("politik", "wirtschaft", "panorama"),
        '<html><body><h2><span class="css-1bhnxuf">Kicker</span><span class="css-dtx5jp">Nr. {id}</span></h2>'
        '<div class="sz-article__body css-1"><p>no class, not read</p>{body}</div><p class="css-13wylk3">outside</p></body></html>',
        '<p class=" css-13wylk3">{line}</p>', "[x]", "", "reduced=true",
    ),
    "Bild": Site(
        "https://www.bild.de/{rubric}/a-{id}.bild.html", "bild", None,
        '<html><body><h2 id="cover"><span class="kicker">Kicker</span><span class="headline">Nr. {id}</span></h2>'
        '<div class="txt clearfix"><p>not this</p></div><div class="txt">loose words{body}</div></body></html>',
        "<p>{line}<br><b>!</b></p>", "[x, '!']",
    ),
    "Elpais": Site(
        "https://elpais.com/{rubric}/2020/a_{id}.html", "elpais", ("politica", "economia", "cultura"),
        '<html><body><h1 class="articulo-titulo" id="articulo-titulo">Nr. {id}</h1><h1>not this</h1>'
        '<p>nor this</p><div class="articulo-cuerpo" id="cuerpo_noticia"><div>{body}</div></div></body></html>',
        "<p>{line}</p>", "[x]",
    ),
    "Elmundo": Site(
        "https://www.elmundo.es/{rubric}/2020/{id}.html", "elmundo", ("politica", "economia", "deportes"),
        '<html><body><h1 class="ue-c-article__headline js-headline">Nr. {id}</h1><p>not this</p>'
        '<div class="ue-l-article__body ue-c-article__body">{body}<span>nor this</span></div>{wall}</body></html>',
        "<p>{line}</p>", "[x]", '<div class="ue-c-article__premium">Premium</div>',
    ),
    "Lefigaro": Site(
        "https://www.lefigaro.fr/{rubric}/a-{id}", "lefigaro", ("politique", "economie", "culture"),
        '<html><body><h1 class="css-10e1j4u eziudsn0">Nr. {id}</h1><p class="other">not this</p><article>{body}</article>{wall}</body></html>',
        '<p class="css-1 ekabp3u0">{line}</p>', "[x]", '<div class="essq5k66">Abonnés</div>',
    ),
    "Lemonde": Site(
        "https://www.lemonde.fr/{rubric}/article/a_{id}.html", "lemonde", ("politique", "economie", "sport"),
        '<html><body><h1 class="article__title">Nr. {id}</h1><p class="article__desc">not this</p><section>{body}</section>{wall}</body></html>',
        '<p class="article__paragraph">{line}</p>', "[x]",
        '<section id="js-paywall-content" class="paywall"><p>Réservé</p></section>',
    ),
}

# A page of live news: every part of the live article counts, loose words as well.
LIVE = (
    '<html><body><h1 class="eziudsn0">Nr. {id}</h1><h1 class="css-1ivsdme">Direct</h1><p class="ekabp3u0">not this</p>'
    '<div class="live-article"><h2>Direct</h2>{body}</div></body></html>'
)

# Front pages: links that are kept (first) and links that are not.
FRONT = {
    "Spiegel": '<a class="text-black block" href="https://www.spiegel.de/politik/a-{id}">x</a><a class="text-black block" href="/politik/a-{id}">x</a>'
    '<a class="text-black block more" href="https://www.spiegel.de/x-{id}">x</a>',
    "FAZ": '<a class="js-hlp-LinkSwap js-tsr-Base_ContentLink tsr-Base_ContentLink" href="https://www.faz.net/politik/a-{id}">x</a>'
    '<a class="tsr-Base_ContentLink" href="https://www.faz.net/b-{id}">x</a>',
    "Sueddeutsche": '<a class="sz-teaser css-2" href="https://www.sueddeutsche.de/politik/a-{id}"><h3>x</h3></a><a class="sz-teaser" href="/b-{id}">x</a>',
    "Bild": '<a href="/politik/a-{id}.bild.html">x</a><a href="https://other.example/b-{id}.html">x</a><a href="/c-{id}">x</a>',
    "Elpais": '<article class="articulo normal"><h2><a href="https://elpais.com/politica/a-{id}">x</a></h2><a href="https://other.example/b-{id}">x</a></article>'
    '<a href="https://elpais.com/c-{id}">x</a>',
    "Elmundo": '<a class="ue-c-cover-content__link" href="https://www.elmundo.es/politica/a-{id}">x</a><a class="ue-c-cover-content__link" href="https://other.example/b-{id}">x</a>',
    "Lefigaro": '<a class="css-m47150 esdb6og4" href="/politique/a-{id}">x</a><a class="css-m47150 esdb6og4" href="https://other.example/b-{id}">x</a>'
    '<a class="esdb6og4" href="/c-{id}">x</a>',
    "Lemonde": '<div class="article article--main"><p><a href="https://www.lemonde.fr/politique/a-{id}">x</a></p></div><a href="https://www.lemonde.fr/b-{id}">x</a>',
}
KEPT = {
    "Spiegel": "https://www.spiegel.de/politik/a-{id}", "FAZ": "https://www.faz.net/politik/a-{id}",
    "Sueddeutsche": "https://www.sueddeutsche.de/politik/a-{id}", "Bild": "https://www.bild.de/politik/a-{id}.bild.html",
    "Elpais": "https://elpais.com/politica/a-{id}", "Elmundo": "https://www.elmundo.es/politica/a-{id}",
    "Lefigaro": "https://www.lefigaro.fr/politique/a-{id}", "Lemonde": "https://www.lemonde.fr/politique/a-{id}",
}
