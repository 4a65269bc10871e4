"""URL filters: rules for hosts and paths, and boosted trees for the URLs no rule covers.

The URLs that a rule decides are the labelled ones. Their host and path suffixes are counted, over all of them,
in a table of a fixed number of hash buckets. Gradient-boosted trees learn from lexical features of a
bounded sample of them: lengths, depth, digit ratio, entropy, parameter counts and the suffix counts. A row's own
label never enters its features: labelled URLs are dealt to two halves by hash, and each half is
described by the counts of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.workdir import settle

ALLOW, BLOCK = "allow", "block"

# Verdict and rule: a host, which stands for its subdomains as well, and the start of a path.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)

BUCKETS = 1 << 16
SAMPLE = 20_000
TREES, DEPTH = 20, 4

# What is counted of a URL: the last label of its host, the last two, the first part of its path, its extension.
SUFFIXES = ("top", "domain", "section", "extension")
LEXICAL = (
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy",
    "parameters", "fragment", "secure",
)
FEATURES = (*LEXICAL, *[f"{s}_{kind}" for s in SUFFIXES for kind in ("blocked", "seen")])

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return _part(url, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL without one. ``rules``: a short list."""
    kind = "struct<rule: string, verdict: string>"
    found = F.lit(None).cast(kind)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        on, start = rule.split("/", 1)
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]"))


def entropy(text: Column) -> Column:
    """Bits per character by the text's own characters; 0 for an empty one."""
    length = F.char_length(text)

    def add(total: Column, letter: Column) -> Column:
        share = (length - F.char_length(F.replace(text, letter, F.lit("")))) / length
        return total - share * F.log2(share)

    letters = F.array_distinct(F.split(text, ""))
    return F.when(length > 0, F.aggregate(letters, F.lit(0.0), add)).otherwise(F.lit(0.0))


def described(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the LEXICAL features and the bucket of each suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    labels = F.split(host, r"\.")
    last = F.element_at(F.split(path, "/"), -1)
    extension = F.when(last.contains("."), F.element_at(F.split(last, r"\."), -1)).otherwise(F.lit(""))
    domain = F.array_join(F.reverse(F.slice(F.reverse(labels), 1, 2)), ".")
    tokens = (F.element_at(labels, -1), domain, F.coalesce(F.get(parts, F.lit(0)), F.lit("")), extension)
    query = F.filter(F.split(_part(url, 3), "&"), lambda p: p != "")
    numbers = {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "labels": F.when(host == "", F.lit(0)).otherwise(F.size(labels)), "depth": F.size(parts),
        "digit_ratio": _digits(url) / F.greatest(F.char_length(url), F.lit(1)), "host_digits": _digits(host),
        "hyphens": F.regexp_count(host, F.lit("-")), "entropy": entropy(url), "parameters": F.size(query),
        "fragment": url.contains("#").cast("int"), "secure": F.startswith(url, F.lit("https:")).cast("int"),
    }
    buckets = {
        name: F.pmod(F.xxhash64(F.lit(name), token), F.lit(BUCKETS)).cast("int")
        for name, token in zip(SUFFIXES, tokens, strict=True)
    }
    return urls.withColumns({n: c.cast("double") for n, c in numbers.items()} | buckets)


def _half(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(21)), F.lit(2)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """bucket, seen_0, blocked_0, seen_1, blocked_1 of all labelled URLs: at most BUCKETS rows."""
    each = labelled.select("half", "blocked", F.explode(F.array(*SUFFIXES)).alias("bucket"))
    sums = [
        F.sum(F.when(F.col("half") == half, value).otherwise(0)).cast("double").alias(f"{name}_{half}")
        for half in (0, 1)
        for name, value in (("seen", F.lit(1)), ("blocked", F.col("blocked")))
    ]
    return each.groupBy("bucket").agg(*sums)


def with_suffixes(urls: DataFrame, counts: DataFrame, half: Column | None = None) -> DataFrame:
    """Share of blocked URLs and number of URLs with the same suffixes: of the other half, or the mean of both."""
    zero = F.lit(0.0)
    for name in SUFFIXES:
        # At most BUCKETS rows of five numbers, whatever the corpus.
        own = counts.select(F.col("bucket").alias(name), *[F.col(c).alias(f"c_{c}") for c in counts.columns[1:]])
        urls = urls.join(F.broadcast(own), name, "left")

        def taken(kind: str) -> Column:
            zeroth, first = F.coalesce(f"c_{kind}_0", zero), F.coalesce(f"c_{kind}_1", zero)
            mean = (zeroth + first) / 2
            return mean if half is None else F.when(half == 0, first).otherwise(zeroth)

        seen, blocked = taken("seen"), taken("blocked")
        urls = urls.withColumns({f"{name}_blocked": (blocked + 1) / (seen + 2), f"{name}_seen": F.log1p(seen)})
        urls = urls.drop(*own.columns[1:])
    return urls


class UrlFilter:
    """Suffix counts and trees; without labels of both kinds ``only`` is the verdict of all URLs."""

    def __init__(self, counts: DataFrame | None, trees: GBTClassificationModel | None, only: str | None = None):
        self.counts, self.trees, self.only = counts, trees, only

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path) with ``blocked``: the probability that the URL is to be blocked."""
        if self.only is not None:
            return urls.withColumn("blocked", F.lit(float(self.only == BLOCK)))
        rows = with_suffixes(described(urls), self.counts)
        rows = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        return rows.select(*urls.columns, F.element_at(vector_to_array("probability"), 2).alias("blocked"))


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> UrlFilter:
    """Learn from ``labelled`` (url, verdict): suffixes of all rows, trees from ``sample`` of them by a hash.

    Equal URLs count once, allowed if any of them is; a NULL URL or verdict is left out.
    """
    known = labelled.where("url is not null and verdict is not null")
    known = known.groupBy("url").agg(F.min((F.col("verdict") == BLOCK).cast("int")).alias("blocked"))
    known = known.withColumns({"half": _half(F.col("url")), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = settle(described(known), "url-features")
    counts = settle(suffix_counts(rows), "url-suffixes")
    order = [F.xxhash64("url", F.lit(22)), F.col("url")]
    chosen = rows.orderBy(*order).limit(sample)
    chosen = with_suffixes(chosen, counts, F.col("half")).orderBy(*order)
    chosen = settle(chosen.select(*FEATURES, F.col("blocked").cast("double").alias("label")).coalesce(1), "url-sample")
    kinds = {row["label"] for row in chosen.select("label").distinct().collect()}
    if len(kinds) < 2:
        return UrlFilter(None, None, BLOCK if kinds == {1.0} else ALLOW)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=seed)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen)
    return UrlFilter(counts, trees.fit(data.select("features", "label")))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, blocked.

    ``rule``: the longest that fits the host or a parent of it and starts the path, else NULL; it decides.
    ``blocked``: the trees' probability, which decides where no rule does (block from 0.5 on). A NULL
    URL and one without ``://`` have an empty host and path, which no rule fits; repeated rows are judged each;
    without labelled URLs all are allowed; other columns are ignored; an empty table gives an empty one.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    model = train(urls.select("url", "found.verdict"), sample)
    scored = model.scored(urls)
    learned = F.when(F.col("blocked") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", learned).alias("verdict"), "blocked",
    )
