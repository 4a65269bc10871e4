"""Inputs of the queries, derived from the given tables: each as a DataFrame and as SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import wordloom as wl
from wordloom.functions import text as tx
from wordloom.operators.docs import DEFAULT_REPLACEMENTS

from .pages import FRONT, LIVE, SITES

TOKEN = tx.TOKEN

# Word types of these tables: no model runs here, so words are PROPN (capitalised) or WORD.
TYPES = ("PROPN", "WORD")
LIMITS = {"PROPN": 5, "WORD": 20}

BLACKLIST = ["The", "the", "and", "This", "Der", "der", "von", "La", "Le", "les", "Los", "que"]
LEXICON = [
    ("EN", "Th", "M", "Starts with Th"),
    ("EN", "Er", "M", "Starts with Er"),
    ("EN", "tion", "C", "Has tion"),
    ("EN", "ing$", "C", "Has ending"),
    ("EN", "The", "FM", "Article"),
    ("EN", "An[dt]", "M", "Starts with Th"),
    ("DE", "Sch", "M", "Starts with Sch"),
    ("DE", "Der", "FM", "Article"),
    ("FR", "eau", "C", "Has eau"),
    ("FR", "Le", "FM", "Article"),
]
REMOVE = [r"[0-9]", r"^[Qq]u", r"shly$", r"tion$"]
REPLACE = {"-": " ", r"(th)(\w)": r"\2\1"}
_LETTERS = "abcdefghijklmnopqrstuvwxyzéèüöçß"
# Long lists: every letter doubled, and pairs of letters swapped one after the other.
REMOVE_MANY = [letter * 3 for letter in _LETTERS]
REPLACE_MANY = {f"({a})({b})": r"\2\1" for a, b in zip(_LETTERS, _LETTERS[4:] + _LETTERS[:4])}
MERGE = {"The": ["This", "That"], "And": ["Anand"]}
MEDIA = {"src1": "FR", "src2": "FR", "src3": "ES", "src4": "ES"}
SOURCE_LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "dutch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"),
        F.upper("lang").alias("language"),
        F.col("source").alias("media"),
        "text",
    )


RAW_DOCS = """
raw_docs AS (
  SELECT doc_id AS text_id, upper(lang) AS language, source AS media, text FROM documents
)"""


def repaired(text: str) -> str:
    """SQL of the default repairs."""
    out = text
    for pattern, repl in DEFAULT_REPLACEMENTS.items():
        out = f"regexp_replace({out}, '{pattern}', '{repl}', 'g')"
    return out


DOCS = (
    RAW_DOCS
    + f""",
docs AS (SELECT text_id, language, {repaired('text')} AS text FROM raw_docs)"""
)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.prepare_docs(raw_docs(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.documents_to_words(raw_docs(spark, sf_dir), extract={"types": TYPES})


TYPE_RULE = r"CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'PROPN' ELSE 'WORD' END"

WORDS = (
    DOCS
    + f""",
tokens AS (
  SELECT text_id, language, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM docs
),
words AS (
  SELECT text_id, language, {TYPE_RULE} AS type, substring(word, 1, 80) AS word,
         count(*)::BIGINT AS count
  FROM tokens WHERE length(word) >= 3 GROUP BY 1, 2, 3, 4
)"""
)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))").alias("date"),
        F.col("source").alias("media"),
    )


METADATA = """
metadata AS (
  SELECT doc_id AS text_id, date '2024-01-01' + (doc_id % 30)::INTEGER AS date, source AS media
  FROM documents
)"""

DAILY = (
    WORDS
    + ","
    + METADATA
    + """,
daily AS (
  SELECT date, language, type, word, sum(count)::BIGINT AS count
  FROM words JOIN metadata USING (text_id) GROUP BY 1, 2, 3, 4
)"""
)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LEXICON, "language string, word string, mapping string, category string"
    )


def sql_rows(rows: list[tuple], names: str) -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS t({names})"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def talk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the conversations: raw material of lists and lexicons."""
    talk = table(spark, sf_dir, "conversations")
    return talk.select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()


TALK_WORDS = f"""
talk_words AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM conversations
)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk_words(spark, sf_dir).select(
        F.explode(F.array(*[F.lit(x) for x in ("DE", "EN", "ES", "FR")])).alias("language"),
        F.col("word").alias("surface"),
        F.lower("word").alias("lemma"),
        F.expr("element_at(array('NOUN','VERB','ADJ','PROPN'), 1 + length(word) % 4)").alias("pos"),
    )


ANNOTATIONS = (
    TALK_WORDS
    + """,
annotations AS (
  SELECT unnest(['DE', 'EN', 'ES', 'FR']) AS language, word AS surface, lower(word) AS lemma,
         (['NOUN','VERB','ADJ','PROPN'])[1 + length(word) % 4] AS pos
  FROM talk_words
)"""
)


def _run(n: int, at):
    return F.array_join(F.slice("w", at, F.lit(n)), " ")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to five words of the conversations as phrases, the first one capitalised."""
    talk = table(spark, sf_dir, "conversations").select(tx.tokens(F.col("text")).alias("w"))
    runs = [
        F.when(
            F.size("w") >= n,
            F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), partial(_run, n)),
        ).otherwise(F.array().cast("array<string>"))
        for n in range(2, 6)
    ]
    phrases = talk.select(F.explode(F.concat(*runs)).alias("phrase")).distinct()
    return phrases.where(F.col("phrase").rlike(tx.CAPITALISED)).select(
        F.explode(F.array(*[F.lit(x) for x in ("DE", "EN", "ES", "FR")])).alias("language"),
        "phrase",
        F.expr("element_at(array('ORG','PER','LOC'), 1 + length(phrase) % 3)").alias("label"),
    )


LONG_RUNS = (2, 3, 5, 8, 12)


def passage_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to twelve words of the benchmark's passages, which documents hold as a whole."""
    passages = table(spark, sf_dir, "benchmark").select(tx.tokens(F.col("text")).alias("w"))
    runs = [
        F.when(
            F.size("w") >= n,
            F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), partial(_run, n)),
        ).otherwise(F.array().cast("array<string>"))
        for n in LONG_RUNS
    ]
    phrases = passages.select(F.explode(F.concat(*runs)).alias("phrase")).distinct()
    return phrases.select(
        F.explode(F.array(*[F.lit(x) for x in ("DE", "EN", "ES", "FR")])).alias("language"),
        "phrase",
        F.expr("element_at(array('ORG','PER','LOC'), 1 + length(phrase) % 3)").alias("label"),
    )


def pattern_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations as patterns: their ends with anything between, their start with a gap."""
    long = talk_words(spark, sf_dir).where(F.length("word") >= 6)
    ends = F.concat(F.substring("word", 1, 3), F.lit(".*"), F.substring("word", -3, 3), F.lit("$"))
    gap = F.concat(F.substring("word", 1, 3), F.lit("."), F.substring("word", 5, 2))
    return long.select(
        F.lit("EN").alias("language"),
        F.when(F.length("word") % 2 == 0, ends).otherwise(gap).alias("word"),
        F.when(F.length("word") % 2 == 0, F.lit("C")).otherwise(F.lit("M")).alias("mapping"),
        F.lower(F.substring("word", 1, 2)).alias("category"),
    ).unionByName(
        spark.createDataFrame([("EN", "[xyz][aeiou]", "C", "no letter is certain")], "language string, word string, mapping string, category string")
    )


def runs_sql(n: int) -> str:
    """SQL list of all runs of n words of the list w."""
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


ALL_RUNS = "list_concat(" + ", ".join(runs_sql(n) for n in range(2, 6)) + ")"

GAZETTEER = f"""
talk AS (
  SELECT regexp_extract_all(text, '{TOKEN}') AS w FROM conversations
),
gazetteer AS (
  SELECT unnest(['DE', 'EN', 'ES', 'FR']) AS language, phrase,
         (['ORG','PER','LOC'])[1 + length(phrase) % 3] AS label
  FROM (SELECT DISTINCT unnest({ALL_RUNS}) AS phrase FROM talk)
  WHERE regexp_matches(phrase, '^\\p{{Lu}}')
)"""


PASSAGE_GAZETTEER = f"""
passages AS (
  SELECT regexp_extract_all(text, '{TOKEN}') AS w FROM benchmark
),
gazetteer AS (
  SELECT unnest(['DE', 'EN', 'ES', 'FR']) AS language, phrase,
         (['ORG','PER','LOC'])[1 + length(phrase) % 3] AS label
  FROM (SELECT DISTINCT unnest(list_concat({", ".join(runs_sql(n) for n in LONG_RUNS)})) AS phrase FROM passages)
)"""


def source_topics(words_df: DataFrame, metadata_df: DataFrame) -> DataFrame:
    """One topic per medium: its ten most frequent capitalised words, in wide form."""
    from pyspark.sql import Window

    totals = (
        words_df.where(F.col("type") == "PROPN")
        .join(metadata_df.select("text_id", "media"), "text_id")
        .groupBy("media", "word")
        .agg(F.sum("count").alias("n"))
    )
    place = Window.partitionBy("media").orderBy(F.col("n").desc(), "word")
    best = totals.withColumn("i", F.row_number().over(place)).where("i <= 10")
    wide = best.groupBy("media").pivot("i", list(range(1, 11))).agg(F.first("word"))
    return wide.select(
        F.concat(F.lit("topic-"), "media").alias("topic"),
        *[F.coalesce(F.col(str(i)), F.lit("")).alias(f"keyword_{i}") for i in range(1, 11)],
    )


TOPICS = (
    WORDS
    + ","
    + METADATA
    + """,
topic_words AS (
  SELECT 'topic-' || media AS topic, word FROM (
    SELECT media, word,
           row_number() OVER (PARTITION BY media ORDER BY sum(count) DESC, word) AS i
    FROM words JOIN metadata USING (text_id) WHERE type = 'PROPN' GROUP BY media, word
  ) WHERE i <= 10
),
hits AS (
  SELECT text_id, language, type, word, count, topic FROM words JOIN topic_words USING (word)
)"""
)


def article_lines(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """Documents as crawled JSON lines: Spanish ones without title, those of src7 cut off."""
    d = table(spark, sf_dir, "documents")
    record = F.struct(
        F.col("source").alias("website"),
        F.lit("2024-01-15").alias("date"),
        F.col("doc_id").alias("index"),
        F.concat(F.lit("https://www.example.org/"), "source", F.lit("/"), "doc_id").alias("url"),
        F.lit("homepage").alias("rubrics"),
        (F.col("lang") == "fr").alias("paywall"),
        F.when(F.col("lang") != "es", F.concat(F.lit("Nr. "), "doc_id")).alias("title"),
        F.col("text"),
    )
    line = F.to_json(record)
    whole = F.col("source") != "src7"
    return d.select(
        F.when(whole, line).otherwise(F.substring(line, F.lit(1), F.length(line) - 1)).alias(
            "value"
        ),
        *keep,
    )


GOOD_ARTICLES = """
good AS (
  SELECT doc_id, lang, source, replace(text, chr(10), ' ') AS text FROM documents
  WHERE lang <> 'es' AND source <> 'src7'
),
articles AS (
  SELECT doc_id, lang, source, text FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM good
  ) WHERE i = 1
)"""

ARTICLE_COLUMNS = """
SELECT 'Spiegel' AS media, date '2024-01-15' AS date, 'Nr. ' || doc_id AS title,
       'homepage' AS rubric, 'https://www.example.org/' || source || '/' || doc_id AS url,
       lang = 'fr' AS paywall, length(text)::BIGINT AS num_characters, text
FROM articles"""


MEDIA_NAMES = tuple(wl.MEDIA_RULES)


def _around(path) -> tuple[str, str]:
    """Markup that opens and closes the elements of a path."""
    opened, closed = "", ""
    for step in path:
        tag = step.tag or "div"
        opened += f"<{tag}" + (f' {step.attribute}="{step.value}"' if step.test else "") + ">"
        closed = f"</{tag}>" + closed
    return opened, closed


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of all media in turn, each in the markup its rule reads; every third one
    behind a paywall. One in nine belongs to a medium without a rule."""
    d = table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.filter(F.split(escaped, "\n"), lambda line: line != "")
    closed = F.col("doc_id") % 3 == 0
    html, url = F.lit(""), F.concat(F.lit("https://www.example.org/"), F.col("doc_id"))
    for n, name in enumerate(MEDIA_NAMES):
        rule = wl.MEDIA_RULES[name]
        (t0, t1), (p0, p1) = _around(rule.title), _around(rule.text)
        page = F.concat(
            F.lit(f"<html><body>{t0}Nr. "), F.col("doc_id"), F.lit(t1),
            F.array_join(F.transform(lines, partial(_wrapped, p0, p1)), ""),
        )
        if rule.paywall:
            mark = "x".join(_around(rule.paywall))
            page = F.when(closed, F.concat(page, F.lit(mark))).otherwise(page)
        html = F.when(F.col("doc_id") % 9 == n, F.concat(page, F.lit("</body></html>"))).otherwise(html)
        if rule.paywall_query:
            here = (F.col("doc_id") % 9 == n) & closed
            url = F.when(here, F.concat(url, F.lit(f"?{rule.paywall_query}"))).otherwise(url)
    media = F.get(F.array(*[F.lit(n) for n in MEDIA_NAMES], F.lit("Other")), (F.col("doc_id") % 9).cast("int"))
    return d.select(media.alias("media"), url.alias("url"), html.alias("html"))


def _wrapped(before: str, after: str, line):
    return F.concat(F.lit(before), line, F.lit(after))


SITE_NAMES = tuple(SITES)


def _put(template: str, **values) -> Column:
    """A template with its marks replaced, in the order given."""
    out = F.lit(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit("{" + mark + "}"), value if isinstance(value, Column) else F.lit(value))
    return out


def _site(n: int) -> Column:
    return F.col("doc_id") % len(SITES) == n


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of the eight media in turn: each rubric, with and without a paywall, some of live news."""
    d = table(spark, sf_dir, "documents")
    turn = F.floor(F.col("doc_id") / len(SITES))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.filter(F.split(escaped, "\n"), lambda line: line != "")
    number = F.col("doc_id").cast("string")
    html = url = F.lit(None).cast("string")
    for n, (name, site) in enumerate(SITES.items()):
        body = F.array_join(F.transform(lines, partial(_line_of, site.line)), "")
        wall = F.when(turn % 2 == 0, F.lit(site.wall)).otherwise(F.lit(""))
        page = _put(site.page, id=number, wall=wall, body=body)
        if name == "Lefigaro":
            page = F.when(turn % 5 == 0, _put(LIVE, id=number, body=body)).otherwise(page)
        rubric = F.get(F.array(*[F.lit(r) for r in site.rubrics or ("sport",) * 3]), (turn % 3).cast("int"))
        at = _put(site.url, id=number, rubric=rubric)
        if site.wall_in_url:
            at = F.when(turn % 2 == 0, F.concat(at, F.lit("?" + site.wall_in_url))).otherwise(at)
        html, url = F.when(_site(n), page).otherwise(html), F.when(_site(n), at).otherwise(url)
    media = F.get(F.array(*[F.lit(n) for n in SITE_NAMES]), (F.col("doc_id") % len(SITES)).cast("int"))
    return d.select(media.alias("media"), url.alias("url"), html.alias("html"))


def _line_of(template: str, line: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{line}"), line)


def front_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One front page per document, of the eight media in turn."""
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    html = F.lit(None).cast("string")
    for n, name in enumerate(SITE_NAMES):
        html = F.when(_site(n), _put(f"<html><body><main>{FRONT[name]}</main></body></html>", id=number)).otherwise(html)
    media = F.get(F.array(*[F.lit(n) for n in SITE_NAMES]), (F.col("doc_id") % len(SITES)).cast("int"))
    return d.select(media.alias("media"), F.concat(F.lit("https://front.example/"), number).alias("url"), html.alias("html"))
