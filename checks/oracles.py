"""SQL for the registered queries, on views named like the tables."""

from __future__ import annotations

from .inputs import (
    ALL_RUNS,
    ANNOTATIONS,
    ARTICLE_COLUMNS,
    BLACKLIST,
    DAILY,
    DOCS,
    GAZETTEER,
    GOOD_ARTICLES,
    LEXICON,
    LIMITS,
    LONG_RUNS,
    MEDIA,
    MEDIA_NAMES,
    MERGE,
    PASSAGE_GAZETTEER,
    RAW_DOCS,
    REMOVE,
    REMOVE_MANY,
    REPLACE_MANY,
    SOURCE_LANGUAGES,
    TALK_WORDS,
    TOKEN,
    TOPICS,
    TYPE_RULE,
    WORDS,
    repaired,
    runs_sql,
    sql_list,
    sql_rows,
)

from .pages import KEPT, SITES

W = r"\p{L}\p{N}_"  # word characters
SPACE = r"\s\p{Z}\x0b\x85"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


_REMOVED = "CASE " + " ".join(
    f"WHEN regexp_matches(word, '{p}') THEN '{p}'"
    for p in [p.replace("'", "''") for p in reversed(REMOVE)]
) + " END"
_STEP1 = "replace(word, '-', ' ')"
_STEP2 = rf"regexp_replace({_STEP1}, '(th)([{W}])', '\2\1', 'g')"
_CLEANED = f""",
cleaned AS (
  SELECT text_id, language, type, count, word AS word_orig,
         CASE WHEN masked THEN {_REMOVED} END AS word_r,
         CASE WHEN masked THEN CASE WHEN regexp_matches({_STEP1}, '(th)([{W}])') THEN '(th)(\\w)'
              WHEN contains(word, '-') THEN '-' END END AS word_m,
         CASE WHEN masked THEN {_STEP2} ELSE word END AS word
  FROM (SELECT *, MASK AS masked FROM SOURCE)
)"""


def _cleaned(source: str, mask: str) -> str:
    return _CLEANED.replace("MASK", mask).replace("SOURCE", source)


def _rule(word: str, alias: str) -> str:
    return (
        f"(({alias}.mapping = 'FM' AND {word} = {alias}.word) OR "
        f"({alias}.mapping = 'M' AND regexp_matches({word}, '^(?:' || {alias}.word || ')')) OR "
        f"({alias}.mapping = 'C' AND regexp_matches({word}, {alias}.word)))"
    )


_LEX = sql_rows(LEXICON, "language, word, mapping, category")


def _mapped(source: str, added: str) -> str:
    return f"""
SELECT text_id, language, type, word, sum(count)::BIGINT AS count FROM (
  SELECT text_id, language, type, word, count FROM {source}
  UNION ALL {added}
) GROUP BY 1, 2, 3, 4"""


def _period(p: int) -> str:
    inside = f"FILTER (WHERE past_days > -{p})"
    flat = f"coalesce(regr_sxx(count, past_days) {inside}, 0) = 0"
    return f"""
  round(CASE WHEN {flat} THEN 0.0 ELSE regr_slope(count, past_days) {inside} END, 6) + 0.0
    AS trend_{p},
  round(CASE WHEN {flat} THEN avg(count) {inside}
             ELSE regr_intercept(count, past_days) {inside} END, 6) + 0.0 AS trend_{p}_ic"""


def _trend(where: str, word: str, periods, min_count: int, keep: str, partition: str = "") -> str:
    columns = ", ".join(f"l.trend_{p}, l.trend_{p}_ic" for p in periods)
    return _with(
        DAILY
        + f""",
series AS (
  SELECT date, language, {word} AS word, sum(count)::BIGINT AS count,
         date_diff('day', (SELECT max(date) FROM daily WHERE {where}), date) AS past_days
  FROM daily WHERE {where} GROUP BY 1, 2, 3, 5
),
lines AS (
  SELECT language, word, max(date) FILTER (WHERE past_days = 0) AS date,
         sum(count) FILTER (WHERE past_days = 0)::BIGINT AS count,
         {", ".join(_period(p) for p in periods)}
  FROM series GROUP BY 1, 2
),
ranked AS (
  SELECT *, rank() OVER ({partition} ORDER BY count DESC)::INTEGER AS rank,
         count(*) OVER ({partition}) AS n,
         row_number() OVER (ORDER BY count DESC, language, word) AS place
  FROM lines WHERE count >= {min_count}
)""",
        f"SELECT l.date, l.language, l.word, l.count, l.rank, {columns} FROM ranked l WHERE {keep}",
    )


_MERGED = "CASE " + " ".join(
    f"WHEN word IN ({sql_list(v)}) THEN '{k}'" for k, v in MERGE.items()
) + " ELSE word END"

_GLUED = repaired(r"regexp_replace(text, '([.,]) ', '\1', 'g')")

_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_P_PART = f"regexp_replace({_ARTICLE}, '(?s)^<h1>.*?</h1>', '')"


def _decoded(x: str) -> str:
    """HTML reads these references without their semicolon too (a title may be cut there)."""
    for name, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("amp", "'&'")):
        x = f"regexp_replace({x}, '&{name};?', {char}, 'g')"
    return x


_TEXT_PARTS = (
    f"list_transform(list_filter(string_split_regex({_P_PART}, '<[^>]*>'), lambda x: x <> ''), "
    f"lambda x: {_decoded('x')})"
)
_TITLE = _decoded(f"regexp_extract({_ARTICLE}, '(?s)<h1>(.*?)</h1>', 1)")
_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_SITE = (
    f"CASE WHEN contains(split_part({_HOST}, '.', 1), 'www') THEN split_part({_HOST}, '.', 2) "
    f"ELSE split_part({_HOST}, '.', 1) END"
)


def _rubric(url: str) -> str:
    return (
        f"CASE WHEN list_contains(string_split({url}, '/'), 'the') THEN 'politics' "
        f"WHEN list_contains(string_split({url}, '/'), 'and') THEN 'economics' "
        "ELSE 'homepage' END"
    )


_TAGGED = f""",
surfaces AS (
  SELECT text_id, language, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM docs
),
tagged AS (
  SELECT s.text_id, s.language, coalesce(a.lemma, s.word) AS word,
         coalesce(a.pos, {TYPE_RULE.replace('word', 's.word')}) AS type
  FROM surfaces s LEFT JOIN annotations a ON a.language = s.language AND a.surface = s.word
)"""

_COUNTED = """
SELECT text_id, language, type, substring(word, 1, 80) AS word, count(*)::BIGINT AS count
FROM {source} WHERE type IN ({types}) AND length(word) >= 3 GROUP BY 1, 2, 3, 4"""

_EVENT_LIST = """
events_list AS (
  SELECT word, value FROM (
    SELECT event_type || '-' || user_id AS word,
           round_even((value / 4.5 - 1.0) * 100, 0) / 100 AS value,
           row_number() OVER (PARTITION BY event_type || '-' || user_id ORDER BY event_id) AS i
    FROM events
  ) WHERE i = 1
)"""

_ALL_TYPES = "'PROPN', 'WORD'"
_CLEAN_MASK = "language IN ('EN', 'FR')"

_TALK_LEXICON = (
    TALK_WORDS
    + """,
lexicon AS (
  SELECT word, (['FM','M','C'])[1 + length(word) % 3] AS mapping, word[1:1] AS category
  FROM talk_words
),
vocabulary AS (SELECT DISTINCT word FROM words WHERE type = 'PROPN'),
matched AS (
  SELECT v.word, l.category FROM vocabulary v JOIN lexicon l ON
    (l.mapping = 'FM' AND v.word = l.word) OR
    (l.mapping = 'M' AND starts_with(v.word, l.word)) OR
    (l.mapping = 'C' AND contains(v.word, l.word))
)"""
)

_MERGE_LEXICON = (
    TALK_WORDS
    + """,
lexicon AS (
  SELECT word, CASE WHEN length(word) < 6 THEN 'M' ELSE 'FM' END AS mapping,
         word[1:3] AS category
  FROM talk_words
),
vocabulary AS (SELECT DISTINCT language, word FROM daily WHERE language IN ('EN', 'FR')),
matched AS (
  SELECT language, word, category FROM (
    SELECT v.language, v.word, l.category, row_number() OVER (
      PARTITION BY v.language, v.word ORDER BY l.mapping, length(l.word) DESC, l.category) AS i
    FROM vocabulary v JOIN lexicon l ON (l.mapping = 'FM' AND v.word = l.word) OR
      (l.mapping = 'M' AND starts_with(v.word, l.word))
  ) WHERE i = 1
)"""
)

_SCORED = f""",
scored AS (
  SELECT DISTINCT unnest(['DE', 'EN', 'FR']) AS language, lower(word) AS word FROM talk_words
),
lowered AS (
  SELECT text_id, CASE WHEN language IN ('DE', 'FR') THEN language ELSE 'EN' END AS language,
         unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word
  FROM docs
),
found AS (
  SELECT text_id, avg((length(word) % 9 - 4) / 4.0::DOUBLE) AS p,
         avg(length(word) % 5 / 4.0::DOUBLE) AS s
  FROM lowered JOIN scored USING (language, word) GROUP BY text_id
)"""

def _many_cleaned() -> str:
    """Long lists step by step: one subquery per replacement keeps the SQL short."""
    removed = "CASE " + " ".join(
        f"WHEN contains(word, '{p}') THEN '{p}'" for p in reversed(REMOVE_MANY)
    ) + " END"
    rows = f"""SELECT text_id, language, type, count, word AS word_orig, {removed} AS word_r,
  word, NULL::VARCHAR AS word_m FROM words"""
    for pattern, repl in REPLACE_MANY.items():
        rows = f"""SELECT * REPLACE (
  regexp_replace(word, '{pattern}', '{repl}', 'g') AS word,
  CASE WHEN regexp_matches(word, '{pattern}') THEN '{pattern}' ELSE word_m END AS word_m)
FROM ({rows})"""
    return f""",
cleaned AS MATERIALIZED ({rows})"""


_COUNTED_CLEAN = """SELECT text_id, language, type, word, sum(count)::BIGINT AS count FROM cleaned
WHERE word_r IS NULL GROUP BY 1, 2, 3, 4"""
_CHANGED = """SELECT DISTINCT word_orig, word, word_r, word_m FROM cleaned
WHERE word_r IS NOT NULL OR word_m IS NOT NULL"""

_LONG_ENTITIES = _with(
    DOCS
    + ","
    + PASSAGE_GAZETTEER
    + f""",
doc_words AS (
  SELECT text_id, language, regexp_extract_all(text, '{TOKEN}') AS w FROM docs
),
runs AS (
  SELECT text_id, language, unnest(list_concat({", ".join(runs_sql(n) for n in LONG_RUNS)})) AS phrase FROM doc_words
),
found AS (
  SELECT r.text_id, r.language, r.phrase AS word, g.label AS type
  FROM runs r JOIN gazetteer g ON g.language = r.language AND g.phrase = r.phrase
)""",
    _COUNTED.format(source="found", types="'ORG', 'PER', 'LOC'"),
)

# Each pattern as what it says: the three letters it ends in join the words, so no pair is tried in vain.
_PATTERN_LEXICON = (
    TALK_WORDS
    + """,
patterns AS (
  SELECT word AS p, lower(word[1:2]) AS category FROM talk_words WHERE length(word) >= 6
),
vocabulary AS (SELECT DISTINCT word FROM words),
matched AS (
  SELECT v.word, p.category FROM vocabulary v JOIN patterns p
    ON right(v.word, 3) = right(p.p, 3) AND length(p.p) % 2 = 0
  WHERE contains(left(v.word, length(v.word) - 3), p.p[1:3])
  UNION ALL
  SELECT v.word, p.category FROM vocabulary v JOIN patterns p
    ON v.word[1:3] = p.p[1:3] AND v.word[5:6] = p.p[5:6] AND length(p.p) % 2 = 1
  UNION ALL
  SELECT word, 'no letter is certain' FROM vocabulary WHERE regexp_matches(word, '[xyz][aeiou]')
)"""
)

_DAILY_EVENTS = """
SELECT CAST(ts AS DATE) AS date, 'EN' AS language, 'EVENT' AS type, event_type AS word,
       count(*) AS count
FROM events GROUP BY 1, 2, 3, 4"""

def _site_rows() -> str:
    """What every site's page says, from the document itself."""
    rows = []
    for n, (name, site) in enumerate(SITES.items()):
        politics, economics, other = site.rubrics or ("sport",) * 3
        part = f"(['{politics}', '{economics}', '{other}'])[1 + turn % 3]"
        url = "'" + site.url.replace("{rubric}", f"' || {part} || '").replace("{id}", "' || doc_id || '") + "'"
        if site.wall_in_url:
            url += f" || CASE WHEN turn % 2 = 0 THEN '?{site.wall_in_url}' ELSE '' END"
        rubrics = "(['politics', 'economics', 'homepage'])[1 + turn % 3]" if site.rubrics else "NULL"
        paywall = "turn % 2 = 0" if site.wall or site.wall_in_url else "false"
        text = f"flatten(list_transform(lines, lambda x: {site.parts}))"
        if name == "Lefigaro":
            paywall = "turn % 2 = 0 AND turn % 5 <> 0"
            text = f"CASE WHEN turn % 5 = 0 THEN list_concat(['Direct'], lines) ELSE {text} END"
        if name == "Bild":
            paywall = "NULL"
        rows.append(
            f"SELECT '{name}' AS media, {url} AS url, '{site.website}' AS website, {rubrics} AS rubrics, "
            f"{paywall} AS paywall, 'Nr. ' || doc_id AS title, array_to_string({text}, '|') AS text "
            f"FROM d WHERE doc_id % {len(SITES)} = {n}"
        )
    return " UNION ALL ".join(rows)


_SITE_ARTICLES = f"""
WITH d AS (
  SELECT doc_id, doc_id // {len(SITES)} AS turn, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines
  FROM documents
)
SELECT *, NULL::BIGINT AS index, NULL::VARCHAR AS comments FROM ({_site_rows()})"""

_SITE_LINKS = " UNION ALL ".join(
    f"SELECT '{name}' AS media, 'https://front.example/' || doc_id AS page_url, 0::BIGINT AS index, "
    f"replace('{KEPT[name]}', '{{id}}', doc_id::VARCHAR) AS url, {'NULL' if name == 'Bild' else repr('politics')} AS rubrics "
    f"FROM documents WHERE doc_id % {len(SITES)} = {n}"
    for n, name in enumerate(SITES)
)

ORACLES = {
    "topic_ids": _with(
        WORDS,
        """SELECT '2024-01-31-' || language || '-' || n AS topic, language, 'ALGO' AS type,
       date '2024-01-31' AS date, NULL::DATE AS expiry_date
FROM (SELECT DISTINCT language FROM words WHERE type = 'PROPN'), range(4) r(n)""",
    ),
    "article_arrays": """
SELECT source AS media, date '2024-01-15' AS date, doc_id AS text_id,
       length(text)::BIGINT AS num_characters, text
FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)""",
    "article_array_rejects": """
SELECT 'malformed JSON' AS reject_reason, max(doc_id) AS text_id FROM documents""",
    "site_articles": _SITE_ARTICLES,
    "site_links": _SITE_LINKS,
    "csv_head": "SELECT doc_id AS text_id, 'w' || doc_id AS word FROM documents ORDER BY doc_id LIMIT 25",
    "words_of_missing_texts": _with(WORDS, "SELECT * FROM words WHERE text_id % 3 <> 0"),
    "stream_daily_compacted": _DAILY_EVENTS,
    "stream_ingest_many": _with(GOOD_ARTICLES, ARTICLE_COLUMNS),
    "stream_counts": _with(
        GOOD_ARTICLES,
        """SELECT 5::BIGINT AS batches, (SELECT count(*) FROM documents) AS lines,
       (SELECT count(*) FROM documents WHERE lang = 'es' OR source = 'src7') AS rejected,
       (SELECT count(*) FROM good) - (SELECT count(*) FROM articles) AS repeated,
       (SELECT count(*) FROM articles) AS articles""",
    ),
    "daily_redelivered": _with(DAILY, "SELECT * FROM daily"),
    "entity_words_long": _LONG_ENTITIES,
    "entity_words_joined": _LONG_ENTITIES,
    "map_lexicon_patterns": _with(
        WORDS + "," + _PATTERN_LEXICON,
        _mapped(
            "words",
            "SELECT w.text_id, w.language, 'LEX', m.category, w.count FROM words w JOIN matched m ON w.word = m.word",
        ),
    ),
    "clean_words_many": _with(WORDS + _many_cleaned(), _COUNTED_CLEAN),
    "clean_words_many_changes": _with(WORDS + _many_cleaned(), _CHANGED),
    "annotate_words_joined": _with(
        DOCS + "," + ANNOTATIONS + _TAGGED,
        _COUNTED.format(source="tagged", types="'PROPN', 'NOUN', 'VERB', 'ADJ'"),
    ),
    "map_lexicon_mixed": _with(
        WORDS
        + ","
        + _TALK_LEXICON.replace(
            "(['FM','M','C'])[1 + length(word) % 3]", "(['FM','M','C','X','m',NULL])[1 + length(word) % 6]"
        ),
        _mapped(
            "words",
            """SELECT w.text_id, w.language, 'LEX', m.category, w.count
  FROM words w JOIN matched m ON w.type = 'PROPN' AND w.word = m.word""",
        ),
    ),
    "document_bags": _with(
        WORDS,
        """SELECT text_id, language, array_to_string(list_sort(list(word)), ' ') AS words
FROM words WHERE type = 'PROPN' GROUP BY 1, 2""",
    ),
    "topic_shape": _with(
        WORDS,
        """SELECT language, 4::BIGINT AS topics, 40::BIGINT AS keywords, 40::BIGINT AS known_keywords
FROM words WHERE type = 'PROPN' GROUP BY 1 HAVING count(DISTINCT word) >= 10""",
    ),
    "stream_rejects": """
SELECT 'Spiegel' AS media,
       CASE WHEN source = 'src7' THEN 'malformed JSON' ELSE 'missing title' END AS reject_reason,
       count(*) AS n, true AS has_line
FROM documents WHERE lang = 'es' OR source = 'src7' GROUP BY 1, 2""",
    "csv_words": _with(WORDS, "SELECT * FROM words"),
    "tsv_words": _with(WORDS, "SELECT text_id, word, count FROM words"),
    "json_words": _with(WORDS, "SELECT * FROM words"),
    "list_words": _with(TALK_WORDS, "SELECT word FROM talk_words"),
    "lexicon_csv": _with(
        TALK_WORDS,
        """SELECT 'EN' AS language, word, (['FM','M','C'])[1 + length(word) % 3] AS mapping,
       word[1:1] AS category FROM talk_words""",
    ),
    "sentiment_csv": _with(
        TALK_WORDS,
        "SELECT lower(word) AS word, (length(word) % 10) / 4.0::DOUBLE AS value FROM talk_words",
    ),
    "topics_csv": _with(TOPICS, "SELECT topic, word AS keyword FROM topic_words"),
    "table_words": _with(WORDS, "SELECT * FROM words WHERE language IN ('EN', 'FR')"),
    "cut_words": _with(
        WORDS,
        """SELECT text_id, language, type, repeat('x', 77) || word[1:3] AS word,
       sum(count)::BIGINT AS count FROM words GROUP BY 1, 2, 3, 4""",
    ),
    "article_files": """
SELECT source AS media, date '2024-01-15' AS date, doc_id AS text_id,
       length(text)::BIGINT AS num_characters, text
FROM documents WHERE source <> 'src7'""",
    "article_file_rejects": """
SELECT DISTINCT source, 'malformed JSON' AS reject_reason FROM documents WHERE source = 'src7'""",
    "undecodable_docs": """
SELECT doc_id AS text_id, 'not UTF-8' AS reject_reason FROM documents WHERE source = 'src7'""",
    "article_ids": _with(
        GOOD_ARTICLES, "SELECT count(*) AS articles, count(*) AS ids, count(*) AS texts FROM articles"
    ),
    "prepare_docs": _with(RAW_DOCS, f"SELECT text_id, language, {_GLUED} AS text FROM raw_docs"),
    "prepare_docs_html": f"""
SELECT page_id AS text_id, 'DE' AS language,
       {repaired("regexp_replace(html, '<[^>\n]*>', '', 'g')")} AS text
FROM pages""",
    "prepare_docs_binary": _with(RAW_DOCS, "SELECT text_id, language, text FROM raw_docs"),
    "default_language": """
SELECT doc_id AS text_id, CASE WHEN lang = 'en' THEN 'PT' ELSE upper(lang) END AS language
FROM documents""",
    "media_language": "SELECT doc_id AS text_id, CASE source "
    + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in MEDIA.items())
    + " ELSE 'DE' END AS language FROM documents",
    "dedupe_docs": f"""
SELECT md5(text) AS text_id, language, {repaired('text')} AS text FROM (
  SELECT text, upper(lang) AS language,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS i
  FROM documents
) WHERE i = 1""",
    "prepared_counts": """
SELECT 2 * count(*)::BIGINT AS raw, count(DISTINCT doc_id) AS prepared FROM documents""",
    "unseen_docs": _with(
        DOCS, "SELECT * FROM docs WHERE text_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "select_docs": """
SELECT doc_id AS text_id, text FROM documents WHERE source NOT IN ('src3', 'src5')""",
    "unsupported_languages": """
SELECT upper(lang) AS language, count(*) AS docs FROM documents
WHERE upper(lang) NOT IN ('EN', 'DE') GROUP BY 1""",
    "extract_words": _with(WORDS, "SELECT * FROM words"),
    "annotate_words": _with(
        DOCS + "," + ANNOTATIONS + _TAGGED,
        _COUNTED.format(source="tagged", types="'PROPN', 'NOUN', 'VERB', 'ADJ'"),
    ),
    "entity_words": _with(
        DOCS
        + ","
        + ANNOTATIONS
        + ","
        + GAZETTEER
        + _TAGGED
        + f""",
doc_words AS (
  SELECT text_id, language, regexp_extract_all(text, '{TOKEN}') AS w FROM docs
),
runs AS (
  SELECT text_id, language, unnest({ALL_RUNS}) AS phrase FROM doc_words
),
all_rows AS (
  SELECT text_id, language, word, type FROM tagged
  UNION ALL
  SELECT r.text_id, r.language, r.phrase, g.label
  FROM runs r JOIN gazetteer g ON g.language = r.language AND g.phrase = r.phrase
)""",
        _COUNTED.format(source="all_rows", types="'PROPN', 'NOUN', 'ORG', 'PER', 'LOC'"),
    ),
    "plugged_annotator": _with(
        DOCS
        + f""",
parts AS (
  SELECT text_id, language, unnest(string_split_regex(text, '[{SPACE}]+')) AS part FROM docs
),
tagged AS (
  SELECT text_id, language, 'PROPN' AS type, regexp_replace(part, '^[.,]+|[.,]+$', '', 'g') AS word
  FROM parts WHERE regexp_matches(part, '^\\p{{Lu}}')
)""",
        _COUNTED.format(source="tagged", types="'PROPN'"),
    ),
    "plugged_scorer": _with(
        DOCS,
        """SELECT text_id,
       round_even((length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1)
                  * 100, 0) / 100 AS polarity,
       round_even((length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1)
                  * 100, 0) / 100 AS subjectivity
FROM docs""",
    ),
    "word_frequency": _with(
        WORDS,
        """SELECT language, type, word, sum(count)::BIGINT AS count FROM words GROUP BY 1, 2, 3""",
    ),
    "word_frequency_filtered": _with(
        WORDS,
        """SELECT language, type, word, sum(count)::BIGINT AS count FROM words
WHERE type = 'PROPN' AND language IN ('EN', 'FR') GROUP BY 1, 2, 3""",
    ),
    "select_word_index": _with(
        WORDS,
        f"""
SELECT w.text_id, w.language, w.type, w.word, w.count FROM words w JOIN (
  SELECT word, type, language FROM words WHERE language = 'EN' GROUP BY 1, 2, 3
  HAVING sum(count) >= CASE type {" ".join(f"WHEN '{t}' THEN {n}" for t, n in LIMITS.items())} END
) USING (word, type, language)""",
    ),
    "clean_words": _with(
        WORDS + _cleaned("words", _CLEAN_MASK),
        """SELECT text_id, language, type, word, sum(count)::BIGINT AS count FROM cleaned
WHERE word_r IS NULL GROUP BY 1, 2, 3, 4""",
    ),
    "clean_words_changes": _with(
        WORDS + _cleaned("words", _CLEAN_MASK),
        """SELECT DISTINCT word_orig, word, word_r, word_m FROM cleaned
WHERE word_r IS NOT NULL OR word_m IS NOT NULL""",
    ),
    "remove_blacklisted": _with(
        WORDS, f"SELECT * FROM words WHERE NOT (type = 'PROPN' AND word IN ({sql_list(BLACKLIST)}))"
    ),
    "map_lexicon": _with(
        WORDS,
        _mapped(
            "words",
            f"""SELECT w.text_id, w.language, 'LEX', l.category, w.count
  FROM words w JOIN {_LEX.replace(' AS t(', ' AS l(')} ON {_rule('w.word', 'l')}""",
        ),
    ),
    "map_lexicon_strict": _with(
        WORDS,
        _mapped(
            "words",
            f"""SELECT DISTINCT w.text_id, w.language, 'LEX', l.category, w.count
  FROM (SELECT *, word AS w0 FROM words) w JOIN {_LEX.replace(' AS t(', ' AS l(')}
    ON l.language = 'EN' AND w.language = 'EN' AND w.type = 'PROPN' AND {_rule('w.word', 'l')}
  GROUP BY w.text_id, w.language, w.type, w.word, l.category, w.count""".replace(
                "SELECT DISTINCT", "SELECT"
            ),
        ),
    ),
    "map_lexicon_large": _with(
        WORDS + "," + _TALK_LEXICON,
        _mapped(
            "words",
            """SELECT w.text_id, w.language, 'LEX', m.category, w.count
  FROM words w JOIN matched m ON w.type = 'PROPN' AND w.word = m.word""",
        ),
    ),
    "build_word_index": _with(
        WORDS
        + f""",
chosen AS (
  SELECT w.* FROM words w JOIN (
    SELECT word, type, language FROM words WHERE language = 'EN' GROUP BY 1, 2, 3
    HAVING sum(count) >= CASE type {" ".join(f"WHEN '{t}' THEN {n}" for t, n in LIMITS.items())} END
  ) USING (word, type, language)
)"""
        + _cleaned("chosen", "language = 'EN'")
        + f""",
kept AS (
  SELECT text_id, language, type, word, sum(count)::BIGINT AS count FROM cleaned
  WHERE word_r IS NULL AND word NOT IN ({sql_list(BLACKLIST)}) GROUP BY 1, 2, 3, 4
)""",
        _mapped(
            "kept",
            f"""SELECT w.text_id, w.language, 'LEX', l.category, w.count
  FROM kept w JOIN {_LEX.replace(' AS t(', ' AS l(')}
    ON l.language = 'EN' AND {_rule('w.word', 'l')}""",
        ),
    ),
    "duplicate_report": _with(
        WORDS,
        """SELECT count(*)::BIGINT AS num_rows,
       (count(*) - count(DISTINCT (language, type, word)))::BIGINT AS num_duplicates FROM words""",
    ),
    "duplicate_texts": """
SELECT count(*) AS num_rows, (count(*) - count(DISTINCT text))::BIGINT AS num_duplicates
FROM documents""",
    "explode_wide_lexicon": f"""
SELECT language, CASE WHEN ends_with(part, '*') THEN part[1:length(part) - 1] ELSE part END AS word,
       CASE WHEN ends_with(part, '*') THEN 'M' ELSE 'FM' END AS mapping, category
FROM (
  SELECT source || '-' || doc_id AS category,
         CASE lang WHEN 'en' THEN 'EN' WHEN 'fr' THEN 'FR' ELSE 'XX' END AS language,
         unnest(string_split_regex(
           CASE WHEN lang IN ('en', 'fr') THEN text ELSE regexp_replace(text, '[.,]', '*', 'g') END,
           '[{SPACE}]+')) AS part
  FROM documents
) WHERE part <> ''""",
    "daily_word_frequency": _with(DAILY, "SELECT * FROM daily"),
    "daily_word_frequency_filtered": _with(
        DAILY, "SELECT * FROM daily WHERE language = 'EN' AND type = 'PROPN' AND count >= 2"
    ),
    "word_trend": _trend(
        f"type = 'PROPN' AND word NOT IN ({sql_list(BLACKLIST)})",
        "word",
        (7, 17, 21, 28, 90),
        3,
        "l.rank <= trunc(0.5 * n)",
    ),
    "word_trend_top30": _trend(
        "type = 'PROPN' AND word NOT IN ('Bayer', 'This')",
        _MERGED,
        (7, 14, 21, 365),
        5,
        "l.place <= 30",
    ),
    "word_trend_by_language": _trend(
        "type = 'PROPN'", "word", (7, 28), 2, "l.rank <= trunc(0.25 * n)", "PARTITION BY language"
    ),
    "merge_words": _with(
        DAILY + "," + _MERGE_LEXICON,
        """
SELECT d.date, d.language, coalesce(m.category, d.word) AS word, sum(d.count)::BIGINT AS count
FROM daily d LEFT JOIN matched m ON m.language = d.language AND m.word = d.word
GROUP BY 1, 2, 3""",
    ),
    "wordlist_sentiment": _with(
        DOCS
        + ","
        + ANNOTATIONS
        + _TAGGED
        + """,
list AS (SELECT lower(word) AS word, (length(word) % 10) / 4.0::DOUBLE AS value FROM talk_words),
lemmas AS (
  SELECT DISTINCT text_id, lower(word) AS word FROM tagged WHERE type IN ('NOUN', 'VERB', 'ADJ')
),
means AS (SELECT text_id, avg(value) AS sentiment FROM lemmas JOIN list USING (word) GROUP BY 1)""",
        """SELECT d.text_id, round(m.sentiment, 9) AS sentiment FROM docs d
LEFT JOIN means m USING (text_id) WHERE d.language IN ('DE', 'EN')""",
    ),
    "score_sentiment": _with(
        DOCS + "," + TALK_WORDS + _SCORED,
        """SELECT d.text_id, coalesce(round_even(p * 100, 0) / 100, 0.0) AS polarity,
       coalesce(round_even(s * 100, 0) / 100, 0.0) AS subjectivity
FROM docs d LEFT JOIN found f USING (text_id)""",
    ),
    "prepare_sentiment_source": f"""
SELECT DISTINCT CASE lang WHEN 'fr' THEN 'FR' ELSE 'DE' END AS language, word,
       length(word)::DOUBLE AS value
FROM (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents
      WHERE lang IN ({sql_list(k for k, v in SOURCE_LANGUAGES.items() if v in ('german', 'french'))}))""",
    "rescale_sentiment_list": _with(_EVENT_LIST, "SELECT word, value FROM events_list"),
    "sentiment_list_range": _with(
        _EVENT_LIST,
        """SELECT count(*) AS num_words, min(value) AS min_value, max(value) AS max_value
FROM events_list""",
    ),
    "ingest_articles": _with(GOOD_ARTICLES, ARTICLE_COLUMNS),
    "ingest_rejects": """
SELECT 'Spiegel' AS media,
       CASE WHEN source = 'src7' THEN 'malformed JSON' ELSE 'missing title' END AS reject_reason,
       count(*) AS n, true AS has_line
FROM documents WHERE lang = 'es' OR source = 'src7' GROUP BY 1, 2""",
    "crawl_summary": _with(
        GOOD_ARTICLES,
        """
SELECT 'Spiegel' || digit AS media, date '2024-01-15' AS date,
       CASE digit WHEN '1' THEN 'DE' WHEN '2' THEN 'FR' ELSE 'unknown' END AS language,
       'January' AS month, count(*) AS num_articles
FROM (SELECT left(doc_id::VARCHAR, 1) AS digit FROM articles) GROUP BY digit""",
    ),
    "assemble_articles": f"""
SELECT * FROM (
  SELECT source AS website, '2024-01-15' AS date, doc_id AS index,
         'https://www.example.org/' || doc_id AS url, NULL::VARCHAR AS rubrics,
         NULL::BOOLEAN AS paywall, 'Nr. ' || doc_id AS title,
         {_strip("replace(text, chr(10), ' ')")} AS text, {_strip("replace(text, chr(10), ' ')")} AS line
  FROM documents
  WHERE regexp_matches(string_split(text, chr(10))[1], '[{W}]')
) WHERE length(text) > 50""",
    "extract_links": f"""
SELECT 'Site' AS media, page_url, index, url, {_rubric('url')} AS rubrics FROM (
  SELECT url AS page_url, (generate_subscripts(links, 1) - 1)::BIGINT AS index,
         'https://site.example' || unnest(links) AS url
  FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages)
)""",
    "extract_articles": f"""
SELECT url, {_SITE} AS website, {_rubric('url')} AS rubrics, true AS paywall,
       {_TITLE} AS title, array_to_string({_TEXT_PARTS}, '|') AS text
FROM pages""",
    "page_articles": f"""
SELECT * FROM (
  SELECT {_SITE} AS website, url, {_strip(_TITLE)} AS title,
         {_strip(f"array_to_string({_TEXT_PARTS}, ' ')")} AS text
  FROM pages WHERE regexp_matches({_TEXT_PARTS}[1], '[{W}]')
) WHERE length(text) > 50""",
    "media_articles": f"""
SELECT media, 'https://www.example.org/' || doc_id
         || CASE WHEN media = 'Sueddeutsche' AND doc_id % 3 = 0 THEN '?reduced=true' ELSE '' END AS url,
       'example' AS website, CASE WHEN media <> 'Bild' THEN 'homepage' END AS rubrics,
       CASE WHEN media <> 'Bild' THEN doc_id % 3 = 0 AND media <> 'Elpais' END AS paywall,
       'Nr. ' || doc_id AS title,
       array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '|') AS text
FROM (SELECT *, ([{sql_list(MEDIA_NAMES)}])[1 + doc_id % 9] AS media FROM documents)
WHERE media IS NOT NULL""",
    "pages_without_rule": """
SELECT 'Other' AS media, 'https://www.example.org/' || doc_id AS url, 'no rule' AS reject_reason
FROM documents WHERE doc_id % 9 = 8""",
    "website_names": f"SELECT page_id, {_SITE} AS website FROM pages",
    "topic_keywords": _with(TOPICS, "SELECT topic, word AS keyword FROM topic_words"),
    "topic_hits": _with(TOPICS, "SELECT * FROM hits"),
    "index_topics": _with(
        TOPICS,
        """
SELECT h.text_id, h.topic, count(*) AS count, any_value(n - (n // 2)) AS min_num
FROM hits h JOIN (SELECT topic, count(*) AS n FROM topic_words GROUP BY 1) t USING (topic)
GROUP BY 1, 2 HAVING count(*) >= any_value(n - (n // 2))""",
    ),
    "stream_ingest_dedup": _with(GOOD_ARTICLES, ARTICLE_COLUMNS),
    "stream_daily_frequency": """
SELECT CAST(ts AS DATE) AS date, 'EN' AS language, 'EVENT' AS type, event_type AS word,
       count(*) AS count
FROM events GROUP BY 1, 2, 3, 4""",
    "stream_remove_blacklisted": _with(
        WORDS, f"SELECT * FROM words WHERE NOT (type = 'PROPN' AND word IN ({sql_list(BLACKLIST)}))"
    ),
}
