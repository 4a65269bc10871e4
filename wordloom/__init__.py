"""Text analytics on Spark: every operator takes and returns DataFrames."""

from .functions.frames import count_rows, duplicate_report
from .operators.articles import (
    article_metadata,
    assemble_articles,
    crawl_summary,
    ingest_articles,
    parse_article_lines,
    rejected,
)
from .operators.docs import (
    MEDIA_LANGUAGES,
    media_language,
    prepare_docs,
    select_docs,
    undecodable_docs,
)
from .operators.frequency import daily_word_frequency, word_frequency
from .operators.index import (
    clean_words,
    explode_wide_lexicon,
    map_lexicon,
    remove_blacklisted,
    select_word_index,
)
from .operators.pages import (
    MEDIA_RULES,
    MediaRule,
    Step,
    extract_articles,
    extract_links,
    pages_without_rule,
)
from .operators.sentiment import (
    prepare_sentiment_source,
    rescale_sentiment_list,
    score_sentiment,
    sentiment_list_range,
    wordlist_sentiment,
)
from .operators.topics import (
    document_bags,
    identify_topics,
    index_topics,
    topic_hits,
    topic_keywords,
)
from .operators.trend import merge_words, word_trend
from .operators.words import annotate_tokens, count_phrases, extract_words, unsupported_languages
from .plans.daily import update_daily_frequency
from .plans.documents import documents_to_words, index_to_trend
from .plans.word_index import build_word_index
from .session import build_session, settings_for

__all__ = [
    "MEDIA_LANGUAGES",
    "MEDIA_RULES",
    "MediaRule",
    "Step",
    "annotate_tokens",
    "article_metadata",
    "assemble_articles",
    "build_session",
    "build_word_index",
    "clean_words",
    "count_phrases",
    "count_rows",
    "crawl_summary",
    "daily_word_frequency",
    "document_bags",
    "documents_to_words",
    "duplicate_report",
    "explode_wide_lexicon",
    "extract_articles",
    "extract_links",
    "extract_words",
    "identify_topics",
    "index_topics",
    "index_to_trend",
    "ingest_articles",
    "map_lexicon",
    "media_language",
    "merge_words",
    "pages_without_rule",
    "parse_article_lines",
    "prepare_docs",
    "prepare_sentiment_source",
    "rejected",
    "remove_blacklisted",
    "rescale_sentiment_list",
    "score_sentiment",
    "select_docs",
    "select_word_index",
    "sentiment_list_range",
    "settings_for",
    "topic_hits",
    "topic_keywords",
    "undecodable_docs",
    "unsupported_languages",
    "update_daily_frequency",
    "word_frequency",
    "word_trend",
    "wordlist_sentiment",
]
