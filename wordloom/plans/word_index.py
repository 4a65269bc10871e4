"""From stored words to the word index in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from ..functions.frames import sum_word_rows
from ..functions.masks import type_language_mask
from ..functions.workdir import settle
from ..operators.index import (
    WORD_KEYS,
    _lexicon_rows,
    _rewritten,
    remove_blacklisted,
    rewrite_dictionary,
    select_word_index,
)


def build_word_index(
    words: DataFrame,
    blacklist: DataFrame | Iterable[str],
    lexicon: DataFrame,
    language: str = "DE",
    type_limits: dict[str, int] | None = None,
    remove: Sequence[str] = (),
    replace: dict[str, str] | None = None,
    word_types: Sequence[str] | None = ("PROPN",),
) -> DataFrame:
    """Select frequent words, cleanse, drop blacklisted ones, map to the lexicon.

    Same result as the four operators one after the other. Cleansing, blacklist and lexicon work
    row by row and counts are summed, so one final count replaces the count after each step.
    """
    chosen = select_word_index(words, language, type_limits)
    mask = type_language_mask(word_types, [language])
    rows = chosen
    if remove or replace:
        dictionary = settle(rewrite_dictionary(chosen, remove, replace, mask), "rewrites")
        rows = _rewritten(rows, dictionary, mask)
    rows = remove_blacklisted(rows, blacklist, word_types, [language])
    rows = _lexicon_rows(rows, lexicon, word_types, [language], False, False)
    return sum_word_rows(rows, WORD_KEYS, words)
