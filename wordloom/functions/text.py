"""Column expressions for text: tokens, cleaning, ids, URL parts, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .regex import replace_all

# A word: a letter, then letters and digits, with inner hyphens kept.
TOKEN = r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)*"
CAPITALISED = r"^\p{Lu}"


def tokens(col: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def whitespace_tokens(col: Column) -> Column:
    """Parts between runs of white space, without empty parts."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda part: part != "")


def strip_tags(col: Column) -> Column:
    """Remove ``<...>`` on one line; a tag broken by a newline stays."""
    return replace_all(col, "<.*?>", "")


def strip_space(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def word_characters(col: Column) -> Column:
    """Keep letters, digits and underscores only."""
    return replace_all(col, r"\W+", "")


def decode_utf8(col: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 become NULL instead of failing the job."""
    return F.decode(F.encode(F.try_validate_utf8(col.cast("string")), "UTF-8"), "UTF-8")


def article_id(text: Column) -> Column:
    """Stable 64-bit id of a text."""
    return F.xxhash64(text)


def round_half_even(col: Column, digits: int) -> Column:
    """Round as NumPy does: scale, round to the nearest even integer, scale back."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def website_of_url(url: Column, literal_rule: bool = False) -> Column:
    """Site name of a URL.

    Default: the first label of the host, or the second when the first holds ``www``.
    ``literal_rule`` cuts at character 8 instead, which is right for ``https://`` only.
    """
    if literal_rule:
        parts = F.split(url, r"\.")
        first = F.get(parts, F.lit(0))
        return F.when(~first.contains("www"), F.substr(first, F.lit(9))).otherwise(
            F.get(parts, F.lit(1))
        )
    labels = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"\.")
    first = F.get(labels, F.lit(0))
    return F.when(~first.contains("www"), first).otherwise(F.get(labels, F.lit(1)))


def rubric_of_url(url: Column, politics: str | None, economics: str | None) -> Column:
    """Rubric by a path part of the URL, ``homepage`` when none fits."""
    parts = F.split(url, "/")
    return (
        F.when(F.array_contains(parts, F.lit(politics)), F.lit("politics"))
        .when(F.array_contains(parts, F.lit(economics)), F.lit("economics"))
        .otherwise(F.lit("homepage"))
    )


def has_query_parameter(url: Column, parameter: Column | str) -> Column:
    """True when the query string holds exactly ``parameter`` (``name=value``)."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_contains(F.split(query, "&"), F.lit(parameter))
