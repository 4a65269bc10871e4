"""Word trends: regression of daily counts over past days."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import as_word_table, word_partitions
from ..functions.joins import lookup_join
from ..functions.masks import keys_present, one_of, sum_counts
from ..schemas import canonical_names, require_columns

# Default periods in days.
PERIODS = (7, 17, 21, 28, 90)
TOP_PERIODS = (7, 14, 21, 365)
# Parts that the rows of one keyword are summed in first.
_SPREAD = 64


def _word_keywords(freq: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Keyword per distinct (language, word) that the lexicon covers.

    Stems are met by equality: every word offers its prefixes of the lengths the stems have.
    """
    entries = lexicon.where(F.col("mapping").isin("FM", "M")).groupBy(
        "language", "mapping", F.col("word").alias("part")
    )
    entries = entries.agg(F.min("category").alias("keyword"))
    stems = entries.where(F.col("mapping") == "M").select(F.length("part").alias("n"))
    lengths = sorted(row["n"] for row in stems.distinct().collect())
    word = F.col("word")
    offers = [F.array(F.struct(F.lit("FM").alias("mapping"), word.alias("part")))]
    for n in lengths:
        stem = F.struct(F.lit("M").alias("mapping"), F.substring(word, 1, n).alias("part"))
        offers.append(F.when(F.length(word) >= n, F.array(stem)))
    offered = F.explode(F.flatten(F.filter(F.array(*offers), lambda o: o.isNotNull())))
    vocabulary = freq.select("language", "word").where(word.isNotNull()).distinct()
    offered = vocabulary.select("language", "word", offered.alias("o")).select(
        "language", "word", "o.mapping", "o.part"
    )
    hits = lookup_join(
        offered, entries, ["language", "mapping", "part"], "inner", small=False
    )
    # FM sorts before M; among stems the longest comes first.
    best = F.min(F.struct("mapping", (-F.length("part")).alias("n"), "keyword")).alias("best")
    chosen = hits.groupBy("language", "word").agg(best).select("language", "word", "best.keyword")
    return chosen


def merge_words(
    freq: DataFrame,
    lexicon: DataFrame | None = None,
    merge: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace words by their keyword.

    ``lexicon`` is the long form (language, word, mapping FM or M, category); whole words win over
    stems, a longer stem over a shorter one, and the smallest keyword decides between equals. Rows
    of other languages stay. ``merge`` maps a keyword to its variants in any language.
    """
    if lexicon is not None:
        keywords = _word_keywords(freq, lexicon)
        freq = lookup_join(freq, keywords, ["language", "word"], "left", small=False)
        freq = freq.withColumn("word", F.coalesce("keyword", "word")).drop("keyword")
    if merge:
        pairs = [F.lit(x) for key, variants in merge.items() for v in variants for x in (v, key)]
        mapped = F.try_element_at(F.create_map(*pairs), F.col("word"))
        freq = freq.withColumn("word", F.coalesce(mapped, F.col("word")))
    return freq


def _period_columns(periods: Sequence[int]) -> list[Column]:
    """Slope and intercept of count on past_days per period; day -p itself is outside."""
    x, y = F.col("past_days").cast("double"), F.col("count").cast("double")
    columns = []
    for p in periods:
        inside = F.col("past_days") > -p
        xs, ys = F.when(inside, x), F.when(inside, y)
        spread = F.regr_sxx(ys, xs)
        # All points on one day: a flat line through their mean.
        flat = (spread == 0) | spread.isNull()
        slope = F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(ys, xs))
        intercept = F.when(flat, F.avg(ys)).otherwise(F.regr_intercept(ys, xs))
        columns += [slope.alias(f"trend_{p}"), intercept.alias(f"trend_{p}_ic")]
    return columns


def _day(freq: DataFrame) -> Column:
    """The day of a row; a column of dates stays bare, so that partitions can be pruned."""
    return F.col("date") if dict(freq.dtypes)["date"] == "date" else F.to_date("date")


def _rows_by_day(freq: DataFrame) -> dict[datetime.date, int]:
    """Rows per day: one number for each day of the table (a stored one knows them)."""
    counted = freq.groupBy(_day(freq).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return {row["day"]: row["n"] for row in counted.where(F.col("day").isNotNull()).collect()}


def _latest_day(freq: DataFrame, newest: datetime.date | None, prepared) -> datetime.date | None:
    """The latest day with rows that count: mostly the newest day of the table."""
    if newest is None:
        return None
    if not prepared(freq.where(_day(freq) == F.lit(newest))).isEmpty():
        return newest
    return prepared(freq).agg(F.max("date")).first()[0]


def word_trend(
    freq: DataFrame,
    blacklist: DataFrame | Iterable[str] | None = None,
    lexicon: DataFrame | None = None,
    type: str = "PROPN",
    min_count: int = 5,
    top_ratio: float = 0.5,
    periods: Sequence[int] | None = None,
    top_n: int | None = None,
    merge: dict[str, Sequence[str]] | None = None,
    languages: Sequence[str] | None = None,
    rank_by_language: bool = False,
) -> DataFrame:
    """Trend of the most frequent words of the latest day.

    Words of one type, without blacklisted ones, merged by ``lexicon`` or ``merge``, are counted
    per day. Words with at least ``min_count`` on the latest day are ranked by count (equal counts
    share the best rank); ranks up to int(top_ratio * number of words) stay, or the first
    ``top_n`` words when given. For each period the regression of count on past days follows.

    The latest day comes first: it bounds the days that are read (a filter on ``date``, so a table
    partitioned by it is pruned), and its ranks choose the words that are regressed, in one
    aggregation for all periods. The rank comes from the histogram of counts, so no task has to
    sort all words.

    Rows are dealt by word over as many partitions as the days read have rows for, and all that is done per
    word stays there, so what a task holds depends neither on the table's size nor on the session's settings.
    """
    freq = canonical_names(freq)
    require_columns(freq, ["date", "language", "type", "word", "count"], "word_trend")
    if periods is None:
        periods = PERIODS if top_n is None else TOP_PERIODS
    listed, listed_small = None, None
    if blacklist is not None:
        listed, listed_small = as_word_table(freq.sparkSession, blacklist)

    def prepared(part: DataFrame) -> DataFrame:
        rows = part.where((F.col("type") == type) & one_of("language", languages)).select(
            F.to_date("date").alias("date"),
            "language",
            "word",
            F.col("count").cast("bigint").alias("count"),
        )
        if listed is not None:
            rows = lookup_join(rows, listed, ["word"], "anti", small=listed_small)
        return rows

    by_day = _rows_by_day(freq)
    latest = _latest_day(freq, max(by_day, default=None), prepared)
    if latest is None:  # no rows: any day will do
        latest = datetime.date(1970, 1, 1)
    first = latest - datetime.timedelta(days=max(periods) - 1)
    window = prepared(freq.where(_day(freq).between(F.lit(first), F.lit(latest))))
    today = prepared(freq.where(_day(freq) == F.lit(latest)))
    by_word = ["language", "word"]
    keys = ["date", *by_word]
    parts = word_partitions(freq.sparkSession, sum(n for day, n in by_day.items() if first <= day <= latest))

    def summed(rows: DataFrame, parts: int) -> DataFrame:
        if lexicon is None and not merge:
            return sum_counts(rows.where(keys_present(keys)).repartition(parts, *by_word), keys)
        # Very many words may become one: their rows are summed in parts before they meet.
        spread = rows.withColumn("__part", F.pmod(F.xxhash64("word"), F.lit(_SPREAD)))
        merged = merge_words(spread, lexicon, merge).where(keys_present(keys))
        sums = sum_counts(merged.repartition(parts, *by_word, "__part"), [*keys, "__part"])
        return sum_counts(sums.repartition(parts, *by_word), keys)

    lines = summed(today, word_partitions(freq.sparkSession, by_day.get(latest, 0)))
    lines = lines.where(F.col("count") >= min_count)

    # Counts of one day sum up to the day's words N, so there are at most sqrt(2N) distinct counts:
    # about 1.5 million for 10^12 words. That bounds both the window and the broadcast.
    group = ["language"] if rank_by_language else []
    histogram = lines.groupBy(*group, "count").agg(F.count(F.lit(1)).alias("words"))
    falling = Window.partitionBy(*group).orderBy(F.col("count").desc())
    everything = Window.partitionBy(*group)
    above = F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    ranks = histogram.select(
        *group,
        "count",
        (F.coalesce(above, F.lit(0)) + 1).cast("int").alias("rank"),
        F.sum("words").over(everything).alias("num_words"),
    )
    if top_n is None:
        last_rank = (F.lit(float(top_ratio)) * F.col("num_words")).cast("bigint")
        ranks = ranks.where(F.col("rank") <= last_rank)
    else:
        ranks = ranks.where(F.col("rank") <= top_n)
    trend_columns = [c for p in periods for c in (f"trend_{p}", f"trend_{p}_ic")]
    chosen = lines.join(ranks, [*group, "count"]).select("date", "language", "word", "count", "rank")
    chosen = chosen.repartition(parts, *by_word)
    past = F.datediff("date", F.lit(latest)).alias("past_days")
    series = summed(window, parts).select("language", "word", past, "count")
    lined = (
        series.join(chosen.select(*by_word), by_word, "left_semi")
        .groupBy(*by_word)
        .agg(*_period_columns(periods))
    )
    ranked = chosen.join(lined, by_word).select(
        "date", "language", "word", "count", "rank", *trend_columns
    )
    if top_n is None:
        return ranked.orderBy("rank", "language", "word")
    if rank_by_language:
        place = Window.partitionBy("language").orderBy("rank", "word")
        return (
            ranked.withColumn("__place", F.row_number().over(place))
            .where(F.col("__place") <= top_n)
            .drop("__place")
            .orderBy("rank", "language", "word")
        )
    return ranked.orderBy("rank", "language", "word").limit(top_n)
