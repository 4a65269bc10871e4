"""Mixing sources to target weights, on DataFrame functions only.

Each source gets a target number of words. Whole multiples of a source are whole copies of all its
documents; the rest is a draw without replacement. Documents are blocks of words, dealt by
hash over output shards; the words to draw are split down a binary tree over the shards, at each node
between its two halves by a hypergeometric draw, so that a shard's quota is exact and needs no sort of the source. Each shard then draws
its blocks in permuted order until its quota is full; its last block is cut there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.workdir import settle
from .names import unused

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SHARD_WORDS = 1 << 21
# Up to this standard deviation a node's split is drawn exactly.
EXACT_SPREAD = 16.0

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _by_code_point(source: Column) -> Column:
    """Sort key: UTF-8 bytes sort as code points do."""
    return F.hex(F.encode(source, "UTF-8")).asc_nulls_last()


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Target words per source: shares by weight, held at ``most`` times the source's size.

    ``sizes``: source, source_size, one row per source. The targets share all words by weight; what a
    source cannot take is shared again by weight among the others. Sorted by how soon it is
    full, a source is held exactly when the level that the sources before it leave exceeds its own.
    The two windows see one row per source, not the documents.
    """
    factors = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(_by_code_point(F.col("source")))
    weight = F.element_at(factors, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    filled = Window.orderBy("full_at", _by_code_point(F.col("source"))).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "all_weights": F.sum("weight").over(everything),
        "held": F.sum("most").over(filled) - F.col("most"),
        "held_weights": F.sum("weight").over(filled) - F.col("weight"),
    })
    # The level if this source and all after it are open; it is right at the first that stays below.
    rows = rows.withColumn("level", (F.col("total") - F.col("held")) / (F.col("all_weights") - F.col("held_weights")))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key only."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _normal(*key: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(_uniform(*key, F.lit("radius"))))
    return radius * F.cos(F.lit(2 * math.pi) * _uniform(*key, F.lit("angle")))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _exact_draw(quota: Column, left: Column, right: Column, mean: Column, spread: Column, u: Column) -> Column:
    """The number whose hypergeometric distribution function first exceeds ``u``.

    Logarithms of the weights follow from one another by their ratio. Numbers further than twelve standard
    deviations and 40 from the mean have less weight than a double holds beside the others.
    """
    reach = F.lit(12.0) * spread + F.lit(40.0)
    low = F.greatest(quota - right, F.floor(mean - reach), F.lit(0).cast("long"))
    high = F.least(quota, left, F.ceil(mean + reach))

    def follow(state: Column, k: Column) -> Column:
        more = F.ln((left - k + 1).cast("double")) + F.ln((quota - k + 1).cast("double"))
        less = F.ln(k.cast("double")) + F.ln((right - quota + k).cast("double"))
        last = F.element_at(state, -1) + more - less
        return F.concat(state, F.array(last))

    rest = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    logs = F.aggregate(rest, F.array(F.lit(0.0)), follow)

    def number(weights: Column, reached: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

        def count(state: Column, weight: Column) -> Column:
            total = state["sum"] + weight
            return F.struct(total.alias("sum"), (state["below"] + (total < reached).cast("long")).alias("below"))

        return F.aggregate(weights, start, count)["below"]

    def total(weights: Column) -> Column:
        return F.aggregate(weights, F.lit(0.0), lambda x, y: x + y)

    below = _with(
        logs,
        lambda found: _with(
            F.array_max(found),
            lambda top: _with(
                F.transform(found, lambda x: F.exp(x - top)),
                lambda weights: _with(u * total(weights), lambda reached: number(weights, reached)),
            ),
        ),
    )
    return F.least(low + below, high)


def _left_quota(quota: Column, left: Column, right: Column, *key: Column) -> Column:
    """How many of ``quota`` words drawn from left + right words come from the left: hypergeometric.

    Exact by the inverse distribution function up to a standard deviation of EXACT_SPREAD; beyond it a rounded
    normal with the same mean and variance, kept within what both sides hold.
    """
    n = left + right
    share = F.when(n > 0, left.cast("double") / n).otherwise(F.lit(0.0))
    rest = F.when(n > 1, (n - quota).cast("double") / (n - 1)).otherwise(F.lit(0.0))
    mean = quota * share
    spread = F.sqrt(F.greatest(mean * (F.lit(1.0) - share) * rest, F.lit(0.0)))
    near = F.round(mean + spread * _normal(*key)).cast("long")
    near = F.greatest(F.least(near, quota, left), quota - right, F.lit(0).cast("long"))
    exact = _exact_draw(quota, left, right, mean, spread, _uniform(*key, F.lit("exact")))
    return F.when(spread <= EXACT_SPREAD, exact).otherwise(near)


def shard_quotas(leaves: DataFrame, levels: int, seed: int) -> DataFrame:
    """Split each source's quota among 2 ** levels shards, down the tree.

    ``leaves``: source, quota, shard, words (of the source in the shard). Returns source, shard, quota.
    The words below every node of every level are one table; each level of the tree joins its part.
    """
    quotas = leaves.groupBy("source").agg(F.max("quota").alias("quota")).select(
        "source", F.lit(0).cast("long").alias("node"), "quota"
    )
    if not levels:
        return quotas.select("source", F.col("node").alias("shard"), "quota")
    # Per level the parent of a shard's node there, and the side the node is on.
    steps = F.array(*[
        F.struct(
            F.lit(level).alias("level"), F.shiftright("shard", levels - level).alias("parent"),
            (F.shiftright("shard", levels - level - 1) % 2).alias("side"),
        )
        for level in range(levels)
    ])
    each = leaves.select("source", "words", F.explode(steps).alias("step"))
    zero = F.lit(0).cast("long")
    sums = settle(
        each.groupBy(F.col("source").alias("__source"), F.col("step.level").alias("__level"), F.col("step.parent").alias("__node")).agg(
            F.sum(F.when(F.col("step.side") == 0, F.col("words")).otherwise(zero)).alias("left"),
            F.sum(F.when(F.col("step.side") == 1, F.col("words")).otherwise(zero)).alias("right"),
        ),
        "mix-nodes",
    )
    for level in range(levels):
        sides = sums.where(F.col("__level") == level)
        split = quotas.join(sides, F.col("source").eqNullSafe(F.col("__source")) & (F.col("node") == F.col("__node")))
        left = _left_quota(F.col("quota"), F.col("left"), F.col("right"), F.lit(seed), F.lit(level), F.col("source"), F.col("node"))
        split = split.withColumn("to_left", left)
        quotas = split.select(
            "source",
            F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("to_left").alias("quota")),
                F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("quota") - F.col("to_left")).alias("quota")),
            )).alias("child"),
        ).select("source", "child.node", "child.quota")
    return quotas.select("source", F.col("node").alias("shard"), "quota")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, shard, copy.

    ``copy`` numbers rows that are alike in id, source and size. ``taken``: words the mix takes of the document; a multiple of its size is whole copies, the rest a
    run from its start. A source's taken words are its target rounded. Sources get the weights in turn by
    code point, NULL last and a source of its own. NULL and empty texts have size 0 and take no
    part; an id may repeat or be NULL, each row counts. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    # Rows alike in all that counts are numbered, so that each has a place of its own.
    alike = settle(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("n")), "mix-sizes")
    by_source = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = settle(source_targets(by_source, weights, most), "mix-targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total / shard_words))))
    each = alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    each = each.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "copy"))
    each = each.withColumn("shard", F.pmod(F.shiftright("place", 20), F.lit(1 << levels)))

    # A bound on the table of targets is the number of sources; Spark broadcasts it only below its limit.
    renamed = targets.withColumnRenamed("source", "__of")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.round("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    renamed = renamed.withColumn("whole", copies)
    renamed = renamed.withColumn("quota", (F.round("target").cast("long") - F.col("whole") * F.col("source_size")).cast("long"))
    placed = each.join(renamed, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    leaves = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("quota").alias("quota"))
    leaves = settle(leaves, "mix-leaves")
    quotas = shard_quotas(leaves, levels, seed).select(
        F.col("source").alias("__of"), F.col("shard").alias("__shard"), F.col("quota").alias("own_quota")
    )
    # Rows without words take no part, however many they are.
    idle = placed.where("size = 0").select(
        "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "shard", "copy"
    )
    drawn = placed.where("size > 0").join(
        quotas, F.col("source").eqNullSafe(F.col("__of")) & (F.col("shard") == F.col("__shard"))
    )
    permuted = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", "copy")
    before = F.sum("size").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("own_quota") - before))
    return drawn.withColumn("taken", F.col("whole") * F.col("size") + extra).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shard", "copy"
    ).unionByName(idle)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n at least 1)."""
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    rest = F.element_at(F.split(body, SPACE, (n + 1).cast("int")), -1)
    more = F.regexp_count(body, F.lit(WORD)) > n
    head = F.substring(body, F.lit(1), F.char_length(body) - F.char_length(rest))
    return F.when(more, F.regexp_replace(head, r"[\x20\x09-\x0D]+\z", "")).otherwise(body)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``, with all their columns: whole copies, and the drawn part of documents that are cut.

    Documents without words (NULL, empty, blank) are not in a mix; a NULL source is one of its own; rows alike in
    id, source and size (NULL ids too) are numbered by their texts, and each takes the words of its number.
    ``n_chars``, where it is there, follows the text. Columns may have any name; an empty table gives an empty one.
    """
    of_id, of_source, of_size, taken, copy, words, nth, n = (
        unused(docs.columns, "id", "of", "size", "taken", "copy", "words", "nth", "n")
    )
    mixed = mix_sources(docs, **options).where("taken > 0").select(
        F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size),
        F.col("taken").alias(taken), F.col("copy").alias(copy),
    )
    mixed = settle(mixed, "mix-taken")
    rows = docs.withColumn(words, word_count(F.col("text").cast("string")))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col(of_id))
        & F.col("source").cast("string").eqNullSafe(F.col(of_source))
        & (F.col(words) == F.col(of_size))
    )
    if not mixed.where(F.col(copy) > 1).isEmpty():
        alike = Window.partitionBy(F.col("doc_id").cast("long"), F.col("source").cast("string"), words)
        rows = rows.withColumn(nth, F.row_number().over(alike.orderBy(F.sha2(F.col("text").cast("string"), 256))))
        same = same & (F.col(nth) == F.col(copy))
    met = rows.join(mixed, same)
    whole = F.floor(F.col(taken) / F.col(words)).cast("int")
    part = (F.col(taken) - whole * F.col(words)).cast("int")
    lengths = F.concat(
        F.array_repeat(F.col(words).cast("int"), whole),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")),
    )
    each = met.withColumn(n, F.explode(lengths))
    is_cut = F.col(n) < F.col(words)
    cut = F.when(is_cut, first_words(F.col("text"), F.col(n))).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        value = F.col(f"`{c}`")
        if c == "text":
            value = cut
        elif c == "n_chars":
            value = F.when(is_cut, F.char_length(cut)).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return each.select(*columns)
