"""Joins of a large table to a lookup table, safe for hot keys.

A lookup table is broadcast only after its size was measured (or where the caller proves a bound).
Otherwise both sides are shuffled once and adaptive execution splits frequent keys; a caller that
knows the most frequent keys has them answered from a small broadcast and spread instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField

# Bounds for a measured broadcast.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A key outside the HOT_KEYS most frequent ones holds at most 1/HOT_KEYS of all rows.
HOT_KEYS = 10_000


# What a hash table takes for a row besides its key and its fields: lengths, a pointer, slots half of which stay empty.
SLOT_BYTES = 64


def _variable_bytes(field: StructField) -> Column | None:
    """Bytes of a field beyond its fixed eight."""
    kind = field.dataType.typeName()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    if kind in ("array", "map", "struct"):
        as_json = F.to_json(F.struct(F.col(field.name)))
        return F.coalesce(F.octet_length(as_json), F.lit(0))
    return None


def _measured(df: DataFrame, width: Column) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return row["n"], row["b"] or 0


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) in one distributed aggregation."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if (extra := _variable_bytes(field)) is not None:
            width = width + extra
    return _measured(df, width)


def hash_table_size(df: DataFrame, on: Sequence[str]) -> tuple[int, int]:
    """(rows, approximate bytes of the hash table by ``on`` that a broadcast makes of them on the driver).

    Of short words that is three times what ``measured_size`` says and more: fields are padded, keys come once more.
    """
    width = F.lit(8 + 8 * len(df.columns) + 8 + 8 * len(on) + SLOT_BYTES)
    for field in df.schema.fields:
        if (extra := _variable_bytes(field)) is not None:
            width = width + F.ceil(extra / 8) * (16 if field.name in on else 8)
    return _measured(df, width)


def fits_broadcast(df: DataFrame, on: Sequence[str] | None = None) -> bool:
    """True when a measured table is small enough for every executor; with ``on``, its hash table for the driver too."""
    rows, size = measured_size(df) if on is None else hash_table_size(df, on)
    return rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str] = (),
    condition: Column | None = None,
    small: bool | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``.

    ``how``: left, inner, semi or anti. ``condition`` limits which left rows may match. ``small``: True
    skips the measurement because the caller has a bound, False goes straight to the shuffle, None
    measures. Beyond the broadcast both sides meet in one shuffle, and adaptive execution splits
    the left rows of a frequent key. With ``hot`` (``on``, found and
    right columns of at most HOT_KEYS frequent keys; right keys unique) those are answered from that
    small broadcast instead and spread by ``spread_by``, left columns that vary within a key.
    """
    on = list(on)
    if small is None:
        small = fits_broadcast(right)
    extra = [c for c in right.columns if c not in on]
    table = right.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns])
    allowed = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))

    if small or hot is None:
        equal = allowed
        for c in on:
            equal = equal & (F.col(c) == F.col(f"__r_{c}"))
        kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
        joined = left.join(F.broadcast(table) if small else table, equal, kind)
        if how in ("semi", "anti"):
            return joined
        return joined.select(*left.columns, *[F.col(f"__r_{c}").alias(c) for c in extra])

    usable = allowed
    for c in on:
        usable = usable & F.col(c).isNotNull()
    hot = hot.select(
        *[F.col(c).alias(f"__h_{c}") for c in hot.columns], F.lit(True).alias("__hot")
    )
    tagged = left.withColumn("__ok", usable).join(
        F.broadcast(hot), [F.col("__ok")] + [F.col(c) == F.col(f"__h_{c}") for c in on], "left"
    )
    # The shuffle goes by __place: a hash of the key for cold rows, of other columns for hot rows
    # and rows that cannot match, which spreads those. A hash, because the optimizer would take a
    # constant salt out of the join keys.
    cold_row = F.col("__ok") & F.col("__hot").isNull()
    tagged = tagged.withColumn(
        "__place", F.when(cold_row, F.xxhash64(*on)).otherwise(F.xxhash64(*spread_by))
    )
    cold = table.withColumns(
        {"__r_place": F.xxhash64(*[f"__r_{c}" for c in on]), "__cold": F.lit(True)}
    )
    joined = tagged.join(
        cold,
        [F.col("__place") == F.col("__r_place")]
        + [F.col(c) == F.col(f"__r_{c}") for c in on]
        + [F.col("__ok")],
        "left",
    )
    found = F.coalesce(F.col("__h_found"), F.col("__cold"), F.lit(False))
    if how == "anti":
        return joined.where(~found).select(*left.columns)
    if how in ("semi", "inner"):
        joined = joined.where(found)
    if how == "semi":
        return joined.select(*left.columns)
    values = [F.coalesce(F.col(f"__h_{c}"), F.col(f"__r_{c}")).alias(c) for c in extra]
    return joined.select(*left.columns, *values)
