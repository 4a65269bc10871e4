"""Near-duplicate documents: exact self-join on 5-word shingle sets with a token-group matrix.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one *class*.
2. Classes that share min-hashes are compared with the smallest class of a min-hash. Verified links
   merge into *groups* whose members need no more comparison; similar classes without a link form
   groups too. Groups are cut into parts of bounded number and like sizes.
3. The token-group matrix has a cell (shingle, part) for each shingle in the union of the members'
   *prefixes*: under one order of all shingles, two sets with a Jaccard index of at least T share one
   of their first n - ceil(T n) + 1 shingles. Frequent shingles come last in the order, so passages
   that many documents share are rarely in a prefix. Any order gives the same links.
4. Parts that meet in cells, unless linked already, are candidates when their sizes, and for lone sets
   the number of common cells and what follows the last of them, allow a link. For each set of
   the one part its overlap with the other's whole union is then counted; only where that reaches
   T of its own size is the other part opened and every member compared exactly.

Hashes are 64 bits wide; two different shingles or sets are taken for equal with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import fits_broadcast
from ..functions.workdir import TEXT_BATCHES, settle
from .graph import connected_components
from .names import unused
from .words import mix, released, seeds, shingle_sets, slices

# Similarity as a fraction: 100 * shared >= 75 * union.
SHARED, UNION = 100, 75

# What is broadcast about repeated shingles, whatever the corpus: a list of the most frequent (8 bytes
# each) and a bit map (8 MB) in which at most one bit in three is set.
FREQUENT = 1 << 19
MAP_BITS = 26
MAP_MOST = (1 << MAP_BITS) * 2 // 5

# Shingles a task looks at together when it counts, and members of one part of a group.
CHUNK = 2_000_000
PART = 64
PARTS_OPENED = 32
POSTINGS_PER_BUCKET = 500_000
MINHASHES = 8
EQUAL = 3
TEXTS_PER_BUCKET = 20_000


def prefix_length(n: int) -> int:
    """How many shingles of a set of n must be looked up so that no link is lost."""
    return n - -(-UNION * n // SHARED) + 1


LEVELS = np.unique(np.round(2.0 ** (np.arange(2, 120) / 2))).astype(np.int64)  # 2, 3, 4, 6, 8, 11, ...


def _marks(bits: int):
    """Shingles of a task, each once per chunk, as the 32 bits that follow the bits of their bucket."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(parts) >> np.uint64(32 - bits))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        n = np.diff(np.append(first, len(every)))
        every = every[first]
        cuts = np.searchsorted(every, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        low = every.astype(np.uint32)
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        many = [np.flatnonzero(n[a:b] > 1) + a for _, a, b in spans]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in spans], pa.int32()),
                pa.array([low[a:b].tobytes() for _, a, b in spans], pa.binary()),
                pa.array([low[m].tobytes() for m in many], pa.binary()),
                pa.array([(n[m] - 1).astype(np.uint32).tobytes() for m in many], pa.binary()),
            ],
            names=["bucket", "marks", "again", "times"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                parts += sets
                held += sum(map(len, sets))
                if held >= CHUNK:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return rows


def _repeated(key, table):
    """The shingles of a bucket that more than one text holds, their numbers, and how many by level."""
    join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32)
    marks = np.sort(join("marks"))
    first = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(marks)))
    marks = marks[first]
    again = join("again")
    if len(again):
        n = n + np.bincount(np.searchsorted(marks, again), weights=join("times"), minlength=len(marks)).astype(np.int64)
    some = n > 1
    marks, n = marks[some], n[some]
    levels = np.bincount(np.searchsorted(LEVELS, n, side="right"), minlength=len(LEVELS) + 1)
    return pa.table(
        [
            pa.array([key[0].as_py()], pa.int32()), pa.array([marks.tobytes()], pa.binary()),
            pa.array([np.minimum(n, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()), pa.array([levels.tolist()], pa.list_(pa.int64())),
        ],
        names=["bucket", "marks", "counts", "levels"],
    )


def _map_slices(bits: int, least: int, often: int):
    """A bucket's slice of the map, and its shingles that go to the list with their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for bucket, marks, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "marks", "counts")), strict=True):
                marks, counts = np.frombuffer(marks, np.uint32), np.frombuffer(counts, np.uint32)
                width = max(MAP_BITS - bits, 0)
                held = np.zeros(1 << max(width, 3), bool)
                held[marks[counts >= least] >> np.uint32(32 - width)] = True
                top = counts >= often
                keys = np.uint64(bucket) << np.uint64(32) | marks[top].astype(np.uint64)
                out.append((bucket, np.packbits(held).tobytes(), keys.tobytes(), counts[top].tobytes()))
            columns = zip(*out, strict=True)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "held", "keys", "counts"]
            )

    return rows


class Order:
    """One order of all shingles: those that repeat come last, the most frequent at the very end."""

    def __init__(self, bits: int, held: np.ndarray, keys: np.ndarray, ranks: np.ndarray):
        self.bits, self.held, self.keys, self.ranks = bits, held, keys, ranks

    def prefix(self, own: np.ndarray) -> np.ndarray:
        """The first shingles of a sorted set, as many as must be looked up."""
        n = prefix_length(len(own))
        slot = (own >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        repeats = (self.held[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
        alone = own[~repeats]
        if len(alone) >= n:
            return alone[:n]
        late = own[repeats]
        rank = np.zeros(len(late), np.int64)
        if len(self.keys):
            key = late >> np.uint64(32 - self.bits)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], 0)
        return np.concatenate((alone, late[np.argsort(rank, kind="stable")]))[:n]


def shingle_order(docs: DataFrame) -> Order:
    """Count every shingle of the corpus by bucket and say which repeat.

    Only the order depends on this, never a link. From how many texts on a shingle counts as repeated,
    and as frequent, follows from the counts of all, so that both fit their bound.
    """
    n = docs.count()
    bits = min(MAP_BITS - 3, max(6, int(np.ceil(np.log2(max(1, n / TEXTS_PER_BUCKET))))))
    marks = docs.select("text").mapInArrow(released(_marks(bits)), "bucket int, marks binary, again binary, times binary")
    counts = settle(
        marks.groupBy("bucket").applyInArrow(_repeated, "bucket int, marks binary, counts binary, levels array<bigint>"),
        "near-repeated",
    )
    totals = np.zeros(len(LEVELS) + 1, np.int64)
    by_level = counts.select(F.posexplode("levels").alias("level", "m")).groupBy("level").agg(F.sum("m").alias("m"))
    for row in by_level.collect():
        totals[row["level"]] = row["m"]

    def from_count(most: int) -> int:
        level = next(j for j in range(1, len(totals) + 1) if int(totals[j:].sum()) <= most)
        return int(LEVELS[level - 1]) if level <= len(LEVELS) else 0xFFFFFFFF

    made = counts.select("bucket", "marks", "counts").mapInArrow(
        _map_slices(bits, from_count(MAP_MOST), from_count(FREQUENT)), "bucket int, held binary, keys binary, counts binary"
    ).collect()
    held = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = len(held) >> bits
    for row in made:
        held[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["held"], np.uint8)
    keys = np.frombuffer(b"".join(r["keys"] for r in made), np.uint64)
    often = np.frombuffer(b"".join(r["counts"] for r in made), np.uint32)
    by_key = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, often))] = np.arange(1, len(keys) + 1)
    return Order(bits, held, keys[by_key], rank[by_key])


def _describe(shared):
    """Rows of the set table: size, class, min-hashes and prefix of every text."""
    salts = seeds(MINHASHES, 77)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                sid = np.zeros(len(sets), np.uint64)
                keys = np.zeros((MINHASHES, len(sets)), np.uint64)
                full = np.flatnonzero(sizes)
                prefixes: list[bytes | None] = [None] * len(sets)
                if len(full):
                    every = np.concatenate(sets)
                    first = (np.cumsum(sizes) - sizes)[full]
                    sid[full] = mix(np.add.reduceat(mix(every ^ seeds(1, 5)[0]), first) + sizes[full].astype(np.uint64))
                    for j in range(MINHASHES):
                        keys[j, full] = np.minimum.reduceat(mix(every ^ salts[j]), first)
                    for i in full.tolist():
                        prefixes[i] = order.prefix(sets[i]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"), pa.array(sizes), pa.array(sid.view(np.int64)),
                        *[pa.array(k.view(np.int64)) for k in keys],
                        pa.array(prefixes, pa.binary()),
                    ],
                    names=["doc_id", "row", "n", "sid", *[f"k{j}" for j in range(MINHASHES)], "prefix"],
                )

    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid and the whole sorted set of every text, as bytes; each set once per task."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            sets, sid = [], []
            for own in shingle_sets(part.column("text")):
                if len(own):
                    name = mix(np.array([mix(own ^ seeds(1, 5)[0]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
                    if int(name) not in seen:
                        seen.add(int(name))
                        sets.append(own)
                        sid.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["sid", "shingles"],
            )


def _unique(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by the first column, then the others; and where a new row begins."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return columns, new


def _cells(buckets: int):
    """Cells of the matrix that a task fills, each once, packed by bucket of the shingle.

    A set alone in its group brings its size and the shingle's place in the prefix; a part of a larger
    group only minus its size band and its number. Odd group ids mean that all members are linked.
    """

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns, new = _unique([np.concatenate(x) for x in zip(*held, strict=True)])
        columns = [c[new] for c in columns]
        bucket = (columns[0] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        columns = [c[order] for c in columns]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cuts[:-1]]),
                *[pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns],
            ],
            names=["bucket", "shingles", "groups", "sizes", "spots"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("prefix", "gid", "part", "n"))
            for prefix, group, part, n in zip(*columns, strict=True):
                own = np.frombuffer(prefix, np.uint64)
                k = len(own)
                size = n if part is None else -band_of(n)
                spots = np.arange(k, dtype=np.int32) if part is None else np.full(k, part, np.int32)
                held.append((own, np.full(k, group, np.int64), np.full(k, size, np.int32), spots))
                total += k
                if total >= CHUNK:
                    yield from packed(held)
                    held, total = [], 0
        if held:
            yield from packed(held)

    return rows


def band_of(n):
    """Sizes whose ratio allows a link lie in the same or in neighbouring bands."""
    return int(np.log(n) / np.log(1.34))


def _meeting(length: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within lists of one length, some at a time."""
    if length <= 128:
        one, two = np.triu_indices(length, 1)
        step = max(1, 500_000 // len(one))
        for at in range(0, len(starts), step):
            first = starts[at : at + step, None]
            yield (first + one).ravel(), (first + two).ravel()
    else:
        for start in starts.tolist():
            for i in range(length - 1):
                rest = np.arange(start + i + 1, start + length)
                yield np.full(len(rest), start + i), rest


_PAIR = ["ga", "gb", "sa", "sb", "pa", "pb"]


def _candidates(key, table):
    """Pairs of parts that meet in cells and are not known to be linked: number of cells, last places."""
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    columns, new = _unique([join("shingles", np.uint64), join("groups", np.int64), join("sizes", np.int32), join("spots", np.int32)])
    shingle, group, size, spot = (c[new] for c in columns)
    single = size > 0
    low = np.floor(np.log(np.maximum(size, 1)) / np.log(1.34)).astype(np.int32)
    band = np.where(single, low, -size)
    part = np.where(single, 0, spot)
    cuts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1], [True])))
    lengths = np.diff(cuts)
    held: list[list[np.ndarray]] = []
    waiting = 0

    def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """One row per pair: its keys, number of cells, last places."""
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort(whole[5::-1])
        whole = [c[order] for c in whole]
        first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in whole[:6]], axis=0))))
        return [
            *[c[first] for c in whole[:6]], np.add.reduceat(whole[6], first),
            np.maximum.reduceat(whole[7], first), np.maximum.reduceat(whole[8], first),
        ]

    for length in np.unique(lengths[lengths > 1]).tolist():
        for i, j in _meeting(length, cuts[:-1][lengths == length]):
            fits = ((group[i] != group[j]) | (group[i] & 1 == 0)) & (np.abs(band[i] - band[j]) <= 1)
            both = single[i] & single[j]
            small, large = np.minimum(size[i], size[j]).astype(np.int64), np.maximum(size[i], size[j])
            fits &= ~both | (SHARED * small >= UNION * large)
            i, j = i[fits], j[fits]
            if len(i):
                held.append([
                    group[i], group[j], size[i], size[j], part[i], part[j],
                    np.ones(len(i), np.int64), spot[i].astype(np.int64), spot[j].astype(np.int64),
                ])
                waiting += len(i)
            if waiting > CHUNK:
                held = [summed(held)]
                waiting = len(held[0][0]) // 2
    found = summed(held) if held else [np.zeros(0, np.int64)] * 9
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3)
    return pa.table(
        [pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=[*_PAIR, "cells", "la", "lb"]
    )


def _may_link() -> Column:
    """What pairs of lone sets can still share after their last common prefix shingle suffices.

    Up to that shingle both prefixes are complete, so the cells counted are all they share there.
    """
    lone = (F.col("sa") > 0) & (F.col("sb") > 0)
    most = F.col("cells") + F.least(F.col("sa") - F.col("la"), F.col("sb") - F.col("lb")) - 1
    return ~lone | ((SHARED + UNION) * most >= UNION * (F.col("sa") + F.col("sb")))


def _open(key, table):
    """Links between one part and others; another part is opened only when its union allows it.

    The others' shingles form two inverted lists, of parts and of members. A query counts its shingles
    in each part's union first, then in the members of the parts that qualify.
    """
    left: dict[int, np.ndarray] = {}
    right: dict[tuple, np.ndarray] = {}
    columns = (table.column(c).to_pylist() for c in ("side", "gid", "part", "sid", "shingles"))
    for side, gid, part, sid, data in zip(*columns, strict=True):
        (right if side else left)[(gid, part, sid) if side else sid] = np.frombuffer(data, np.uint64)
    empty = pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
    if not left or not right:
        return empty
    names = list(right)
    number = {k: n for n, k in enumerate(dict.fromkeys(k[:2] for k in names))}
    part_of = np.array([number[k[:2]] for k in names])
    sids = np.array([k[2] for k in names], np.int64)
    sizes = np.array([len(right[k]) for k in names])
    tokens = np.concatenate([right[k] for k in names])
    member = np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    found_a, found_b = [], []
    for sid, own in left.items():
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        n = high - low
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        which = np.repeat(np.arange(len(own)), n)
        # Each shingle once per part: the overlap with the part's union.
        cells = np.unique(which * len(number) + part_of[member[at]])
        overlap = np.bincount(cells % len(number), minlength=len(number))
        opened = SHARED * overlap >= UNION * len(own)
        hits = member[at]
        hits = hits[opened[part_of[hits]]]
        both = np.bincount(hits, minlength=len(names))
        linked = (SHARED * both >= UNION * (len(own) + sizes - both)) & (sids != sid)
        found_b.append(sids[linked])
        found_a.append(np.full(int(linked.sum()), sid, np.int64))
    return pa.table([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast when its measured size allows one, for a hash join otherwise."""
    return F.broadcast(df) if fits_broadcast(df) else df.hint("shuffle_hash")


def _links(pairs: DataFrame, members: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Verified links of candidate parts.

    ``pairs``: ga, pa, gb, pb; ``members``: gid, part, sid, row of a document with that set. A task
    opens one part against at most some PARTS_OPENED others, so each set travels about once.
    """
    pairs = settle(pairs, f"{name}-pairs")
    n = pairs.groupBy("ga", "pa").agg(F.count(F.lit(1)).alias("c"))
    run = F.pmod(F.xxhash64("gb", "pb"), F.ceil(F.col("c") / PARTS_OPENED)).cast("int")
    units = pairs.join(n, ["ga", "pa"]).withColumn("run", run)
    unit = ["ga", "pa", "run"]
    ends = units.select(*unit, F.lit(0).alias("side"), F.col("ga").alias("gid"), F.col("pa").alias("part")).distinct()
    ends = ends.unionByName(units.select(*unit, F.lit(1).alias("side"), F.col("gb").alias("gid"), F.col("pb").alias("part")))
    placed = settle(ends.join(members, ["gid", "part"]), f"{name}-placed")
    wanted = placed.select("row").distinct()
    texts = docs.select("row", "text").join(_small(wanted), "row", "left_semi")
    sets = texts.select("text").mapInArrow(released(_set_rows), "sid long, shingles binary")
    opened = sets.join(_small(placed.drop("row")), "sid").groupBy(*unit).applyInArrow(_open, "a long, b long")
    return settle(opened, f"{name}-links")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``: a hash of both, which a row without id has as well."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def _first_row() -> Column:
    """The row of the smallest doc_id, one without id only where no other is."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when 100 * shared >= 75 * united distinct 5-word shingles; ``component_id`` is the
    smallest doc_id that links reach. Texts without words (NULL, empty, blank) link with nothing and
    keep their own id, repeated rows come back as often as they were given, rows without an
    id take part like others, and other columns are ignored. An empty table gives an empty table.
    """
    sets, labelled = _components(_named(docs))
    return sets.select("doc_id", "n", "sid").join(labelled, (sets.sid == labelled.sid) & (F.col("n") > 0), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, row, n, sid) of all rows, and sid, component, component_id of all sets with words."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(shingle_order(docs))
    keys = [f"k{j}" for j in range(MINHASHES)]
    schema = "doc_id long, row long, n long, sid long, " + ", ".join(f"{k} long" for k in keys) + ", prefix binary"
    sets = settle(docs.mapInArrow(released(_describe(order)), schema), "near-sets", TEXT_BATCHES)
    order.destroy()  # the sets are stored; nothing needs it again, on the driver neither
    worded = sets.where("n > 0")
    classes = settle(
        worded.groupBy("sid").agg(
            F.min("doc_id").alias("doc_id"), _first_row().alias("row"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in keys]
        ),
        "near-classes",
    )

    # Groups: each class against the smallest class with the same min-hash.
    by_key = classes.select("sid", "n", F.posexplode(F.array(*keys)).alias("j", "key"))
    heads = by_key.groupBy("j", "key").agg(
        F.min(F.struct("sid", "n")).alias("head"), F.count(F.lit(1)).alias("c")
    ).where("c > 1")
    fits = SHARED * F.least("n", "head.n") >= UNION * F.greatest("n", "head.n")
    # So many equal min-hashes are nearly certain for a link; what this leaves out comes later.
    stars = settle(
        by_key.join(heads, ["j", "key"]).where((F.col("sid") != F.col("head.sid")) & fits)
        .groupBy(F.col("head.sid").alias("ga"), F.col("sid").alias("gb"))
        .agg(F.count(F.lit(1)).alias("equal")).where(F.col("equal") >= EQUAL)
        .select("ga", F.lit(0).alias("pa"), "gb", F.lit(0).alias("pb"), "equal"),
        "near-stars",
    )
    alone = classes.select(F.col("sid").alias("gid"), F.lit(0).alias("part"), "sid", "row")
    first = _links(stars.drop("equal"), alone, docs, "near-star")
    groups = settle(connected_components(first), "near-groups")

    # Similar classes without a link form groups as well, around the class they resemble most.
    nearest = F.max_by("ga", F.struct("equal", -F.col("ga"))).alias("head")
    loose = stars.join(groups, stars.gb == groups.node, "left_anti").groupBy(F.col("gb").alias("sid")).agg(nearest)
    centres = loose.select(F.col("head").alias("sid"), "head").distinct()
    centres = centres.join(groups, centres.sid == groups.node, "left_anti").join(loose.select("sid"), "sid", "left_anti")
    even = F.lit(-2)  # the last bit says whether the members are linked
    grouped = groups.select(
        F.col("node").alias("sid"), F.xxhash64("component").bitwiseAND(even).bitwiseOR(F.lit(1)).alias("gid")
    ).unionByName(
        loose.unionByName(centres).select("sid", F.xxhash64("head", F.lit("similar")).bitwiseAND(even).alias("gid"))
    )
    # Parts of bounded number and like sizes, then the matrix.
    banded = grouped.join(classes.select("sid", "n"), "sid").withColumn(
        "band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.34))).cast("int")
    )
    sizes = banded.groupBy("gid", "band").agg(F.count(F.lit(1)).alias("c"))
    # A similar class alone in its band is a lone set like any other.
    shared = sizes.where("c > 1 or gid % 2 <> 0")
    parts = banded.join(shared, ["gid", "band"]).select(
        "sid", "gid",
        (F.col("band") * (1 << 24) + F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / PART))).cast("int").alias("part"),
    )
    parts = settle(parts, "near-parts-of-groups")
    cells = worded.select("sid", "n", "prefix").join(parts, "sid", "left").select(
        F.coalesce("gid", "sid").alias("gid"), "part", "n", "prefix"
    )
    total = worded.agg(F.sum(F.octet_length("prefix")).alias("b")).first()["b"] or 0
    buckets = max(64, total // 8 // POSTINGS_PER_BUCKET)
    met = (
        cells.mapInArrow(_cells(buckets), "bucket int, shingles binary, groups binary, sizes binary, spots binary")
        .groupBy("bucket").applyInArrow(
            _candidates, "ga long, gb long, sa int, sb int, pa int, pb int, cells long, la long, lb long"
        )
        .groupBy(*_PAIR).agg(F.sum("cells").alias("cells"), F.max("la").alias("la"), F.max("lb").alias("lb"))
    )
    inside = parts.where("gid % 2 = 0").groupBy("gid", "part").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    inside = inside.select(F.col("gid").alias("ga"), F.col("part").alias("pa"), F.col("gid").alias("gb"), F.col("part").alias("pb"))
    pairs = met.where(_may_link()).select("ga", "pa", "gb", "pb").distinct().unionByName(inside)
    members = classes.join(parts, "sid", "left").select(
        F.coalesce("gid", "sid").alias("gid"), F.coalesce("part", F.lit(0)).alias("part"), "sid", "row"
    )
    second = _links(pairs, members, docs, "near-open")

    joined = connected_components(first.unionByName(second))
    known = classes.join(joined, classes.sid == joined.node, "left").select(
        "sid", "doc_id", F.coalesce("component", "sid").alias("component")
    )
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return sets.select("doc_id", "row", "n", "sid"), known.join(least, "component").select("sid", "component", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near duplicates, with all their columns: one row of each component stays.

    It is the one with the smallest doc_id, a row without id only where the component has no other, and one of
    repeated rows. Rows whose texts have no words (NULL, empty, blank) are alike to nothing and all stay. Columns
    may have any name; an empty table gives an empty one.
    """
    sets, labelled = _components(_named(docs))
    worded = settle(sets.where("n > 0").join(labelled, "sid").select("doc_id", "row", "component"), "near-rows")
    first = worded.groupBy("component").agg(_first_row().alias("row"))
    own, kept, one = unused(docs.columns, "row", "kept", "one")
    stay = first.select("row", F.lit(True).alias(one)).unionByName(
        sets.where("n = 0").select("row", F.lit(False).alias(one)).distinct()
    ).withColumnRenamed("row", kept)
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = docs.withColumn(own, row)
    rows = marked.join(stay.hint("shuffle_hash"), F.col(own) == F.col(kept))
    if not worded.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.where(~F.col(one)).unionByName(rows.where(F.col(one)).dropDuplicates([own]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
