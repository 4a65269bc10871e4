"""N-gram language model in a log-frequency Bloom filter.

The counts of unigrams and bigrams of all training texts are gathered by hash bucket, a slice of the
filter is built in each, and the slices together are broadcast. An n-gram of count c is inserted once for
each level up to c (1, 2, 3, 4, 6, 8, 12, ...); probing level after level until one is missing gives
a lower bound of its count, with a small chance of one level more. The part that is broadcast has a
fixed size. It takes the n-grams by falling count, as many as keep its error rate: the least level that
enters, and is probed first, follows from the counts of all. The n-grams below that level enter the
rest of the filter, a slice per bucket of the size they need, which stays in the shared folder. What
a chunk of texts does not find in the broadcast is asked there once, by bucket, and the tokens that
wait for it are scored when the answers are back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.workdir import settle
from .words import hashed_words, mix, seeds, slices

FILTER_BYTES = 32 << 20
BITS_PER_ENTRY = 9
PROBES = 5
SLICES = 64
TEXTS_PER_BUCKET = 20_000
HEAD = 1 << 19
CHUNK = 1_000_000
SCORED_BYTES = 1 << 20  # of text scored together: bounds the arrays per token
FOLDS = 7
HELD_OUT = 2

_U = np.uint64
_DROPPED = _U(16)  # bits of a hash that are not asked for
_SALTS = seeds(4, 31337)
END = mix(np.array([0xE4D], _U))[0]
START = mix(np.array([0x57A47], _U))[0]

LEVELS = np.unique(np.concatenate([[2**i, 3 * 2**i] for i in range(40)])).astype(np.int64)
# Weight of a bigram's relative frequency: from a first word seen once to one seen 2 ** 14 times or more.
_RARE, _OFTEN = 0.3, 0.7
# In place of a level: the n-gram is asked for in the rest of the filter; the start of a text.
_ASKED, _FIRST = 254, 255
_LEAST = np.concatenate(([0], LEVELS))  # least and greatest count of each level
_MOST = np.concatenate(([0], LEVELS[1:] - 1, [np.iinfo(np.int64).max]))


def with_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with one end token after each, and the number of tokens of each."""
    words, counts, first = hashed_words(texts)
    out = np.full(len(words) + len(counts), END, _U)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, counts + 1


def bigrams(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token, and the hash of both."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = START
    return before, mix(before * _SALTS[0] + tokens * _SALTS[1])


def _count(buckets: int):
    """Counts of a task's n-grams, packed by bucket."""

    def packed(order: int, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams, n = np.unique(np.concatenate(values), return_counts=True)
        bucket = bucket_of(grams, buckets)
        spans, (grams, n) = by_bucket(bucket, [grams, n.astype(np.uint32)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in spans], pa.int32()), pa.array([order] * len(spans), pa.int32()),
                pa.array([grams[a:b].tobytes() for _, a, b in spans], pa.binary()),
                pa.array([n[a:b].tobytes() for _, a, b in spans], pa.binary()),
            ],
            names=["bucket", "n", "grams", "counts"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        waiting = 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, counts = with_ends(part.column("text"))
                held[0].append(tokens)
                held[1].append(bigrams(tokens, counts)[1])
                waiting += len(tokens)
                if waiting > CHUNK:
                    yield from packed(1, held[0])
                    yield from packed(2, held[1])
                    held, waiting = [[], []], 0
        if waiting:
            yield from packed(1, held[0])
            yield from packed(2, held[1])

    return rows


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram, from the part of its hash that is asked for."""
    return ((grams >> _DROPPED) % _U(buckets)).astype(np.int32)


def short_keys(grams: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash, six bytes a row: a false answer by them is far rarer than one of the filter."""
    return (grams >> _DROPPED).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_short(data: bytes) -> np.ndarray:
    """The numbers that rows of six bytes stand for."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(_U)


def planes(values: np.ndarray) -> bytes:
    """Rows of bytes, column by column: equal bytes lie together, so that files and shuffles compress them."""
    return np.ascontiguousarray(values.T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[tuple], list[np.ndarray]]:
    """Columns in the order of their bucket, and (bucket, start, end) of each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    spans = [(int(bucket[a]), a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return spans, [c[order] for c in columns]


def _sum(key, table):
    """Counts of one bucket and order over all tasks."""
    grams = np.frombuffer(b"".join(table.column("grams").to_pylist()), _U)
    n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    grams, n = grams[first], np.add.reduceat(n, first) if len(first) else n
    level = np.searchsorted(LEVELS, n, side="right")
    histogram = np.bincount(level, minlength=len(LEVELS) + 1).astype(np.int64)
    return pa.table(
        [
            pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
            pa.array([grams.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()),
            pa.array([histogram.tolist()], pa.list_(pa.int64())),
            pa.array([len(grams)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
        ],
        names=["bucket", "n", "grams", "counts", "levels", "distinct", "total"],
    )


_SUMS = "bucket int, n int, grams binary, counts binary, levels array<bigint>, distinct long, total long"


def _probe(keys: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    """The bit of the i-th probe for n-grams at a level."""
    one, two = (_U(level * int(salt) & 0xFFFFFFFFFFFFFFFF) for salt in _SALTS[2:])
    return (((mix(keys ^ one) + _U(i) * (mix(keys + two) | _U(1))) >> _U(20)) % _U(bits)).astype(np.int64)


def _slice(bits: int, least: dict[int, int]):
    """What one bucket adds to its slice of the filter: n-grams whose level is at least ``least``.

    The others make the bucket's slice of the rest.
    """

    def rows(key, table):
        out = np.zeros(bits, bool)
        below = []
        for row in table.to_pylist():
            own, salt = np.frombuffer(row["grams"], _U), _SALTS[row["n"] - 1]
            grams = own ^ salt
            level = np.searchsorted(LEVELS, np.frombuffer(row["counts"], np.int64), side="right")
            enters = level >= least[row["n"]]
            below.append(((own[~enters] >> _DROPPED) ^ salt, level[~enters]))
            grams, level = grams[enters], level[enters]
            for j in range(least[row["n"]], int(level.max(initial=0)) + 1):
                for i in range(PROBES):
                    out[_probe(grams[level >= j], j, i, bits)] = True
        rest = np.zeros(8 * (1 + BITS_PER_ENTRY * sum(int(level.sum()) for _, level in below) // 8), bool)
        for grams, level in below:
            for j in range(1, int(level.max(initial=0)) + 1):
                for i in range(PROBES):
                    rest[_probe(grams[level >= j], j, i, len(rest))] = True
        bucket = key[0].as_py()
        return pa.table(
            [
                pa.array([bucket], pa.int32()), pa.array([bucket % SLICES], pa.int32()),
                pa.array([np.packbits(out).tobytes()], pa.binary()), pa.array([np.packbits(rest).tobytes()], pa.binary()),
            ],
            names=["bucket", "slice", "bits", "rest"],
        )

    return rows


def _either(key, table):
    out = None
    for row in table.column("bits"):
        bits = np.frombuffer(row.as_py(), np.uint8)
        out = bits.copy() if out is None else np.bitwise_or(out, bits, out=out)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slice", "bits"])


def _levels(data: np.ndarray, row: np.ndarray | int, own: np.ndarray, bits: int, least: int, end: int) -> np.ndarray:
    """Level from ``least`` to below ``end`` of each n-gram, 0 when it is not there: probe until one is missing."""
    level = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    for j in range(least, end):
        if not len(live):
            break
        there = live
        keys = own[live]
        for i in range(PROBES):
            place = _probe(keys, j, i, bits)
            at = row[there] if isinstance(row, np.ndarray) else row
            hit = (data[at, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            there, keys = there[hit], keys[hit]
            if not len(there):
                break
        level[there] = j
        live = there
    return level


class Filter:
    """The part of the filter that is broadcast, in a worker."""

    def __init__(self, bits: int, data: np.ndarray, n_tokens: int, n_distinct: int, n_texts: int, least: dict[int, int]):
        self.least = least
        self.bits, self.data = bits, data  # data: one row per slice
        self.n_tokens, self.n_distinct, self.n_texts = n_tokens, n_distinct, n_texts

    def levels(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Level of each n-gram's count, 0 when it is not there."""
        bucket = bucket_of(grams, SLICES)
        return _levels(self.data, bucket, grams ^ _SALTS[order - 1], self.bits, self.least[order], len(LEVELS) + 1)


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of all unigrams and bigrams of ``docs`` (text), one row per bucket and order."""
    rows = docs.select("text").mapInArrow(_count(buckets), "bucket int, n int, grams binary, counts binary")
    return settle(rows.groupBy("bucket", "n").applyInArrow(_sum, _SUMS), "ngram-counts")


def level_totals(counts: DataFrame) -> tuple[dict[int, np.ndarray], int, int]:
    """Distinct n-grams by order and level, all tokens, distinct tokens; a few hundred rows."""
    by_level = counts.select("n", F.posexplode("levels").alias("level", "m")).groupBy("n", "level").agg(F.sum("m").alias("m"))
    levels = {n: np.zeros(len(LEVELS) + 1, np.int64) for n in (1, 2)}
    for row in by_level.collect():
        levels[row["n"]][row["level"]] = row["m"]
    ones = counts.where("n = 1").agg(F.sum("total").alias("t"), F.sum("distinct").alias("d")).first()
    return levels, ones["t"] or 0, ones["d"] or 0


def least_levels(levels: dict, filter_bytes: int = FILTER_BYTES) -> dict[int, int]:
    """The least level of each order that enters a filter of ``filter_bytes``."""
    room = filter_bytes * 8 // BITS_PER_ENTRY
    least, taken = {}, 0
    for n, limit in ((1, room // 2), (2, room)):
        # An n-gram of level k enters k - j + 1 times when j is the least level.
        entries = [int((levels[n][j:] * np.arange(1, len(levels[n]) - j + 1)).sum()) for j in range(len(levels[n]) + 1)]
        least[n] = next(j for j in range(1, len(entries)) if taken + entries[j] <= limit)
        taken += entries[least[n]]
    return least


def filter_parts(counts: DataFrame, least: dict[int, int], filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per bucket what it adds to the broadcast filter, and its slice of the rest."""
    bits = filter_bytes * 8 // SLICES
    return counts.select("bucket", "n", "grams", "counts").groupBy("bucket").applyInArrow(
        _slice(bits, least), "bucket int, slice int, bits binary, rest binary"
    )


def build_filter(counts: DataFrame, levels: dict, n_tokens: int, n_distinct: int, n_texts: int, filter_bytes: int = FILTER_BYTES, parts: DataFrame | None = None) -> Filter:
    """The filter that is broadcast, of ``filter_bytes`` whatever the corpus."""
    least = least_levels(levels, filter_bytes)
    parts = filter_parts(counts, least, filter_bytes) if parts is None else parts
    bits = filter_bytes * 8 // SLICES
    made = parts.select("slice", "bits").groupBy("slice").applyInArrow(_either, "slice int, bits binary").collect()  # filter_bytes in all
    data = np.zeros((SLICES, bits // 8), np.uint8)
    for row in made:
        data[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, data, n_tokens, n_distinct, n_texts, least)


def log_probabilities(own: np.ndarray, prior: np.ndarray, pair: np.ndarray, n_texts: int, denominator: int) -> np.ndarray:
    """log10 probability of every token after the one before it, from the levels of both and of the pair.

    The relative frequency of the bigram and that of the word with one added, mixed by how often the
    first word was seen. Counts are lower bounds in numerators and upper bounds in denominators,
    so the probabilities of all words after one sum to at most 1.
    """
    first = prior == _FIRST
    most = np.where(first, n_texts, _MOST[np.where(first, 0, prior)])
    level = np.where(first, np.searchsorted(LEVELS, max(n_texts, 1), side="right"), prior.astype(np.int64))
    plain = (_LEAST[own] + 1) / denominator
    seen = np.minimum(_LEAST[pair], np.minimum(_MOST[own], most))
    share = np.clip(_RARE + (_OFTEN - _RARE) * (level - 1) / 27, _RARE, _OFTEN)
    share = np.where(most > 0, share, 0.0)
    relative = np.where(most > 0, seen / np.maximum(most, 1), 0.0)
    return np.log10(share * relative + (1 - share) * plain)


def _asked(model: Filter, grams: np.ndarray, order: int, level: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams to ask the rest of the filter for, by bucket, and the place of each of ``grams`` among them."""
    which = np.flatnonzero(level == _ASKED) if model.least[order] > 1 else np.zeros(0, np.int64)
    which = which[np.argsort(bucket_of(grams[which], buckets), kind="stable")]
    place = np.zeros(len(grams), np.uint32)
    place[which] = np.arange(len(which))
    return grams[which], place


def _known(model: Filter, tokens: np.ndarray, counts: np.ndarray, buckets: int):
    """Levels of each token, the one before and both, the n-grams to ask for, and their place for each level."""
    before, pairs = bigrams(tokens, counts)
    words, at = np.unique(np.concatenate((tokens, before)), return_inverse=True)
    grams, to = np.unique(pairs, return_inverse=True)
    of_word, of_pair = model.levels(words, 1), model.levels(grams, 2)
    for order, level in ((1, of_word), (2, of_pair)):
        if model.least[order] > 1:
            level[level == 0] = _ASKED
    of_word[words == START] = _FIRST
    ask_words, word_place = _asked(model, words, 1, of_word, buckets)
    ask_pairs, pair_place = _asked(model, grams, 2, of_pair, buckets)
    own, prior = at[: len(tokens)], at[len(tokens) :]
    levels = np.stack((of_word[own], of_word[prior], of_pair[to]), axis=1).astype(np.uint8)
    places = np.stack((word_place[own], word_place[prior], pair_place[to] + np.uint32(len(ask_words))), axis=1)
    return levels, places, ask_words, ask_pairs


def _head(level: int):
    """Words of a bucket whose count has at least this level."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, _U) for x in batch.column("grams").to_pylist()]
            counts = [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
            many = [np.searchsorted(LEVELS, c, side="right") >= level for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[m].tobytes() for g, m in zip(grams, many, strict=True)], pa.binary()),
                    pa.array([c[m].tobytes() for c, m in zip(counts, many, strict=True)], pa.binary()),
                ],
                names=["grams", "counts"],
            )

    return rows


def _score(shared, buckets: int):
    """Per text: tokens, the model's score, the base score of frequent words, and the other words.

    Tokens that wait for the rest of the filter come with their levels; the first text of a chunk
    brings what its texts ask for.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, head_counts = shared.value
        denominator = model.n_tokens + 1 * (model.n_distinct + 1)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SCORED_BYTES):
                tokens, counts = with_ends(part.column("text"))
                text = np.repeat(np.arange(len(counts)), counts)
                levels, places, ask_words, ask_pairs = _known(model, tokens, counts, buckets)
                asks = levels == _ASKED
                waits = asks.any(axis=1)
                logs = log_probabilities(*np.where(asks, np.uint8(0), levels).T, model.n_texts, denominator)
                total = np.bincount(text, weights=np.where(waits, 0.0, logs), minlength=len(counts))
                levels, places, asks, waiting = levels[waits], places[waits], asks[waits], text[waits]
                parts = np.searchsorted(waiting, np.arange(len(counts) + 1)).tolist()
                before = np.concatenate(([0], np.cumsum(asks.sum(axis=1))))[parts].tolist()
                places = places[asks].astype("<u4").view(np.uint8).reshape(-1, 4)
                chunk += 1
                none = [b""] * (len(counts) - 1)
                words, at = np.unique(tokens, return_inverse=True)
                if len(head):
                    place = np.minimum(np.searchsorted(head, words), len(head) - 1)
                    found = head[place] == words
                    c = np.where(found, head_counts[place], 0)
                else:
                    found, c = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
                logs = np.where(found, np.log10((c + 1) / denominator), 0.0)
                known = found[at]
                rare = np.flatnonzero(~known)
                pair = np.stack((text[rare].astype(np.uint64), tokens[rare]))
                order = np.lexsort(pair[::-1])
                pair = pair[:, order]
                first = np.flatnonzero(np.concatenate(([True], np.any(pair[:, 1:] != pair[:, :-1], axis=0)))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare))).astype(np.uint32)
                owner, gram = pair[0, first].astype(np.int64), pair[1, first]
                cuts = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(counts.astype(np.int64)),
                        pa.array(np.bincount(text, weights=known, minlength=len(counts)).astype(np.int64)),
                        pa.array(np.bincount(text, weights=logs[at], minlength=len(counts))), pa.array(total),
                        pa.array([gram[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([times[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([chunk] * len(counts), pa.int64()),
                        pa.array([planes(levels[a:b]) for a, b in zip(parts[:-1], parts[1:], strict=True)], pa.binary()),
                        pa.array([planes(places[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)], pa.binary()),
                        pa.array([short_keys(ask_words).tobytes(), *none], pa.binary()), pa.array([short_keys(ask_pairs).tobytes(), *none], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "known", "base", "score", "grams", "times", "chunk", "levels", "places", "words", "pairs"],
                )

    return rows


def _rare(buckets: int):
    """The other words of a task's texts, packed by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, _U) for x in batch.column("grams").to_pylist()]
            if not sum(map(len, grams)):
                continue
            keys = np.repeat(np.array(batch.column("key").to_pylist(), np.int64), [len(g) for g in grams])
            times = np.concatenate([np.frombuffer(x, np.uint32) for x in batch.column("times").to_pylist()])
            gram = np.concatenate(grams)
            spans, columns = by_bucket(bucket_of(gram, buckets), [keys, gram, times])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in spans], pa.int32()),
                    *[pa.array([c[a:b].tobytes() for _, a, b in spans], pa.binary()) for c in columns],
                ],
                names=["bucket", "keys", "grams", "times"],
            )

    return rows


def _rare_sums(buckets: int, denominator: int):
    """Known words and base scores of the other words of one bucket, by text, packed by the text's bucket."""

    def rows(key, asked, counts):
        join = lambda c, kind: np.frombuffer(b"".join(asked.column(c).to_pylist()), kind)
        texts, grams, times = join("keys", np.int64), join("grams", _U), join("times", np.uint32).astype(np.int64)
        words = np.frombuffer(b"".join(counts.column("grams").to_pylist()), _U)
        n = np.frombuffer(b"".join(counts.column("counts").to_pylist()), np.int64)
        c = np.zeros(len(grams), np.int64)
        if len(words):
            place = np.minimum(np.searchsorted(words, grams), len(words) - 1)
            c = np.where(words[place] == grams, n[place], 0)
        own, at = np.unique(texts, return_inverse=True)
        known = np.bincount(at, weights=times * (c > 0), minlength=len(own)).astype(np.int64)
        base = np.bincount(at, weights=times * np.log10((c + 1) / denominator), minlength=len(own))
        spans, columns = by_bucket((mix(own) % _U(buckets)).astype(np.int32), [own, known, base])
        return pa.table(
            [
                pa.array([k for k, _, _ in spans], pa.int32()),
                *[pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary()) for x in columns],
            ],
            names=["bucket", "keys", "known", "base"],
        )

    return rows


_BY_CHUNK = "bucket int, n int, chunks binary, sizes binary, {} binary"


def _packed(target: np.ndarray, chunks: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Values by target, in runs of one chunk: target, chunks, lengths of runs, values."""
    order = np.lexsort((chunks, target))  # stable: the values of a chunk keep their order
    spans, (chunks, values) = by_bucket(target[order], [chunks[order], values[order]])
    for k, a, b in spans:
        own, sizes = np.unique(chunks[a:b], return_counts=True)
        yield k, own.tobytes(), sizes.astype(np.uint32).tobytes(), values[a:b].tobytes()


def _questions(buckets: int):
    """The n-grams that chunks ask for, packed by bucket."""

    def packed(n: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        chunks = np.repeat(np.array([c for c, _ in held], np.int64), [len(g) for _, g in held])
        grams = np.concatenate([g for _, g in held])
        bucket = (from_short(grams.tobytes()) % _U(buckets)).astype(np.int32)
        out = list(_packed(bucket, chunks, grams))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.int32()), pa.array([n] * len(out), pa.int32()),
                *[pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)],
            ],
            names=["bucket", "n", "chunks", "sizes", "grams"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        waiting = {1: 0, 2: 0}
        for batch in batches:
            for n, name in ((1, "words"), (2, "pairs")):
                for chunk, asked in zip(batch.column("chunk"), batch.column(name), strict=True):
                    grams = np.frombuffer(asked.as_py(), np.uint8).reshape(-1, 6)
                    if len(grams):
                        held[n].append((chunk.as_py(), grams))
                        waiting[n] += len(grams)
                    if waiting[n] > CHUNK:
                        yield packed(n, held[n])
                        held[n], waiting[n] = [], 0
        for n in (1, 2):
            if held[n]:
                yield packed(n, held[n])

    return rows


def _answers(buckets: int, least: dict[int, int]):
    """Levels of the n-grams asked of one bucket's slice of the rest, packed by the chunk's bucket."""

    def rows(key, asked, slices_):
        rest = slices_.column("rest").to_pylist()
        out = []
        for n in (1, 2) if rest else ():
            part = asked.filter(pc.equal(asked.column("n"), n))
            join = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)  # noqa: B023, E731
            chunks = np.repeat(join("chunks", np.int64), join("sizes", np.uint32))
            data = np.frombuffer(rest[0], np.uint8)[None, :]
            own = from_short(b"".join(part.column("grams").to_pylist())) ^ _SALTS[n - 1]
            level = _levels(data, 0, own, data.size * 8, 1, least[n])
            target = (mix(chunks) % _U(buckets)).astype(np.int32)
            out += [(k, n, *found) for k, *found in _packed(target, chunks, level.astype(np.uint8))]
        return pa.table(
            [
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
                *[pa.array([r[i] for r in out], pa.binary()) for i in (2, 3, 4)],
                pa.array([key[0].as_py()] * len(out), pa.int32()),
            ],
            names=["bucket", "n", "chunks", "sizes", "found", "asked"],
        )

    return rows


def _waiting(n_texts: int, denominator: int):
    """Scores of the tokens that waited, by text, for the chunks of one bucket."""

    def rows(key, texts, answers):
        sizes = [np.frombuffer(x, np.uint32) for x in answers.column("sizes").to_pylist()]
        found = np.frombuffer(b"".join(answers.column("found").to_pylist()), np.uint8)
        each = [int(s.sum()) for s in sizes]
        chunks = np.frombuffer(b"".join(answers.column("chunks").to_pylist()), np.int64)
        chunks = np.repeat(chunks, np.concatenate([*sizes, np.zeros(0, np.uint32)]))
        n, asked = (np.repeat(np.array(answers.column(c).to_pylist(), np.int64), each) for c in ("n", "asked"))
        order = np.lexsort((asked, n, chunks))  # as the chunk asked: words, then pairs, each by bucket
        chunks, found = chunks[order], found[order]
        own = np.array(texts.column("chunk").to_pylist(), np.int64)
        levels = [from_planes(x, 3) for x in texts.column("levels").to_pylist()]
        places = [from_planes(x, 4) for x in texts.column("places").to_pylist()]
        start = np.repeat(np.searchsorted(chunks, own), [len(x) for x in places])
        text = np.repeat(np.arange(len(own)), [len(x) for x in levels])
        level = np.concatenate([*levels, np.zeros((0, 3), np.uint8)])
        place = np.ascontiguousarray(np.concatenate([*places, np.zeros((0, 4), np.uint8)])).view("<u4").ravel()
        level[level == _ASKED] = found[start + place]
        logs = log_probabilities(*level.T, n_texts, denominator)
        more = np.bincount(text, weights=logs, minlength=len(own))
        return pa.table([texts.column("key"), pa.array(more, pa.float64())], names=["key", "waited"])

    return rows


def _bucket_of(buckets: int):
    """Adds the bucket of a text's chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column("chunk").to_numpy().astype(np.int64)
            yield batch.append_column("bucket", pa.array((mix(chunk) % _U(buckets)).astype(np.int32)))

    return rows


def _text_sums(key, table):
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    own, at = np.unique(join("keys", np.int64), return_inverse=True)
    known = np.bincount(at, weights=join("known", np.int64), minlength=len(own)).astype(np.int64)
    base = np.bincount(at, weights=join("base", np.float64), minlength=len(own))
    return pa.table([pa.array(own), pa.array(known), pa.array(base)], names=["key", "rare_known", "rare_base"])


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; a NULL id is
    learnt from. A NULL or empty text is its end token alone; repeated rows count and are scored
    each; other columns are ignored; an empty table gives an empty table. ``filter_bytes`` of the filter are
    broadcast, the rest is asked by bucket. The base score uses exact counts: those of frequent words
    are broadcast (HEAD words at most), all others are looked up by bucket.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("held_out", F.coalesce(fold == held_out, F.lit(False)))
    training = rows.where("not held_out")
    n_texts = training.count()
    buckets = SLICES * max(1, -(-n_texts // (SLICES * TEXTS_PER_BUCKET)))
    counts = counted(training, buckets)
    levels, n_tokens, n_distinct = level_totals(counts)
    denominator = n_tokens + 1 * (n_distinct + 1)
    bounds = least_levels(levels, filter_bytes)
    parts = filter_parts(counts, bounds, filter_bytes)
    whole = max(bounds.values()) == 1
    parts = parts if whole else settle(parts, "lm-filter")
    model = build_filter(counts, levels, n_tokens, n_distinct, n_texts, filter_bytes, parts)
    words = counts.where("n = 1").select("bucket", "grams", "counts")
    least = next(j for j in range(1, len(LEVELS) + 2) if int(levels[1][j:].sum()) <= HEAD)
    head = words.select("grams", "counts").mapInArrow(_head(least), "grams binary, counts binary").collect()
    head_words = np.frombuffer(b"".join(r["grams"] for r in head), _U)
    head_counts = np.frombuffer(b"".join(r["counts"] for r in head), np.int64)
    order = np.argsort(head_words)
    shared = spark.sparkContext.broadcast((model, head_words[order], head_counts[order]))
    schema = "doc_id long, n_tokens long, known long, base double, score double, grams binary, times binary"
    schema += ", chunk long, levels binary, places binary, words binary, pairs binary"
    scored = rows.select("doc_id", "text").mapInArrow(_score(shared, buckets), schema)
    # The key is stored with the row, so it stays the same whatever is computed again later.
    scored = settle(scored.withColumn("key", F.monotonically_increasing_id()), "lm-scores")
    asked = scored.select("key", "grams", "times").mapInArrow(_rare(buckets), "bucket int, keys binary, grams binary, times binary")
    sums = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(
        _rare_sums(buckets, denominator), "bucket int, keys binary, known binary, base binary"
    )
    rest = sums.groupBy("bucket").applyInArrow(_text_sums, "key long, rare_known long, rare_base double")
    zero = F.lit(0).cast("long")
    out = scored.drop("grams", "times", "chunk", "levels", "places", "words", "pairs").join(rest, "key", "left")
    score = F.col("score")
    if not whole:
        questions = scored.where("length(words) + length(pairs) > 0").select("chunk", "words", "pairs")
        questions = questions.mapInArrow(_questions(buckets), _BY_CHUNK.format("grams"))
        answers = questions.groupBy("bucket").cogroup(parts.select("bucket", "rest").groupBy("bucket")).applyInArrow(
            _answers(buckets, bounds), _BY_CHUNK.format("found") + ", asked int"
        )
        waiting = scored.where("length(levels) > 0").select("key", "chunk", "levels", "places")
        waiting = waiting.mapInArrow(_bucket_of(buckets), "key long, chunk long, levels binary, places binary, bucket int")
        waited = waiting.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
            _waiting(n_texts, denominator), "key long, waited double"
        )
        out = out.join(waited, "key", "left")
        score = (score + F.coalesce("waited", F.lit(0.0))).alias("score")
    return out.select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score,
    )
