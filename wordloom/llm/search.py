"""Exact top-k search by inner product, term at a time.

Rows are sparse vectors of integer weights. Queries meet all other rows in blocks: rows are dealt
by hash over blocks of bounded size, queries over query blocks, and each pair of blocks is one task's
work. There the block's weights become postings by term; each query scatters its weight times the
postings of its terms into a dense array of scores, a partition selects the k best, and the blocks'
winners are merged by a ranked window that cuts to k before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.workdir import settle

BLOCK_ROWS = 2048
QUERY_ROWS = 2048


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; NULL where a component is NULL or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


def _postings(weights: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and weight of all weights other than 0, by term."""
    sizes = np.array([len(w) for w in weights], np.int64)
    flat = np.concatenate([np.asarray(w, np.int64) for w in weights]) if len(weights) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(weights)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(flat)
    order = some[np.argsort(term[some], kind="stable")]
    return term[order], row[order], flat[order]


def _search(k: int):
    def rows(key, queries, block):
        found: list[tuple] = []
        ids = np.array(block.column("id").to_pylist(), np.int64)
        term, row, weight = _postings(block.column("w").to_pylist())
        terms = int(term[-1]) + 1 if len(term) else 0
        first = np.searchsorted(term, np.arange(terms + 1))
        lists = [(row[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        # The whole block in one posting list needs no scatter by row.
        lists = [(slice(None) if len(r) == len(ids) else r, w) for r, w in lists]
        for query, own in zip(queries.column("id").to_pylist(), queries.column("w").to_pylist(), strict=True):
            scores = np.zeros(len(ids), np.int64)
            for t, w in enumerate(own[:terms]):
                if w:
                    at, posted = lists[t]
                    scores[at] += posted * w
            others = np.flatnonzero(ids != query)
            if len(others) > k:
                s = scores[others]
                least = np.partition(s, len(s) - k)[len(s) - k]
                others = others[s >= least]
            best = others[np.lexsort((ids[others], -scores[others]))][:k]
            found += [(query, int(ids[i]), int(scores[i])) for i in best]
        columns = zip(*found, strict=True) if found else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return rows


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query among all rows but the query's own id.

    ``rows`` and ``queries``: id (long), w (array of long; a shorter array ends in zeros). Rows without id
    or weights take no part. Repeated ids count once, with the largest array. Ties go to
    the smaller id. Returns query_id, rank (from 1), id, score; scores are exact 64-bit integers.
    """
    usable = F.col("id").isNotNull() & F.col("w").isNotNull()

    def once(df: DataFrame, name: str) -> DataFrame:
        return settle(df.where(usable).groupBy("id").agg(F.max("w").alias("w")), name)

    rows, queries = once(rows, "search-rows"), once(queries, "search-queries")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), every, "id", "w")

    right = dealt(rows, "block", blocks, "query_block", query_blocks).groupBy("block", "query_block")
    left = dealt(queries, "query_block", query_blocks, "block", blocks).groupBy("block", "query_block")
    best = left.cogroup(right).applyInArrow(_search(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
