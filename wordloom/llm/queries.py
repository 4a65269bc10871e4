"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, exact, mixing, near, ngrams, packing, resampling, search, spelling, tokenfiles, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), search.quantised(F.col("embedding")).alias("w")
    )
    found = search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "shard"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_files": op8_token_files,
    "op9_source_mixing": op9_source_mixing,
    "op10_warc": op10_warc,
    "op11_url_filters": op11_url_filters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

# The table of unsigned CRC-32 (polynomial 0xEDB88320), one entry for each byte; a CRC is a fold over a key's bytes.
_CRC_TABLE = """WITH RECURSIVE bits(i, c, k) AS (
            SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
            UNION ALL
            SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
        )"""


def _crc32(key: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes."""
    byte = f"CAST('0x' || substr(hex(encode({key})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_transform(range(0, strlen({key})), lambda i: {byte}), "
        "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295))"
    )


# op2, op3, op4, op5, op6, op8, op9's taken words and op11 have none: trained models, tokenizers, reachability
# over all pairs and a random draw. tests/llm holds them against brute-force versions instead.
ORACLES = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY text)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op12_conversation_repair": f"""
        {_CRC_TABLE}, keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), kinds AS (
            SELECT conv_id, turn, role, text, {_crc32("key")} % 20 AS kind FROM keyed, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM kinds
        ), placed AS (
            SELECT *, row_number() OVER c AS i, lag(role) OVER c AS role_before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
            FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), judged AS MATERIALIZED (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                           WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), inserted(s, k, edits, put, e) AS (
            SELECT s, 0, '', '', s FROM range(4) r(s)
            UNION ALL
            SELECT s, k + 1, edits || 'I', put || CASE WHEN e = 2 THEN 'assistant:' ELSE 'user:' END || chr(10),
                   CASE WHEN e = 2 THEN 3 ELSE 2 END
            FROM inserted WHERE k < 2
        ), ways(conv_id, i, s, best) AS (
            SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), struct_pack(cost := CAST(0 AS BIGINT), audit := '', put := '')
            FROM (SELECT DISTINCT conv_id FROM judged)
            UNION ALL
            SELECT conv_id, i, e, min(struct_pack(cost := cost, audit := audit, put := put))
            FROM (
                SELECT w.conv_id, j.i, o.e, w.best.cost + 3 * n.k + o.cost AS cost, w.best.audit || n.edits || o.edit AS audit,
                       w.best.put || n.put || o.put AS put
                FROM ways w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1
                JOIN inserted n ON n.s = w.s,
                LATERAL (
                    SELECT 4 AS cost, 'D' AS edit, '' AS put, n.e AS e
                    UNION ALL
                    SELECT CASE j.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', j.role || ':' || j.text || chr(10),
                           CASE left(j.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
                    WHERE j.fault NOT IN ('blank', 'duplicate')
                      AND (left(j.role, 1) = 's' AND n.e = 0 OR left(j.role, 1) = 'u' AND n.e <> 2 OR left(j.role, 1) = 'a' AND n.e = 2)
                    UNION ALL
                    SELECT CASE j.fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R',
                           CASE WHEN n.e = 2 THEN 'assistant:' ELSE 'user:' END || j.text || chr(10),
                           CASE WHEN n.e = 2 THEN 3 ELSE 2 END
                    WHERE j.fault NOT IN ('blank', 'duplicate')
                ) o
            )
            GROUP BY conv_id, i, e
        ), faults AS (
            SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        ), ended AS (
            SELECT f.conv_id, min(struct_pack(cost := w.best.cost + 3 * n.k, audit := w.best.audit || n.edits, put := w.best.put || n.put)) AS best
            FROM faults f JOIN ways w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n
            JOIN inserted n ON n.s = w.s WHERE n.e IN (0, 3) GROUP BY f.conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
               coalesce(best.audit, '') AS audit,
               sha256(coalesce(left(best.put, length(best.put) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_spelling_variants": f"""
        {_CRC_TABLE}, runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), counted AS (
            SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key
            FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
        ), hashed AS (
            SELECT run, n, {_crc32("key")} AS h
            FROM counted, crc
        ), typed AS (
            SELECT CASE WHEN h % 199 = 0
                        THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                        ELSE run END AS word, n
            FROM hashed
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), gaps AS MATERIALIZED (
            SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
        ), pairs AS (
            SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
            UNION
            SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(struct_pack(other := other, m := m) ORDER BY m DESC, other) AS top
            FROM pairs GROUP BY word
        ), linked AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN top.m >= 5 * w.n THEN top.other END AS form, CASE WHEN top.m >= 5 * w.n THEN top.m END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), chain(word, here) AS (
            SELECT word, word FROM linked
            UNION ALL
            SELECT c.word, l.form FROM chain c JOIN linked l ON c.here = l.word WHERE l.form IS NOT NULL
        )
        SELECT l.word, l.form, c.here AS root, l.n, l.n_near, l.form_n
        FROM linked l JOIN chain c USING (word) JOIN linked e ON e.word = c.here WHERE e.form IS NULL
    """,
}
