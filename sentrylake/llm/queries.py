"""The operN queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, jaccard_join, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, spelling, token_counts, vector_codes, warc, wavelet
from ._shared import in_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(4, 2)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), training=~held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score_column(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"), in_fold(7, 2))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_packing,
        op4_fingerprints,
        op5_warc,
        op6_token_counts,
        op7_byte_bpe,
        op8_jaccard_join,
        op9_lm_scoring,
        op10_line_dedup,
        op11_wavelet_ids,
        op12_vector_codes,
        op13_spelling_variants,
    )
}

def codes_sql(rounds: int = 2) -> str:
    """op12: each round assigns every part to its nearest entry, then replaces the entries; the last only assigns."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT vec_id, label, p, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best
            FROM parts JOIN c{k} USING (p) GROUP BY vec_id, label, p, x
        ),""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (
            SELECT p, e, list(m ORDER BY i) AS c FROM (
                SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL
            ) GROUP BY p, e
        ),
        c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e)),""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS v, len(embedding) // 16 AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ),
        parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
        c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),{"".join(steps)}
        books AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{rounds})),
        codes AS (
            SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes, books
    """


#: SQL for the queries that it can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM r
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE steps AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ),
        runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ),
        often AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY ALL),
        sums AS (
            SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM often, steps
        ),
        slips AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM sums),
        v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        cut AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM places),
        wild AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM places),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
            UNION ALL SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.short
            UNION ALL SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.short
        ),
        best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
        forms AS MATERIALIZED (
            SELECT v.word, v.n, coalesce(any_value(n_near), 0) AS n_near, CASE WHEN any_value(most) >= 10 * v.n THEN min(near.other) END AS form, CASE WHEN any_value(most) >= 10 * v.n THEN any_value(most) END AS form_n
            FROM v LEFT JOIN best USING (word) LEFT JOIN near ON near.word = v.word AND near.n = best.most GROUP BY v.word, v.n
        ),
        walk AS (
            SELECT word, word AS last_word, form AS next FROM forms
            UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next
        )
        SELECT word, form, last_word AS root, n, n_near, form_n FROM forms JOIN (SELECT word, last_word FROM walk WHERE next IS NULL) USING (word)
    """,
    "op12_vector_codes": codes_sql(),
}
