"""The queries of the corpus operators, each over its whole table, and their SQL oracles where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat, embedding_join, exact_dedup, ngram_join, packing, pii, piece_codec, quality, sharding, url_lists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op2_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embedding_join.link(table(spark, sf_dir, "embeddings"))
    return linked.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


#: Bytes of a shard in the query: small, so that small tables are split too.
SHARD = 256 << 10


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign(table(spark, sf_dir, "documents"), limit=SHARD)
    return shards.select(F.col("id").alias("doc_id"), "shard", "depth", "shard_bytes", "shard_rows")


def op4_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"),
        quality.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        """SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
           FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    # the table has one layout; its conversations reach the operator in all those that can hold them
    records = chat.records_of_turns(turns, layouts=chat.LISTS)
    formatted = chat.format_records(records, id_col="id", record_col="record")
    return formatted.select(
        F.col("id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode(table(spark, sf_dir, "documents"), model, with_ids=False)
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def url_log(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of a table of pages by a rule on their MD5."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("h")).where("h <> ''").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("int"))
    n = F.col("n")

    def entry(pattern, action, after, used):
        day = F.date_add(F.lit("2023-01-01").cast("date"), after.cast("int"))
        return F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("day"), used.alias("used"))

    entries = F.array(
        entry(F.col("h"), "block", n % 600, n % 3 == 0),
        entry(F.col("h"), "remove", n % 600 + 30 + n % 200, n % 3 == 0),
        entry(F.regexp_replace("h", r"^[^.]*\.", ""), "block", n % 900, n % 5 == 1),
        entry(F.concat("h", F.lit("/en/")), "allow", n % 400, n % 2 == 0),
    )
    return hosts.select(F.inline(F.filter(entries, lambda e: e["used"]))).drop("used")


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["source"] == "base")
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.source = 'base' AND s.kind = '{k}')) AS long)").alias(f"n_{k}")
        for k in pii.KINDS
    ]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(pii.digest(base).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def op8_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.expr("date_add(date'2023-01-01', cast(page_id * 7919 % 1000 as int))"))
    judged = url_lists.judge(captures, url_log(pages))
    return judged.select("page_id", F.col("day").cast("string"), "verdict", "rule", F.col("since").cast("string"), "n_active")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link(table(spark, sf_dir, "documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_subspace_pigeonhole": op2_subspace_pigeonhole,
    "op3_extendible_sharding": op3_extendible_sharding,
    "op4_additive_quality": op4_additive_quality,
    "op5_chat_format": op5_chat_format,
    "op6_piece_codec": op6_piece_codec,
    "op7_contextual_pii": op7_contextual_pii,
    "op8_url_list_asof": op8_url_list_asof,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_best_two_fit": op10_best_two_fit,
}

ORACLES = {
    "op1_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op3_extendible_sharding": """
        WITH r AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits
            FROM documents),
        b AS (
            SELECT d.depth, r.bits >> (60 - d.depth) AS prefix, sum(size) AS size, count(*) AS n
            FROM r, range(0, 25) d(depth) GROUP BY ALL),
        leaves AS (
            SELECT r.doc_id, r.bits, min(b.depth) AS depth
            FROM r JOIN b ON r.bits >> (60 - b.depth) = b.prefix
            WHERE b.size <= 262144 OR b.n = 1 GROUP BY ALL)
        SELECT l.doc_id, l.depth::INT AS depth, b.size::BIGINT AS shard_bytes, b.n AS shard_rows,
               CASE WHEN l.depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(b.prefix), l.depth::INT) END AS shard
        FROM leaves l JOIN b ON b.depth = l.depth AND b.prefix = l.bits >> (60 - l.depth)
    """,
    "op5_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (
            SELECT *, length(regexp_replace(replace(role || chr(1) || text, '\\', '\\\\'),
                   '([<\\[])(/?s>|/?INST\\]|</?SYS>>)', '\\1#\\2', 'g')) - 1 AS chars
            FROM c),
        g AS (
            SELECT conv_id, count(*) AS n_turns, sum(chars + 9)::BIGINT AS formatted_chars,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                            FILTER (role = 'assistant'), '') AS loss
            FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, formatted_chars
        FROM g
    """,
    "op8_url_list_asof": """
        WITH p AS (
            SELECT page_id, url, DATE '2023-01-01' + (page_id * 7919 % 1000)::INT AS day,
                   regexp_replace(lower(regexp_extract(coalesce(url, ''),
                       '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 1)), '\\.$', '') AS h,
                   string_split(regexp_extract(coalesce(url, ''),
                       '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 2), '/') AS parts
            FROM pages),
        hosts AS (SELECT DISTINCT h, ('0x' || substr(md5(h), 1, 4))::INT AS n FROM p WHERE h <> ''),
        log AS (
            SELECT h AS pattern, 'block' AS action, DATE '2023-01-01' + n % 600 AS day FROM hosts WHERE n % 3 = 0
            UNION ALL SELECT h, 'remove', DATE '2023-01-01' + (n % 600 + 30 + n % 200) FROM hosts WHERE n % 3 = 0
            UNION ALL SELECT regexp_replace(h, '^[^.]*\\.', ''), 'block', DATE '2023-01-01' + n % 900 FROM hosts WHERE n % 5 = 1
            UNION ALL SELECT h || '/en/', 'allow', DATE '2023-01-01' + n % 400 FROM hosts WHERE n % 2 = 0),
        spans AS (
            SELECT pattern, action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day, action) AS until FROM log),
        live AS (SELECT * FROM spans WHERE action <> 'remove' AND (until IS NULL OR since < until)),
        k AS (
            SELECT p.page_id, p.url, p.day, unnest(list_distinct(list_concat(
                list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
                list_transform(range(2, len(parts)), lambda i: h || array_to_string(parts[1:i], '/') || '/')))) AS pattern
            FROM p WHERE h <> ''),
        m AS (
            SELECT k.page_id, k.url, k.day, l.*, count(*) OVER w AS n_active,
                   row_number() OVER (w ORDER BY length(l.pattern) DESC, l.pattern DESC) AS place
            FROM k JOIN live l ON l.pattern = k.pattern AND l.since <= k.day AND (l.until IS NULL OR k.day < l.until)
            WINDOW w AS (PARTITION BY k.page_id))
        SELECT p.page_id, p.day::VARCHAR AS day, coalesce(m.action, 'none') AS verdict, m.pattern AS rule,
               m.since::VARCHAR AS since, coalesce(m.n_active, 0) AS n_active
        FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.place = 1
    """,
    "op2_subspace_pigeonhole": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) >= 0.9 * a.norm * b.norm),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
               (SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
               (SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id) = e.vec_id AS kept
        FROM embeddings e
    """,
    "op9_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)
    """,
}
