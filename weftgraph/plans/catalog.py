"""Registered queries over the driver's tables, and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.config import ENTITY_LABELS, Settings
from weftgraph.functions import text
from weftgraph.operators import aggregate, chunks, extract, graph, rank, search, traverse
from weftgraph.plans import jobs, star_graph
from weftgraph.plans.hybrid import Hybrid
from weftgraph.plans.star_graph import table
from weftgraph.sources import files
from weftgraph.sources.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle if SQL can express it."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    graph.cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/weft-{name}-{uuid.uuid4().hex}"


def _with_graph(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{star_graph.SQL}{sql}"


# ---------------------------------------------------------------- vectors

COSINE_SQL = """
    vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
    sized AS (SELECT vec_id, label, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, x: a + x, 0.0::DOUBLE)) AS n FROM vecs),
    q AS (SELECT e, n FROM sized WHERE vec_id = 0),
    scored AS (
        SELECT s.vec_id, s.label, list_reduce(list_transform(list_zip(s.e, q.e), lambda z: z[1] * z[2]),
               lambda a, x: a + x, 0.0::DOUBLE) / (s.n * q.n) AS cos
        FROM sized s, q WHERE s.n * q.n > 0)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.array(F.concat(F.lit("Label"), F.col("label").cast("string"))).alias("labels")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", label, "label")


def _asked(spark: SparkSession, sf_dir: str, vec_id: int = 0):
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return search.query_vector(row[0])


def _score(name: str = "score"):
    return text.half_up(F.col("score"), 9).alias(name)


@query(f"WITH {COSINE_SQL} SELECT vec_id AS id, floor((1 + cos) / 2 * 1e9 + 0.5) / 1e9 AS score FROM scored ORDER BY cos DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    found = search.vector_search(_vectors(spark, sf_dir), _asked(spark, sf_dir), top_k=10, threshold=0.0)
    return found.select("id", _score())


@query(f"""WITH {COSINE_SQL}, top AS (SELECT * FROM scored ORDER BY cos DESC, vec_id LIMIT 50)
    SELECT vec_id AS id, label, floor(cos * 1e9 + 0.5) / 1e9 AS score FROM top WHERE cos >= 0.1 AND label IN (1, 3)""")
def vector_topk_label_filter(spark, sf_dir):
    found = search.vector_search(
        _vectors(spark, sf_dir), _asked(spark, sf_dir), top_k=50, threshold=0.1, labels=["label1", "LABEL3"], scale="raw"
    )
    return found.select("id", "label", _score())


@query(f"""WITH {COSINE_SQL} SELECT vec_id AS id, floor(cos * 1e9 + 0.5) / 1e9 AS score FROM scored
    WHERE label IN (1, 3) AND cos >= 0.0 ORDER BY cos DESC, vec_id LIMIT 10""")
def vector_topk_prefilter(spark, sf_dir):
    found = search.vector_search(
        _vectors(spark, sf_dir), _asked(spark, sf_dir), top_k=10, threshold=0.0, labels=["Label1", "Label3"], prefilter=True, scale="raw"
    )
    return found.select("id", _score())


@query(f"""WITH {COSINE_SQL}, top AS (SELECT * FROM scored ORDER BY cos DESC, vec_id LIMIT 6)
    SELECT vec_id AS id, floor((1 + cos) / 2 * 1e9 + 0.5) / 1e9 AS score FROM top
    WHERE vec_id <> 0 AND (1 + cos) / 2 >= 0.5 ORDER BY cos DESC, vec_id LIMIT 5""")
def vector_similar_excl_self(spark, sf_dir):
    nodes = _vectors(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    found = search.similar_entities(nodes, "0", top_k=5)
    return found.select(F.col("id").cast("long").alias("id"), _score())


@query(f"""WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS place FROM scored)
    SELECT label, vec_id AS id, place, floor(cos * 1e9 + 0.5) / 1e9 AS score FROM r WHERE place <= 3""")
def vector_batch_topk_per_label(spark, sf_dir):
    scored = search.vector_scores(_vectors(spark, sf_dir), _asked(spark, sf_dir), scale="raw")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id")).cast("long")
    return scored.withColumn("place", place).where("place <= 3").select("label", "id", "place", _score())


@query("""WITH h AS (SELECT doc_id, text, contains(lower(text), 'license')::INT + contains(lower(text), 'version')::INT
            + contains(lower(text), 'public')::INT + contains(lower(text), 'apache')::INT AS hits FROM documents)
    SELECT doc_id, hits, hits / 4.0::DOUBLE AS score FROM h WHERE hits >= 2 ORDER BY score DESC, doc_id LIMIT 8""")
def keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = search.keyword_search(docs, [" License", "version", "of", "PUBLIC", "apache", "license"], id_col="doc_id")
    return found.select("doc_id", "hits", "score")


BM25_SQL = """
    d AS (SELECT 'P' || p_partkey AS id, p_name AS name, p_type AS description,
                 regexp_extract_all(lower(concat_ws(' ', p_name, p_type)), '[a-z0-9]+') AS w FROM part),
    q AS (SELECT unnest(['blue', 'bolt', 'economy']) AS word),
    t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    f AS (SELECT word, count(*) FILTER (list_contains(d.w, word)) AS df FROM q, d GROUP BY word),
    s AS (SELECT d.id, len(list_filter(d.w, lambda x: x = f.word)) AS tf, len(d.w) AS size,
                 ln(1 + (t.n - f.df + 0.5) / (f.df + 0.5)) AS rare, t.mean FROM d, f, t)
    SELECT id, floor(sum(rare * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) * 1e6 + 0.5) / 1e6 AS score
    FROM s GROUP BY id HAVING sum(tf) > 0 ORDER BY score DESC, id LIMIT 5
"""


@query("WITH " + BM25_SQL)
def fulltext_bm25(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.array(F.lit("Part")).alias("labels"),
    )
    scored = search.name_search(parts, "Blue bolt, ECONOMY", limit=5)
    return scored.select("id", text.half_up(F.col("score"), 6).alias("score"))


# ---------------------------------------------------------------- texts and chunks

NORM_SQL = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha1({NORM_SQL})[1:16] AS fingerprint, length({NORM_SQL}) AS chars FROM documents")
def text_normalize_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.fingerprint("text").alias("fingerprint"), F.length(text.normalize("text")).cast("long").alias("chars"))


WINDOWS_SQL = """
    w AS (SELECT doc_id, source, unnest(range(0, greatest(length(text) - 200, 1), 1800)) AS start, text FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, source, start // 1800 AS piece, text[start + 1:start + 2000] AS raw FROM w),
    n AS (SELECT doc_id, source, piece, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM c),
    k AS (SELECT *, sha1(text)[1:16] AS fp FROM n WHERE length(text) >= 1)
"""


def _windows(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_file"), F.col("doc_id").alias("page"))
    return chunks.fixed_windows(pages, 2000, 200)


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, piece::INT AS piece, length(raw) AS chars, md5(raw) AS digest FROM c")
def chunk_fixed_window(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "piece", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"""WITH {WINDOWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id, piece) AS copy FROM k)
    SELECT doc_id, piece::INT AS piece, source, fp AS content_fingerprint, length(text) AS char_count FROM f WHERE copy = 1""")
def chunk_dedup_in_source(spark, sf_dir):
    kept = chunks.clean(_windows(spark, sf_dir))
    return kept.select("doc_id", "piece", F.col("source_file").alias("source"), "content_fingerprint", F.col("char_count").cast("long").alias("char_count"))


@query(f"""WITH {WINDOWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id, piece) AS copy FROM k),
    i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, piece) - 1 AS idx FROM f WHERE copy = 1)
    SELECT source || '#p' || doc_id || ':c' || idx || ':' || substr(md5(text), 1, 12) AS id, idx::INT AS chunk_index FROM i""")
def chunk_ids(spark, sf_dir):
    return chunks.number(chunks.clean(_windows(spark, sf_dir))).select("id", "chunk_index")


@query(f"""WITH {WINDOWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id, piece) AS copy FROM k)
    SELECT doc_id, piece::INT AS piece, fp AS content_fingerprint FROM f WHERE copy = 1""")
def chunk_dedup_global(spark, sf_dir):
    every = chunks.clean(_windows(spark, sf_dir), Settings(dedup_within_file=False))
    return chunks.across_files(every, ["doc_id", "piece"]).select("doc_id", "piece", "content_fingerprint")


@query(f"""SELECT doc_id, sha1({NORM_SQL})[1:16] AS content_fingerprint FROM documents WHERE sha1({NORM_SQL}) NOT IN
    (SELECT sha1({NORM_SQL}) FROM documents WHERE source = 'src0')""")
def known_chunk_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("content_fingerprint", text.fingerprint("text"))
    return chunks.without_known(docs, docs.where("source = 'src0'")).select("doc_id", "content_fingerprint")


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4096) END AS chunks FROM documents")
def chunk_count_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_chunks(F.octet_length("text"), 2000).alias("chunks"))


@query()
def recursive_splitter(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.split(pages).select("doc_id", "piece", F.length("text").alias("chars"), F.md5("text").alias("digest"))


DESCRIPTION_SQL = """
    p AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+', 0) AS name FROM documents),
    h AS (SELECT *, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'),
              lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
              lambda s: contains(lower(s), lower(name)) AND length(s) > 20) AS hits FROM p),
    d AS (SELECT doc_id, text, name, CASE WHEN name = '' OR len(hits) = 0 THEN '' WHEN length(hits[1]) <= 200 THEN hits[1]
                 ELSE regexp_replace(hits[1][1:200], ' [^ ]*$', '') || '...' END AS description FROM h)
"""


def _named(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"))
    return docs.withColumn("description", text.entity_description("name", "text"))


@query(f"WITH {DESCRIPTION_SQL} SELECT doc_id, name, description FROM d")
def entity_description(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", "name", "description")


@query(f"""WITH {DESCRIPTION_SQL} SELECT doc_id, round(least(0.95, 0.5 + CASE WHEN name <> '' THEN 0.15 ELSE 0 END
      + CASE WHEN description <> '' THEN 0.15 ELSE 0 END + CASE WHEN length(description) >= 40 THEN 0.05 ELSE 0 END
      + CASE WHEN name <> '' AND contains(lower(text), lower(name)) THEN 0.1 ELSE 0 END), 3)::DOUBLE AS confidence FROM d""")
def node_confidence(spark, sf_dir):
    made = text.node_confidence("name", "name", "description", "text")
    return _named(spark, sf_dir).select("doc_id", made.alias("confidence"))


@query("""WITH u AS (
        SELECT page_id, url AS raw FROM pages UNION ALL SELECT 1000000 + doc_id, text FROM documents),
    t AS (SELECT page_id, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM u),
    g AS (SELECT *, starts_with(s, 'http://') OR starts_with(s, 'https://') AS is_url,
                 list_filter(string_split(s, '/'), lambda p: length(p) > 3 AND NOT starts_with(p, 'http')) AS parts FROM t),
    n AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN is_url AND len(parts) > 0 THEN translate(parts[-1], '-_', '  ') ELSE s END,
                 'https?://\\S+', '', 'g'), 'www\\.\\S+', '', 'g') AS v FROM g),
    w AS (SELECT *, CASE WHEN contains(v[1:50], ' ') THEN regexp_replace(v[1:50], ' [^ ]*$', '') ELSE v[1:50] END AS cut FROM n),
    c AS (SELECT *, trim(regexp_replace(CASE WHEN length(v) <= 50 THEN v WHEN contains(v[1:50], ':') THEN string_split(v, ':')[1]
                 WHEN contains(v[1:50], ' - ') THEN string_split(v, ' - ')[1] WHEN contains(v[1:50], '''') THEN v
                 WHEN ends_with(cut, '...') THEN cut ELSE cut || '...' END, '\\s+', ' ', 'g')) AS name FROM w)
    SELECT page_id AS id, CASE WHEN coalesce(raw, '') = '' THEN 'Unknown' WHEN is_url AND len(parts) = 0 THEN 'External Link'
           WHEN name = '' THEN 'Unknown' ELSE name END AS name FROM c""")
def clean_node_name(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("raw"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000000).alias("id"), F.col("text").alias("raw"))
    return urls.unionByName(docs).select("id", text.node_name("raw").alias("name"))


STOP_SQL = "['" + "', '".join(text.OVERLAP_STOPWORDS) + "']"
KEY_SQL = "['" + "', '".join(text.KEYWORD_STOPWORDS) + "']"


@query(f"""WITH b AS (SELECT text FROM benchmark WHERE item_id = 0),
    t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS r,
                 list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS l
          FROM documents d, b)
    SELECT doc_id, CASE WHEN len(l) > 0 AND len(r) > 0 THEN floor(len(list_intersect(l, r)) / len(l) * 1e9 + 0.5) / 1e9 ELSE 0 END::DOUBLE AS overlap FROM t""")
def token_overlap_stop(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]
    return table(spark, sf_dir, "documents").select("doc_id", text.half_up(text.token_overlap(F.lit(asked), "text"), 9).alias("overlap"))


@query("""WITH t AS (SELECT c_custkey, list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9]+')) AS r,
             list_distinct(regexp_extract_all('customer 000000007 of building', '[a-z0-9]+')) AS l FROM customer)
    SELECT c_custkey, CASE WHEN len(r) > 0 THEN floor(len(list_intersect(l, r)) / len(l) * 1e9 + 0.5) / 1e9 ELSE 0 END::DOUBLE AS overlap FROM t""")
def token_overlap_plain(spark, sf_dir):
    asked = F.lit("Customer 000000007 of Building")
    return table(spark, sf_dir, "customer").select("c_custkey", text.half_up(text.plain_overlap(asked, "c_name"), 9).alias("overlap"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\\\\\-]{{2,}}'),
                     lambda x: NOT list_contains({KEY_SQL}, x)) AS k FROM conversations),
    p AS (SELECT conv_id, turn, unnest(k) AS w, generate_subscripts(k, 1) AS idx FROM t),
    o AS (SELECT conv_id, turn, w, min(idx) AS idx FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY idx) AS place FROM o)
    SELECT c.conv_id, c.turn, coalesce(string_agg(r.w, ' ' ORDER BY r.idx), '') AS keywords
    FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.place <= 10 GROUP BY ALL""")
def query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_keywords("text"), " ").alias("keywords"))


def _signals_sql(phrases):
    return " OR ".join(f"contains(lower(text), '{p}')" for p in phrases)


@query(f"""SELECT conv_id, turn, NOT ({_signals_sql(text.SPLIT_SIGNALS)}) AS single_intent, ({_signals_sql(text.NUMERIC_SIGNALS)}) AS numeric_focus,
    ({_signals_sql(text.UNGROUNDED_MARKERS)}) AS ungrounded FROM conversations""")
def question_signals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.single_intent("text").alias("single_intent"), text.numeric_focus("text").alias("numeric_focus"),
        text.ungrounded_answer("text").alias("ungrounded"),
    )


@query("""SELECT p_partkey, CASE WHEN coalesce(p_type, '') <> '' THEN p_name || ': ' || p_type ELSE p_name END AS embedding_text,
    CASE WHEN p_size >= 10 THEN p_name || ' p.' || (p_size - 9) ELSE p_name END AS source FROM part""")
def embedding_and_source_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.embedding_text("p_name", "p_type").alias("embedding_text"), text.chunk_source("p_name", F.col("p_size") - 10).alias("source")
    )


# ---------------------------------------------------------------- the graph and its maintenance


@query("""WITH l AS (SELECT n_nationkey, ['Aimodel', 'Aicompany', 'Usecase', 'Paper', n_name][n_nationkey % 5 + 1] AS label FROM nation)
    SELECT n_nationkey, CASE label WHEN 'Aimodel' THEN 'AIModel' WHEN 'Aicompany' THEN 'AICompany' WHEN 'Usecase' THEN 'UseCase' ELSE label END AS normalized,
           CASE label WHEN 'Aimodel' THEN 'AIModel' WHEN 'Aicompany' THEN 'AICompany' WHEN 'Usecase' THEN 'UseCase' ELSE label END AS canonical FROM l""")
def label_normalize(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Aimodel", "Aicompany", "Usecase", "Paper")], F.col("n_name"))
    label = F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array(label).alias("labels"))
    out = graph.canonical_labels(rows)
    again = text.canonical_label(F.concat(F.lit(" "), F.upper(F.element_at(rows.labels, 1))), ENTITY_LABELS)
    both = rows.select("n_nationkey", F.when(F.element_at("labels", 1).isin("Aimodel", "Aicompany", "Usecase", "Paper"), again)
                       .otherwise(F.element_at("labels", 1)).alias("canonical"))
    return out.select("n_nationkey", F.element_at("labels", 1).alias("normalized")).join(both, "n_nationkey")


@query(_with_graph("""SELECT r.src, r.dst, r.type, d.source AS source_file, 'D' || d.doc_id AS source_chunk,
    length(d.text[1:500]) AS chars, CASE r.type WHEN 'MENTIONS' THEN 0.58 ELSE 0.7 END::DOUBLE AS confidence
    FROM rels r JOIN documents d ON r.src = 'D' || d.doc_id"""))
def relationship_backfill(spark, sf_dir):
    g = star_graph.star_graph(spark, sf_dir)
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("source_file", "string"), ("source_chunk", "string"), ("source_chunk_text", "string"),
             ("confidence", "double"), ("extracted_at", "timestamp"))]
    filled = graph.backfill_document_edges(g.with_(relationships=g.relationships.select("*", *blank)), F.lit("2024-01-01").cast("timestamp"))
    hit = filled.where("source_chunk IS NOT NULL")
    return hit.select("src", "dst", "type", "source_file", "source_chunk", F.length("source_chunk_text").cast("long").alias("chars"), "confidence")


@query(_with_graph("""SELECT r.type, coalesce(CASE WHEN a.label = 'Customer' THEN a.name END, CASE WHEN b.label = 'Customer' THEN b.name END,
        'unknown') AS source_file, coalesce(CASE WHEN a.label = 'Supplier' THEN a.name END, CASE WHEN b.label = 'Supplier' THEN b.name END) AS source_chunk,
        0.68::DOUBLE AS confidence, count(*) AS n FROM rels r
    JOIN ents a ON a.id = r.src JOIN ents b ON b.id = r.dst GROUP BY ALL"""))
def entity_edge_backfill(spark, sf_dir):
    g = star_graph.star_graph(spark, sf_dir)
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("source_file", "string"), ("source_chunk", "string"), ("confidence", "double"), ("extracted_at", "timestamp"))]
    of = lambda label: F.when(F.array_contains("labels", label), F.col("name"))
    ents = g.entities.select("*", of("Customer").alias("source_document"), of("Supplier").alias("source_chunk"))
    filled = graph.backfill_entity_edges(g.with_(entities=ents, relationships=g.relationships.select("*", *blank)), F.lit("2024-01-01").cast("timestamp"))
    hit = filled.where("confidence IS NOT NULL")
    return hit.groupBy("type", "source_file", "source_chunk", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(_with_graph("SELECT label AS labels, count(*) AS count FROM nodes GROUP BY label ORDER BY count(*) DESC, label LIMIT 15"))
def graph_label_counts(spark, sf_dir):
    counted = graph.label_counts(star_graph.star_graph(spark, sf_dir).nodes)
    return counted.select(F.array_join("labels", ",").alias("labels"), "count")


@query(_with_graph("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM rels) AS relationships, (SELECT count(*) FROM ents WHERE name IS NOT NULL) AS embedded"))
def graph_stats(spark, sf_dir):
    g = star_graph.star_graph(spark, sf_dir)
    g = g.with_(entities=g.entities.withColumn("embedding", F.when(F.col("name").isNotNull(), F.array(F.lit(0.0)))))
    s = graph.statistics(g)
    named = [s[k].select(F.col("count").alias(k)) for k in ("nodes", "relationships", "embedded")]
    return named[0].crossJoin(named[1]).crossJoin(named[2])  # three frames of one row each


@query(_with_graph(""", n AS (SELECT label, coalesce(name, id) AS name, row_number() OVER (PARTITION BY label ORDER BY coalesce(name, id)) AS place
        FROM (SELECT DISTINCT label, coalesce(name, id) AS name, NULL AS id FROM ents)),
    c AS (SELECT label, count(*) AS mentions FROM ents GROUP BY label)
    SELECT c.label AS community, c.mentions, string_agg(n.name, '|' ORDER BY n.name) AS exemplars FROM c JOIN n ON n.label = c.label AND n.place <= 5
    GROUP BY ALL ORDER BY mentions DESC, community LIMIT 5"""))
def community_signals(spark, sf_dir):
    found = aggregate.communities(star_graph.entities(spark, sf_dir))
    return found.select("community", "mentions", F.array_join("exemplars", "|").alias("exemplars"))


@query("""WITH f AS (SELECT lang AS name FROM documents UNION ALL SELECT source FROM documents),
    e AS (SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT DISTINCT name FROM f))
    SELECT 'MENTIONS' AS relationship, (SELECT count(*) FROM f) AS frequency, string_agg(name, '|' ORDER BY name) AS examples FROM e WHERE place <= 4""")
def global_facts(spark, sf_dir):
    found = aggregate.global_facts(star_graph.star_graph(spark, sf_dir), excluded=())
    return found.select("relationship", "frequency", F.array_join("examples", "|").alias("examples"))


@query("""SELECT 'D' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)""")
def missing_embedding_antijoin(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("D"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return graph.without_embedding(star_graph.documents(spark, sf_dir).select("id"), stored)


@query(_with_graph(""", new AS (SELECT 'C' || c_custkey AS id, NULL AS name, c_mktsegment AS description FROM customer
        UNION ALL SELECT 'X' || n_nationkey, n_name, 'new' FROM nation)
    SELECT coalesce(e.id, n.id) AS id, coalesce(n.name, e.name) AS name, n.description FROM ents e FULL JOIN new n ON n.id = e.id"""))
def graph_upsert(spark, sf_dir):
    g = star_graph.star_graph(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("name"),
        F.col("c_mktsegment").alias("description"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("new").alias("description")
    )
    new = g.with_(entities=customers.unionByName(nations))
    return graph.upsert(g, new).entities.select("id", "name", "description")


# ---------------------------------------------------------------- traversal


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _neighbors_sql(condition: str, edges: str = "und") -> str:
    return _with_graph(f"""SELECT DISTINCT n.id, coalesce(n.name, n.id) AS name, n.label AS labels, e.type AS relationship
        FROM {edges} e JOIN nodes n ON n.id = e.dst WHERE {condition}""")


def _shown(found):
    return found.select("id", "name", F.array_join("labels", ",").alias("labels"), "relationship")


@query(_neighbors_sql("e.src = 'S1' AND e.type <> 'MENTIONS' AND n.id <> 'S1'"))
def neighbors_1hop(spark, sf_dir):
    return _shown(traverse.neighbors(star_graph.star_graph(spark, sf_dir), _seeds(spark, "S1"), limit=None))


@query(_neighbors_sql("e.src = 'O1'", "rels"))
def neighbors_out(spark, sf_dir):
    return _shown(traverse.neighbors(star_graph.star_graph(spark, sf_dir), _seeds(spark, "O1"), direction="out", limit=None))


@query(_neighbors_sql("e.src = 'R1'", "(SELECT dst AS src, src AS dst, type FROM rels)"))
def neighbors_in(spark, sf_dir):
    return _shown(traverse.neighbors(star_graph.star_graph(spark, sf_dir), _seeds(spark, "R1"), direction="in", limit=None))


@query(_neighbors_sql("e.src = 'N3' AND e.type = 'LOCATED_IN'"))
def neighbors_typed(spark, sf_dir):
    return _shown(traverse.neighbors(star_graph.star_graph(spark, sf_dir), _seeds(spark, "N3"), types=["LOCATED_IN"], limit=None))


def _reach_sql(seeds: str, depth: int, edges: str, rest: str) -> str:
    return _with_graph(f""", adj AS (SELECT DISTINCT src, dst FROM ({edges})),
        walk AS (SELECT unnest([{seeds}]) AS seed, unnest([{seeds}]) AS id, 0 AS hop
                 UNION SELECT w.seed, a.dst, w.hop + 1 FROM walk w JOIN adj a ON a.src = w.id WHERE w.hop < {depth}),
        reach AS (SELECT seed, id, min(hop) AS dist FROM walk GROUP BY ALL)
        {rest}""", recursive=True)


@query(_reach_sql("'C1'", 3, "SELECT * FROM und WHERE type IN ('PLACED', 'CONTAINS')", "SELECT id, dist FROM reach"))
def khop_distances(spark, sf_dir):
    excluded = ("SUPPLIED_BY", "LOCATED_IN", "PART_OF", "MENTIONS")
    return traverse.distances(star_graph.relationships(spark, sf_dir), _seeds(spark, "C1"), 3, excluded=excluded).select("id", "dist")


@query(_reach_sql("'C1', 'C2', 'P1'", 2, "SELECT * FROM und", "SELECT seed, id, dist FROM reach"))
def multi_seed_bfs(spark, sf_dir):
    return traverse.distances(star_graph.relationships(spark, sf_dir), _seeds(spark, "C1", "C2", "P1"), 2)


INDUCED_SQL = """, held AS (SELECT DISTINCT r.src, r.dst, r.type FROM rels r JOIN reach a ON a.id = r.src
        JOIN reach b ON b.id = r.dst AND b.seed = a.seed {condition}),
    kept AS (SELECT src AS id FROM held UNION SELECT dst FROM held UNION SELECT seed FROM reach)"""


@query(_reach_sql("'P1', 'P2', 'P3'", 2, "SELECT * FROM und", INDUCED_SQL.format(condition="WHERE r.type <> 'MENTIONS'") + """
    SELECT id, count(DISTINCT seed) AS seeds FROM reach WHERE id IN (SELECT id FROM kept) AND id NOT IN ('P1', 'P2', 'P3')
    GROUP BY id HAVING count(DISTINCT seed) >= 2"""))
def bridge_nodes(spark, sf_dir):
    found = traverse.expand(star_graph.star_graph(spark, sf_dir), _seeds(spark, "P1", "P2", "P3"), 2)
    return found.bridges.select("id", "seeds")


@query(_reach_sql("'P1'", 2, "SELECT * FROM und", INDUCED_SQL.format(condition="WHERE r.type <> 'MENTIONS'") + " SELECT src, dst, type FROM held"))
def subgraph_induced_edges(spark, sf_dir):
    found = traverse.subgraph(star_graph.star_graph(spark, sf_dir), _seeds(spark, "P1"), 2)
    return found.relationships.select("src", "dst", "type")


@query(_reach_sql("'P1'", 2, "SELECT * FROM und", INDUCED_SQL.format(condition="WHERE least(a.dist, b.dist) < 2") + " SELECT src, dst, type FROM held"))
def subgraph_trail_edges(spark, sf_dir):
    found = traverse.subgraph(star_graph.star_graph(spark, sf_dir), _seeds(spark, "P1"), 2, excluded=(), edges="trail")
    return found.relationships.select("src", "dst", "type")


@query(_reach_sql("'P1', 'P2'", 2, "SELECT * FROM und WHERE type <> 'MENTIONS'", "SELECT DISTINCT n.id, n.label FROM reach r JOIN nodes n ON n.id = r.id"))
def expanded_nodes(spark, sf_dir):
    found = traverse.expand(star_graph.star_graph(spark, sf_dir), _seeds(spark, "P1", "P2"), 2)
    return found.nodes.select("id", F.array_join("labels", ",").alias("label"))


PAIRS = [("P1", "P2"), ("P1", "P3"), ("P1", "R0"), ("P1", "R1"), ("P1", "R2"), ("P1", "R3"), ("P1", "R4"), ("P2", "N3")]


@query(_reach_sql("'P1', 'P2'", 4, "SELECT * FROM und WHERE type IN ('SUPPLIED_BY', 'LOCATED_IN', 'PART_OF')", f"""SELECT seed AS start, id AS "end",
    dist AS length FROM reach WHERE (seed, id) IN ({", ".join(map(str, PAIRS))})"""))
def shortest_path_length(spark, sf_dir):
    pairs = spark.createDataFrame(PAIRS, "start string, end string")
    return traverse.path_length(star_graph.relationships(spark, sf_dir), pairs, 4, excluded=("PLACED", "CONTAINS", "MENTIONS"))


@query(_reach_sql("'S1', 'S2'", 3, "SELECT * FROM und WHERE type IN ('SUPPLIED_BY', 'LOCATED_IN')", "SELECT id, min(dist) AS dist FROM reach GROUP BY id"))
def shortest_distance_to_anchors(spark, sf_dir):
    excluded = ("PLACED", "CONTAINS", "PART_OF", "MENTIONS")
    return traverse.distance_to_any(star_graph.relationships(spark, sf_dir), _seeds(spark, "S1", "S2"), 3, excluded=excluded)


@query(_reach_sql("'P1'", 3, "SELECT dst AS src, src AS dst, type FROM rels", "SELECT id, dist FROM reach WHERE dist > 0"))
def lineage_reverse_bfs(spark, sf_dir):
    rels = star_graph.relationships(spark, sf_dir)
    return traverse.distances(rels, _seeds(spark, "P1"), 3, direction="in").where("dist > 0").select("id", "dist")


@query(_with_graph(""", l AS (SELECT DISTINCT dst AS id FROM und WHERE src = 'P1' AND type <> 'MENTIONS'),
    r AS (SELECT DISTINCT dst AS id FROM und WHERE src = 'P2' AND type <> 'MENTIONS')
    SELECT b.bucket, (SELECT count(*) FROM l JOIN r ON r.id = l.id JOIN ents e ON e.id = l.id WHERE e.label = b.label) AS common
    FROM (VALUES ('Order', 'Order'), ('Supplier', 'Supplier'), ('Region', 'Region')) b(bucket, label)"""))
def compare_common_neighbors(spark, sf_dir):
    g = star_graph.star_graph(spark, sf_dir)
    left, right = (traverse.neighbors(g, _seeds(spark, p), limit=None).withColumn("bucket", F.element_at("labels", 1)) for p in ("P1", "P2"))
    return traverse.common_neighbors(left, right, ("Order", "Supplier", "Region"))


# ---------------------------------------------------------------- ranking and merging


@query(_reach_sql("'S1', 'S2'", 5, "SELECT * FROM und WHERE type IN ('SUPPLIED_BY', 'LOCATED_IN', 'PART_OF')", """, d AS (SELECT id, min(dist) AS dist FROM reach GROUP BY id),
    s AS (SELECT 'S' || s_suppkey AS id, (s_acctbal + 1000) / 11000 AS score FROM supplier)
    SELECT s.id, floor(s.score * 1e9 + 0.5) / 1e9 AS original_score,
           floor((CASE WHEN d.dist IS NULL THEN 0 ELSE greatest(0, 1 - d.dist / 6.0::DOUBLE) END) * 1e9 + 0.5) / 1e9 AS graph_proximity,
           floor((0.6::DOUBLE * s.score + 0.4::DOUBLE * CASE WHEN d.dist IS NULL THEN 0 ELSE greatest(0, 1 - d.dist / 6.0::DOUBLE) END) * 1e4 + 0.5) / 1e4 AS score
    FROM s LEFT JOIN d ON d.id = s.id"""))
def graph_rerank(spark, sf_dir):
    rels = star_graph.relationships(spark, sf_dir)
    found = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), ((F.col("s_acctbal") + 1000) / 11000).alias("score")
    )
    out = rank.rerank(found, rels, _seeds(spark, "S1", "S2"), excluded=("PLACED", "CONTAINS", "MENTIONS"))
    return out.select("id", *[text.half_up(F.col(c), 9).alias(c) for c in ("original_score", "graph_proximity")], "score")


def _groups(spark, sf_dir):
    """Line items as entities that several lists have: id, name, description, labels, score, grp, pos."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("description"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array("l_linestatus")).alias("labels"),
        F.lit(None).cast("string").alias("name"), F.col("l_quantity").cast("double").alias("score"),
        F.col("l_linenumber").alias("grp"), (F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long")).alias("pos"),
    )


@query("""WITH g AS (SELECT 'P' || l_partkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS description,
             CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS labels, l_quantity AS score, l_linenumber AS grp, l_orderkey * 100 + l_quantity::BIGINT AS pos FROM lineitem),
    w AS (SELECT *, first_value(grp) OVER o AS bg, first_value(pos) OVER o AS bp FROM g WINDOW o AS (PARTITION BY id ORDER BY score DESC, grp, pos)),
    l AS (SELECT * FROM w WHERE (grp, pos) >= (bg, bp))
    SELECT id, max(score) FILTER (grp = bg AND pos = bp) AS score, arg_min(description, grp::BIGINT * 100000000000 + pos) FILTER (description IS NOT NULL) AS description,
           arg_min(labels, grp::BIGINT * 100000000000 + pos) FILTER (labels IS NOT NULL) AS labels FROM l GROUP BY id""")
def merge_entities(spark, sf_dir):
    out = rank.merge_entities(_groups(spark, sf_dir))
    return out.select("id", "score", "description", F.array_join("labels", ",").alias("labels"))


@query("""WITH c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source || '-' || lang END AS id, text AS content, n_chars::DOUBLE AS score,
             doc_id % 5 AS grp, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN n_chars * 2.0::DOUBLE END AS hybrid FROM documents),
    k AS (SELECT *, coalesce(id, 'content:' || md5(content)[1:16]) AS key, coalesce(hybrid, score) AS rank FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC, grp, pos) AS place FROM k)
    SELECT pos, id, score FROM b WHERE place = 1 ORDER BY rank DESC, grp, pos LIMIT 20""")
def merge_doc_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 4 != 0, F.concat("source", F.lit("-"), "lang")).alias("id"), F.col("text").alias("content"),
        F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 5).alias("grp"), F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 2.0).alias("hybrid_score"),
    )
    return rank.merge_chunks(rows, 20).select("pos", "id", "score")


@query("""SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL""")
def merge_subgraph_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("grp"),
        F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"),
    )
    return rank.merge_first(rows, ["src", "dst", "type"])


@query("""WITH s AS (SELECT trim(lang || ' ' || source) AS snippet, min(doc_id) AS idx FROM documents GROUP BY 1)
    SELECT snippet FROM s ORDER BY idx LIMIT 12""")
def merge_snippets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("  "), "lang", F.lit(" "), "source", F.lit("\n")).alias("snippet"), F.lit(0).alias("grp"), F.col("doc_id").alias("pos")
    )
    return rank.merge_snippets(rows, 12)


@query(f"""WITH q AS (SELECT ['released', 'under', 'public', 'license', 'thehe'] AS keys),
    t AS (SELECT doc_id, text, list_sum(list_transform(list_concat(keys, ['apache']), lambda k: contains(lower(text), k)::INT)) AS hits,
                 list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS r, keys
          FROM documents, q),
    o AS (SELECT doc_id, hits, CASE WHEN len(r) > 0 THEN len(list_intersect(keys, r)) / 5.0::DOUBLE ELSE 0 END AS overlap FROM t)
    SELECT doc_id, floor(greatest(0.1::DOUBLE, overlap + least(hits * 5, 20) / 100.0::DOUBLE) * 1e4 + 0.5) / 1e4 AS hybrid_score
    FROM o WHERE hits >= 2 OR overlap >= 0.3""")
def relevant_chunk_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(0.1).alias("score"))
    found = rank.relevant_chunks(rows, F.lit("Which is released under the public license, thehe?"), F.array(F.lit("Apache"), F.lit("license")))
    return found.select("doc_id", "hybrid_score")


@query(f"""WITH e AS (SELECT 'S' || s_suppkey AS id, s_name AS name, (s_acctbal + 1000) / 11000 AS score, s_suppkey AS pos FROM supplier),
    h AS (SELECT * FROM e ORDER BY pos LIMIT 8),
    t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS r FROM h),
    o AS (SELECT *, len(list_intersect(['supplier', '000000003'], r)) / 2.0::DOUBLE AS overlap FROM t),
    k AS (SELECT *, 0.7::DOUBLE * overlap + 0.3::DOUBLE * score AS rank_score FROM o),
    p AS (SELECT *, row_number() OVER (ORDER BY overlap >= 0.5 DESC, rank_score DESC, pos) AS place FROM k)
    SELECT id, place FROM p WHERE place = 1 OR (overlap >= 0.5 AND place <= 2)""")
def anchor_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        ((F.col("s_acctbal") + 1000) / 11000).alias("score"), F.col("s_suppkey").alias("pos"),
    )
    return rank.anchors(rows, F.lit("What of the Supplier 000000003?")).select("id", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS kind, (s_suppkey % 11) / 10.0::DOUBLE AS x, (s_suppkey % 7) / 7.0::DOUBLE AS y FROM supplier),
    p AS (SELECT *, CASE WHEN kind = 0 THEN 0.35::DOUBLE * x + 0.35::DOUBLE * y + 0.2::DOUBLE * y + 0.1::DOUBLE * least((s_suppkey % 4) / 2.0::DOUBLE, 1)
                         WHEN kind = 1 THEN least((0.35::DOUBLE * x + 0.2::DOUBLE * y + 0.1::DOUBLE * least((s_suppkey % 4) / 2.0::DOUBLE, 1)) * 0.45::DOUBLE, 0.65)
                         ELSE 0.05 END AS c FROM s)
    SELECT s_suppkey, floor(CASE WHEN s_suppkey % 5 = 0 THEN least(c, 0.2) ELSE c END * 1e3 + 0.5) / 1e3 AS confidence FROM p""")
def confidence_score(spark, sf_dir):
    key = F.col("s_suppkey")
    x, y = (key % 11) / F.lit(10.0), (key % 7) / F.lit(7.0)
    none = F.array().cast("array<double>")
    entities = F.when(key % 3 == 2, none).otherwise(F.array(x))
    documents = F.when(key % 3 == 0, F.array(y)).otherwise(none)
    made = rank.confidence(entities, documents, y, (key % 4).cast("double"), key % 5 == 0, target=2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", made.alias("confidence"))


@query(_with_graph("""SELECT id, name, label AS labels FROM nodes WHERE lower(name) = 'nation_7' ORDER BY name <> 'nation_7', id LIMIT 1"""))
def resolve_entity_exact_ci(spark, sf_dir):
    found = search.node_by_name(star_graph.star_graph(spark, sf_dir), "nation_7")
    return found.select("id", "name", F.array_join("labels", ",").alias("labels"))


@query("""WITH c AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS found,
             (p_size % 10) / 10.0::DOUBLE AS score, (p_size % 9) / 10.0::DOUBLE AS second, 'blue bolt' AS asked FROM part),
    o AS (SELECT *, len(list_intersect(['blue', 'bolt'], string_split(found, ' '))) / 2.0::DOUBLE AS overlap FROM c)
    SELECT p_partkey, score >= 0.78 AND score - second >= 0.06 AND (asked = found
           OR ((contains(found, asked) OR contains(asked, found)) AND overlap >= 0.5) OR overlap >= 0.8) AS accepted FROM o""")
def resolve_vector_accept(spark, sf_dir):
    score, second = (F.col("p_size") % 10) / F.lit(10.0), (F.col("p_size") % 9) / F.lit(10.0)
    return table(spark, sf_dir, "part").select("p_partkey", search.accepts(F.lit("Blue #bolt"), F.col("p_name"), score, second).alias("accepted"))


# ---------------------------------------------------------------- jobs and evaluation


@query("""SELECT user_id AS job, event_id AS seq, floor(avg(value) OVER w * 1e6 + 0.5) / 1e6 AS mean_seconds,
    floor(avg(value) OVER w * (1000000 - event_id) * 1e4 + 0.5) / 1e4 AS eta_seconds FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def progress_rolling_eta(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"))
    out = aggregate.rolling_eta(done, 1_000_000)
    return out.select("job", "seq", text.half_up(F.col("mean_seconds"), 6).alias("mean_seconds"), text.half_up(F.col("eta_seconds"), 4).alias("eta_seconds"))


@query("""WITH c AS (SELECT b.item_id, contains(lower(b.text), 'the') AND contains(lower(b.text), 'of') AS passed FROM benchmark b)
    SELECT count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases, floor(count(*) FILTER (passed) / greatest(count(*), 1) * 1e3 + 0.5) / 1e3 AS pass_rate FROM c""")
def benchmark_pass_rate(spark, sf_dir):
    judged = table(spark, sf_dir, "benchmark").select(text.contains_all("text", F.array(F.lit("The"), F.lit("OF"))).alias("passed"))
    return aggregate.pass_rate(judged)


@query("""SELECT o_orderstatus AS job_id, count(*) FILTER (o_orderpriority[1:1] = '1') AS done, count(*) FILTER (o_orderpriority[1:1] = '2') AS failed,
    count(*) FILTER (o_orderpriority[1:1] = '3') AS skipped, sum(o_custkey)::BIGINT AS chunks, sum(o_orderkey)::BIGINT AS nodes, 0::BIGINT AS rels FROM orders GROUP BY 1""")
def job_counters(spark, sf_dir):
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "done", "2", "failed", "3", "skipped", "4", "pending", "5", "pending")]), F.substring("o_orderpriority", 1, 1))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("job_id"), status.alias("status"), F.col("o_custkey").alias("chunks"), F.col("o_orderkey").alias("nodes"),
        F.lit(None).cast("long").alias("rels"),
    )
    return aggregate.job_counters(rows)


@query("""SELECT 'file' || p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)""")
def pending_files(spark, sf_dir):
    listed = table(spark, sf_dir, "part").select(F.concat(F.lit("file"), F.col("p_partkey").cast("string")).alias("path"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.concat(F.lit("file"), F.col("l_partkey").cast("string")).alias("path"))
    return files.pending(listed, done)


@query("""SELECT o_orderstatus AS job_id, 'o' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'done' ELSE 'failed' END AS status FROM orders
    UNION ALL SELECT 'X', 'o' || o_orderkey, 'done' FROM orders WHERE o_orderkey % 7 = 0""")
def ledger_mark(spark, sf_dir):
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path")
    old = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("job_id"), path, F.lit("failed").alias("status"))
    seven = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    new = seven.select(F.col("o_orderstatus").alias("job_id"), path, F.lit("done").alias("status"))
    return jobs.mark(old, new.unionByName(seven.select(F.lit("X").alias("job_id"), path, F.lit("done").alias("status"))))


@query(_with_graph("SELECT id, coalesce(name, '') AS name, label AS labels FROM nodes WHERE label IN ('Supplier', 'Nation')"))
def label_filter(spark, sf_dir):
    nodes = star_graph.star_graph(spark, sf_dir).nodes.where(graph.has_label("labels", "supplier", "NATION"))
    return nodes.select("id", F.coalesce("name", F.lit("")).alias("name"), F.array_join("labels", ",").alias("labels"))


@query(_with_graph("SELECT id, name, label AS labels FROM nodes WHERE id = 'P7'"))
def node_by_id(spark, sf_dir):
    return search.node_by_id(star_graph.star_graph(spark, sf_dir), "P7").select("id", "name", F.array_join("labels", ",").alias("labels"))


@query()
def hash_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.embed(docs, extract.HashingEmbedder(64), text_col="text").select("doc_id", "embedding")


@query()
def hybrid_query(spark, sf_dir):
    """A question answered over documents, benchmark passages as entities, and their mentions."""
    embedder = extract.HashingEmbedder(64)
    docs = star_graph.documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("id"), F.regexp_extract("text", r"^\S+ \S+ \S+", 0).alias("name"),
        F.array(F.lit("Concept")).alias("labels"), F.col("text").alias("description"),
    )
    # each passage is about a part and a nation, so that walks from it lead into the star schema
    number = F.col("item_id").cast("string")
    about = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), number).alias("src"),
        F.explode(F.array(F.concat(F.lit("P"), (F.col("item_id") + 1).cast("string")), F.concat(F.lit("N"), (F.col("item_id") % 25).cast("string")))).alias("dst"),
        F.lit("RELATED_TO").alias("type"),
    )
    others = star_graph.entities(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    embedded = extract.embed(items, embedder, text_col="description")
    # a stored graph: later steps read only the columns that they use
    store = Store(spark, _scratch(spark, "store"))
    store.save(graph.Graph(
        embedded.unionByName(others), extract.embed(docs, embedder, text_col="text"), star_graph.relationships(spark, sf_dir).unionByName(about)
    ))
    g = store.graph()
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]
    out = Hybrid(g, embedder, settings=Settings(entity_threshold=0.5, document_threshold=0.5)).answer(asked)
    row = (out["status"], out["method"], out["confidence"], out["doc_chunks_used"], [e["id"] for e in out["entities_found"]])
    return spark.createDataFrame([row], "status string, method string, confidence double, doc_chunks_used int, entities array<string>")
