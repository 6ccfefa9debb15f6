"""Registered queries of whole features: files, jobs, searches, resolution, paths and contexts, with their SQL oracles."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs  # noqa: F401  used as pa.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.config import Settings
from weftgraph.functions import text
from weftgraph.operators import extract, graph, rank, search, traverse
from weftgraph.plans import jobs, star_graph
from weftgraph.plans.catalog import BM25_SQL, COSINE_SQL, _asked, _reach_sql, _score, _scratch, _seeds, _with_graph, query
from weftgraph.plans.engine import Engine
from weftgraph.plans.star_graph import table
from weftgraph.sources import files
from weftgraph.sources.store import Store
from weftgraph.streaming import ingest


_FOLDERS: dict[tuple[str, str], str] = {}
#: Files of a folder at most, so that folders are listed side by side.
FOLDER_FILES = 1000


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each document: <part>/<n>/doc_id=<id>.txt holds the text and a line feed. Written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FOLDERS:
        path = _scratch(spark, "files")
        _write_files(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit(""))), path)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def _write_files(docs: DataFrame, path: str) -> None:
    """A file for each row (doc_id, text), written by the tasks themselves: Spark's writer starts a process for the permissions of
    each file and folder. An attempt writes to a folder of its own; those of finished attempts are moved into place. File systems
    that only Spark knows are left to its writer, with a folder for each file."""
    try:
        pa.fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        docs.toDF("doc_id", "value").write.partitionBy("doc_id").text(path)
        return

    def run(batches):
        task = TaskContext.get()
        mine = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = pa.fs.FileSystem.from_uri(f"{path}-attempts/{mine}")
        n = 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{n // FOLDER_FILES:06d}"
                if n % FOLDER_FILES == 0:
                    fs.create_dir(folder)
                with fs.open_output_stream(f"{folder}/doc_id={doc_id}.txt") as out:
                    out.write(f"{value}\n".encode())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([mine])], ["attempt"])

    # a row for each task
    finished = [r["attempt"] for r in docs.mapInArrow(run, "attempt string").collect()]
    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root)
    for attempt in finished:
        fs.move(f"{root}-attempts/{attempt}", f"{root}/{attempt[:6]}")


def _doc_id(path: str = "path"):
    return F.regexp_extract(path, r"doc_id=(\d+)", 1).cast("long").alias("doc_id")


# ---------------------------------------------------------------- files and jobs

CONTENT_SQL = "coalesce(text, '') || chr(10)"
LINES_SQL = f"regexp_replace({CONTENT_SQL}, '\\r\\n?', chr(10), 'g')"


@query(f"SELECT doc_id, '.txt' AS extension, strlen({CONTENT_SQL})::BIGINT AS length FROM documents")
def files_listed(spark, sf_dir):
    found = files.list_files(spark, _folder(spark, sf_dir), [".TXT"], recursive=True)
    return found.select(_doc_id(), "extension", "length")


@query(f"""SELECT '.txt' AS extension, count(*) AS files, sum(strlen({CONTENT_SQL}))::BIGINT AS bytes,
    sum(greatest(1, strlen({CONTENT_SQL}) // 4096))::BIGINT AS estimated_chunks FROM documents""")
def files_sizes(spark, sf_dir):
    return files.sizes(files.list_files(spark, _folder(spark, sf_dir), recursive=True))


@query("""SELECT '.pdf' AS extension, 0::BIGINT AS files, 0.0::DOUBLE AS mb UNION ALL
    SELECT '.txt', count(*), floor(sum(strlen(coalesce(text, '') || chr(10))) / 1048576.0::DOUBLE * 100 + 0.5) / 100 FROM documents""")
def files_statistics(spark, sf_dir):
    folder = _folder(spark, sf_dir)
    counts, found = files.count_files(spark, folder), files.statistics(spark, folder)
    assert found["pdf_count"] == counts[".pdf"] and f"{found['total_files']} files" in files.preview(spark, folder)
    rows = [(".pdf", counts[".pdf"], 0.0), (".txt", found["txt_count"], found["total_size_mb"])]
    return spark.createDataFrame(rows, "extension string, files long, mb double")


@query(f"SELECT doc_id, 0 AS page, md5({LINES_SQL}) AS digest, NULL::VARCHAR AS error FROM documents")
def files_text_pages(spark, sf_dir):
    pages = files.pages(files.list_files(spark, _folder(spark, sf_dir), recursive=True, ordered=False))
    return pages.select(_doc_id("source_path"), "page", F.md5("text").alias("digest"), "error")


@query(f"""SELECT doc_id, i::INT AS page, string_split({CONTENT_SQL}, '. ')[i + 1] AS text
    FROM (SELECT doc_id, text, unnest(range(0, len(string_split({CONTENT_SQL}, '. ')))) AS i FROM documents)""")
def files_paged(spark, sf_dir):
    """The PDF reader's path, with a stand-in for the reader: pages end at full stops."""
    listed = files.list_files(spark, _folder(spark, sf_dir), recursive=True, ordered=False)
    pages = files.pdf_pages(listed, lambda content: content.decode().split(". "))
    return pages.select(_doc_id("source_path"), "page", "text")


@query("""WITH p AS (SELECT 'file' || lpad(p_partkey::VARCHAR, 9, '0') AS path FROM part WHERE p_partkey NOT IN (
        SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1))
    SELECT path, (row_number() OVER (ORDER BY path) - 1) // 10 AS batch FROM p""")
def file_batches(spark, sf_dir):
    name = lambda c: F.concat(F.lit("file"), F.lpad(F.col(c).cast("string"), 9, "0")).alias("path")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(name("l_partkey"))
    return files.batches(table(spark, sf_dir, "part").select(name("p_partkey")), done)


NAMES = {"Apache License": "License", "Public License": "License", "MIT License": "License", "The": "Concept", "De": "Concept"}
NAMED_SQL = """
    names AS (SELECT unnest(['Apache License', 'Public License', 'MIT License', 'The', 'De']) AS name,
                     unnest(['License', 'License', 'License', 'Concept', 'Concept']) AS label),
    hit AS (SELECT d.*, n.name, n.label FROM {source} d JOIN names n
            ON regexp_matches(d.text, '(^|[^\\p{{L}}\\p{{N}}_])' || n.name || '($|[^\\p{{L}}\\p{{N}}_])'))
"""
WHOLE = Settings(chunk_size=10**8, chunk_overlap=0)
NORMAL_SQL = "trim(regexp_replace(coalesce(text, ''), '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT DISTINCT {NORMAL_SQL} AS text FROM documents),
    d AS (SELECT * FROM c WHERE text <> ''), {NAMED_SQL.format(source='d')}
    SELECT 'done' AS status, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM d) AS chunks, (SELECT count(*) FROM hit) AS nodes,
           (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT name) FROM hit) AS entities, (SELECT count(*) FROM hit) AS mentions,
           0::BIGINT AS waiting""")
def ingest_job(spark, sf_dir):
    """A folder of all documents ingested as a job, each text a chunk, in batches with a commit each."""
    store = Store(spark, _scratch(spark, "store"))
    settings = WHOLE.with_(checkpoint_files=max(1, table(spark, sf_dir, "documents").count() // 2), requests_per_minute=10**9, tokens_per_minute=10**12)
    jobs.run(
        store, _folder(spark, sf_dir), "job", extract.GazetteerExtractor(NAMES), extract.HashingEmbedder(8), F.current_timestamp(), settings=settings
    )
    g = store.graph()
    done = store.job_files().groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"), F.sum("nodes").alias("nodes"))
    counts = {
        "documents": g.documents.where("embedding IS NOT NULL").count(), "entities": g.entities.where("embedding IS NOT NULL").count(),
        "mentions": g.relationships.where("type = 'MENTIONS' AND source_chunk IS NOT NULL").count(), "waiting": store.extracted().count(),
    }
    return done.select("*", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


@query(f"""WITH c AS (SELECT DISTINCT {NORMAL_SQL} AS text FROM documents)
    SELECT sha1(text)[1:16] AS content_fingerprint, length(text) AS char_count FROM c WHERE text <> ''""")
def stream_ingest(spark, sf_dir):
    """The same folder taken as a stream; run twice, the second run finds nothing new."""
    out, checkpoint, folder = _scratch(spark, "out"), _scratch(spark, "checkpoint"), _folder(spark, sf_dir)
    for _ in range(2):
        ingest.run_once(spark, folder, out, checkpoint, WHOLE)
    return spark.read.parquet(out).select("content_fingerprint", F.col("char_count").cast("long").alias("char_count"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), {NAMED_SQL.format(source='d')},
    h AS (SELECT *, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'),
              lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: contains(lower(s), lower(name)) AND length(s) > 20) AS hits FROM hit),
    e AS (SELECT *, CASE WHEN len(hits) = 0 THEN NULL WHEN length(hits[1]) <= 200 THEN hits[1]
                 ELSE regexp_replace(hits[1][1:200], ' [^ ]*$', '') || '...' END AS description FROM h)
    SELECT doc_id::VARCHAR AS source_chunk, name AS id, name, label AS labels, description, source AS source_document,
           round(least(0.95, 0.75 + CASE WHEN coalesce(description, '') <> '' THEN 0.15 ELSE 0 END
                 + CASE WHEN length(coalesce(description, '')) >= 40 THEN 0.05 ELSE 0 END), 3)::DOUBLE AS confidence FROM e""")
def gazetteer_extract(spark, sf_dir):
    """Entities of all documents, found by names, enriched."""
    chunked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_file"))
    found = extract.extract(chunked, extract.GazetteerExtractor(NAMES))
    nodes = extract.enriched_nodes(found)
    return nodes.select("id", "name", F.array_join("labels", ",").alias("labels"), "description", "confidence", "source_document", "source_chunk")


# ---------------------------------------------------------------- search and resolution


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors of their numbers."""
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("D"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return star_graph.documents(spark, sf_dir).join(vectors, "id", "left")


@query(f"""WITH {COSINE_SQL}, top AS (SELECT s.vec_id, s.cos, d.text, d.source FROM scored s JOIN documents d ON d.doc_id = s.vec_id ORDER BY cos DESC, 'D' || vec_id LIMIT 7)
    SELECT 'D' || vec_id AS id, md5(coalesce(text, '')) AS digest, source AS source_file, '/corpus/' || source AS source_path, 0 AS page,
           floor((1 + cos) / 2 * 1e9 + 0.5) / 1e9 AS score FROM top WHERE (1 + cos) / 2 >= 0.6""")
def document_search(spark, sf_dir):
    found = search.document_search(_embedded(spark, sf_dir), _asked(spark, sf_dir), top_k=7, threshold=0.6)
    return found.select("id", F.md5("content").alias("digest"), "source_file", "source_path", "page", _score())


@query(f"""WITH {COSINE_SQL}, v AS (SELECT s.vec_id AS id, (1 + s.cos) / 2 AS score FROM scored s JOIN documents d ON d.doc_id = s.vec_id ORDER BY cos DESC, 'D' || vec_id LIMIT 7),
    h AS (SELECT doc_id AS id, (contains(lower(text), 'license')::INT + contains(lower(text), 'version')::INT + contains(lower(text), 'public')::INT) AS hits FROM documents),
    k AS (SELECT id, hits / 3.0::DOUBLE AS score FROM h WHERE hits >= 2 ORDER BY score DESC, 'D' || id LIMIT 8),
    u AS (SELECT id, score, 0 AS arm FROM v UNION ALL SELECT id, score, 1 FROM k),
    b AS (SELECT id, max(score) AS score, arg_min(arm, -score * 10 + arm) AS arm FROM u GROUP BY id)
    SELECT 'D' || id AS id, arm, floor(score * 1e9 + 0.5) / 1e9 AS score FROM b""")
def retrieval_arms(spark, sf_dir):
    """The union of a vector and a keyword search over documents, the best of each document."""
    docs = _embedded(spark, sf_dir)
    near = search.document_search(docs, _asked(spark, sf_dir), top_k=7, threshold=0.0).select("id", "content", "score")
    named = search.keyword_search(docs, ["license", "version", "public"]).select("id", F.col("text").alias("content"), "score")
    arms = [arm.withColumn("grp", F.lit(i)).withColumn("pos", -F.col("score")) for i, arm in enumerate((near, named))]
    return rank.merge_chunks(arms[0].unionByName(arms[1]), 20).select("id", F.col("grp").alias("arm"), _score())


@query("WITH " + BM25_SQL.replace("['blue', 'bolt', 'economy']", "['blue', 'bolt']").replace("LIMIT 5", "LIMIT 1"))
def resolve_by_words(spark, sf_dir):
    """A name that no entity has, resolved by full text: the best hit, which has half of its words."""
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.array(F.lit("Part")).alias("labels"),
    )
    g = graph.empty_graph(spark).with_(entities=parts)
    found = search.resolve(g, "Blue, bolt!")
    return spark.createDataFrame([(found["id"], found["score"])], "id string, score double").select("id", text.half_up(F.col("score"), 6).alias("score"))


@query("""SELECT 'V' || vec_id AS id, 'vector ' || vec_id AS name, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id = 0""")
def resolve_by_vector(spark, sf_dir):
    """A spelling that full text can't resolve, resolved by its vector: alone ahead, and alike in its words."""
    vectors = table(spark, sf_dir, "embeddings")
    nodes = vectors.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"), F.array(F.lit("Vector")).alias("labels"), "embedding",
    )
    asked = vectors.where("vec_id = 0").first()["embedding"]
    # near copies of the asked vector would leave it no margin
    alone = nodes.where((F.col("id") == "V0") | (F.abs(search.vector.cosine(F.col("embedding"), search.query_vector(asked))) < 0.8))
    g = graph.empty_graph(spark).with_(entities=alone.withColumn("name", F.when(F.col("id") == "V0", F.lit("vector#0")).otherwise(F.lit(""))))
    low = Settings(fulltext_limit=1)
    best = search.vector_search(g.entities, search.query_vector(asked), top_k=5, threshold=low.resolve_min_score)
    second = F.lead("score").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))  # at most five rows
    sure = best.withColumn("second", second).where(search.accepts(F.lit("Vector 0"), F.col("name"), F.col("score"), F.col("second"), low))
    return sure.select("id", F.translate("name", "#", " ").alias("name"), _score())


@query("""SELECT 'D' || d.doc_id AS id, len(e.embedding)::BIGINT AS size, e.embedding IS NOT NULL AS embedded
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def set_embeddings(spark, sf_dir):
    now = F.lit("2024-01-01").cast("timestamp")
    docs = star_graph.documents(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embedded_at", F.lit(None).cast("timestamp"))
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.concat(F.lit("D"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    out = graph.set_embeddings(docs, vectors, now)
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long")
    return out.select("id", size.alias("size"), (F.col("embedded_at") == now).isNotNull().alias("embedded"))


@query("""WITH old AS (SELECT 'P' || p_partkey AS id, p_brand AS a, p_type AS b FROM part),
    new AS (SELECT 'P' || l_partkey AS id, min(l_suppkey)::VARCHAR AS b, min(l_returnflag) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
    SELECT coalesce(o.id, n.id) AS id, concat_ws(';', 'a=' || o.a, 'b=' || coalesce(n.b, o.b), 'c=' || n.c) AS props FROM old o FULL JOIN new n ON n.id = o.id""")
def upsert_maps(spark, sf_dir):
    """Maps of properties are joined in an upsert, the new entries first."""
    entity = lambda rows, props: graph.empty_graph(spark).with_(entities=rows.select("id", props.alias("props")))
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string")).alias("id")
    old = table(spark, sf_dir, "part").select(name("p_partkey"), "p_brand", "p_type")
    new = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(name("l_partkey")).agg(
        F.min("l_suppkey").cast("string").alias("mode"), F.min("l_returnflag").alias("flag")
    )
    out = graph.upsert(
        entity(old, F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"))),
        entity(new, F.create_map(F.lit("b"), F.col("mode"), F.lit("c"), F.col("flag"))),
    ).entities
    shown = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("id", F.array_join(shown, ";").alias("props"))


@query(_with_graph("SELECT type, count(*) AS n FROM rels GROUP BY type"))
def sql_statement(spark, sf_dir):
    engine = Engine(spark, graph=star_graph.star_graph(spark, sf_dir))
    rows = engine.execute_sql("SELECT type, count(*) AS n FROM relationships GROUP BY type")
    assert "error" in engine.execute_sql("DROP TABLE x")[0] and "error" in engine.execute_sql("SELECT * FROM nodes", limit=1)[0]
    return spark.createDataFrame([(r["type"], r["n"]) for r in rows], "type string, n long")


# ---------------------------------------------------------------- paths and contexts

PATH_TYPES = ("PLACED", "CONTAINS", "MENTIONS")
#: From a start to an end by true shortest paths; of several parents the smallest (source, type).
PATH_SQL = """, step AS (SELECT r.id, min(struct_pack(parent := e.src, type := e.type)) AS p
        FROM reach r JOIN und e ON e.dst = r.id AND e.type NOT IN ('PLACED', 'CONTAINS', 'MENTIONS')
        JOIN reach q ON q.id = e.src AND q.dist = r.dist - 1 WHERE r.dist > 0 GROUP BY r.id),
    back AS (SELECT '{end}' AS id, dist AS hop FROM reach WHERE id = '{end}'
             UNION ALL SELECT s.p.parent, b.hop - 1 FROM back b JOIN step s ON s.id = b.id WHERE b.hop > 0),
    path AS (SELECT b.hop, b.id, n.name, n.label, s.p.type AS type FROM back b JOIN nodes n ON n.id = b.id LEFT JOIN step s ON s.id = b.id)
"""
WALK = "SELECT * FROM und WHERE type NOT IN ('PLACED', 'CONTAINS', 'MENTIONS')"


@query(_reach_sql("'P1'", 5, WALK, PATH_SQL.format(end="R2") + """SELECT hop::INT AS hop, id, name, label AS labels, CASE WHEN hop > 0 THEN type END AS type FROM path"""))
def shortest_path_nodes(spark, sf_dir):
    path = traverse.shortest_path(star_graph.star_graph(spark, sf_dir), "P1", "R2", excluded=PATH_TYPES)
    types = [None, *(r["type"] for r in path["relationships"])]
    rows = [(i, n["id"], n["name"], ",".join(n["labels"]), t) for i, (n, t) in enumerate(zip(path["nodes"], types, strict=True))]
    return spark.createDataFrame(rows, "hop int, id string, name string, labels string, type string")


@query(_reach_sql("'P1'", 5, WALK, PATH_SQL.format(end="P2") + """
    SELECT true AS connected, max(hop)::INT AS hops, string_agg(CASE WHEN hop > 0 THEN ' --[' || type || ']--> ' ELSE '' END || name, '' ORDER BY hop) AS description FROM path"""))
def connections(spark, sf_dir):
    found = traverse.find_connections(star_graph.star_graph(spark, sf_dir), "P1", "P2", excluded=PATH_TYPES)
    return spark.createDataFrame([(found["connected"], found["hops"], found["description"])], "connected boolean, hops int, description string")


@query(_reach_sql("'S1'", 1, "SELECT * FROM und", """, inside AS (SELECT DISTINCT r.src, r.type, r.dst FROM rels r JOIN reach a ON a.id = r.src
        JOIN reach b ON b.id = r.dst WHERE r.type <> 'MENTIONS')
    SELECT (SELECT count(*) FROM reach) AS neighbors, (SELECT count(*) FROM inside) AS relationships,
           (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM inside) AS types,
           s.name || ' (Supplier)' || chr(10) || (SELECT count(*) FROM reach) || ' nodes within 1 hops, by ' || (SELECT count(DISTINCT type) FROM inside)
           || ' types of relationship: ' || (SELECT string_agg(DISTINCT type, ', ' ORDER BY type) FROM inside) AS summary
    FROM nodes s WHERE s.id = 'S1'"""))
def entity_context(spark, sf_dir):
    found = Engine(spark, graph=star_graph.star_graph(spark, sf_dir)).entity_context("S1", 1)
    row = (len(found["neighbors"]), len(found["relationships"]), ",".join(found["relationship_types"]), found["context_summary"])
    return spark.createDataFrame([row], "neighbors long, relationships long, types string, summary string")


@query(_reach_sql("'P1', 'P2'", 1, "SELECT * FROM und", """, inside AS (SELECT DISTINCT r.src, r.type, r.dst FROM rels r JOIN reach a ON a.id = r.src
        JOIN reach b ON b.id = r.dst AND b.seed = a.seed WHERE r.type <> 'MENTIONS'),
    kept AS (SELECT src AS id FROM inside UNION SELECT dst FROM inside UNION SELECT seed FROM reach)
    SELECT src || ' --[' || type || ']--> ' || dst AS chain, (SELECT count(*) FROM kept) AS nodes,
           (SELECT count(*) FROM (SELECT id FROM reach WHERE id IN (SELECT id FROM kept) AND id NOT IN ('P1', 'P2') GROUP BY id HAVING count(DISTINCT seed) >= 2)) AS bridges
    FROM inside ORDER BY src, type, dst LIMIT 20"""))
def multi_entity_context(spark, sf_dir):
    found = Engine(spark, graph=star_graph.star_graph(spark, sf_dir)).multi_entity_context(["P1", "P2", "P1"], 1)
    rows = [(c, len(found["merged_context"]["nodes"]), len(found["bridge_nodes"])) for c in found["relationship_chains"]]
    return spark.createDataFrame(rows, "chain string, nodes long, bridges long")


@query(_with_graph(""", walk AS (SELECT DISTINCT type AS relationship, dst AS id, 1 AS dist FROM und WHERE src = 'S1' AND type <> 'MENTIONS'
        UNION SELECT w.relationship, e.dst, w.dist + 1 FROM walk w JOIN und e ON e.src = w.id AND e.type <> 'MENTIONS' WHERE w.dist < 2)
    SELECT relationship, w.id, min(dist)::INT AS dist, any_value(n.label) AS labels FROM walk w JOIN nodes n ON n.id = w.id WHERE w.id <> 'S1' GROUP BY ALL""",
                   recursive=True))
def neighbors_2hop(spark, sf_dir):
    found = traverse.neighbors(star_graph.star_graph(spark, sf_dir), _seeds(spark, "S1"), 2, limit=None)
    return found.select("relationship", "id", "dist", F.array_join("labels", ",").alias("labels"))


#: The star schema with labels and types of models, for queries on them.
MODEL_LABELS = {"Part": "AIModel", "Supplier": "AICompany", "Order": "Benchmark", "Nation": "Dataset", "Region": "Technique"}
MODELS_SQL = """, m AS (SELECT id, name, CASE label WHEN 'Part' THEN 'AIModel' WHEN 'Supplier' THEN 'AICompany' WHEN 'Order' THEN 'Benchmark'
        WHEN 'Nation' THEN 'Dataset' WHEN 'Region' THEN 'Technique' ELSE label END AS label FROM nodes),
    b AS (SELECT e.src AS model, e.dst AS id, e.type AS relationship, CASE m.label WHEN 'AICompany' THEN 'developed_by' WHEN 'Benchmark' THEN 'benchmarks'
        WHEN 'Dataset' THEN 'datasets' WHEN 'Technique' THEN 'techniques' END AS bucket FROM und e JOIN m ON m.id = e.dst WHERE e.type <> 'MENTIONS')
"""


def _models(spark: SparkSession, sf_dir: str) -> graph.Graph:
    g = star_graph.star_graph(spark, sf_dir)
    known = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    return g.with_(entities=g.entities.withColumn("labels", F.transform("labels", lambda x: F.coalesce(F.try_element_at(known, x), x))))


@query(_with_graph(MODELS_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id, relationship) AS place FROM
        (SELECT DISTINCT model, id, relationship, bucket FROM b JOIN nodes n USING (id)) WHERE model IN ('P1', 'P2'))
    SELECT model, id, relationship, bucket FROM f WHERE place <= 50 AND bucket IS NOT NULL"""))
def model_buckets(spark, sf_dir):
    """What two models have around them, by what it is to them; at most fifty neighbours a model, as the feature has it."""
    found = traverse.model_neighbors(_models(spark, sf_dir), _seeds(spark, "P1", "P2"))
    return found.select(F.col("seed").alias("model"), "id", "relationship", "bucket")


@query(_with_graph(MODELS_SQL + """, f AS (SELECT DISTINCT model, id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id, relationship) AS place
        FROM (SELECT DISTINCT model, id, relationship, bucket FROM b) WHERE model IN ('S1', 'S2')) WHERE place <= 50)
    SELECT k.bucket, (SELECT count(*) FROM f x JOIN f y ON y.id = x.id AND y.bucket = x.bucket AND y.model = 'S2' WHERE x.model = 'S1' AND x.bucket = k.bucket) AS common
    FROM (VALUES ('techniques'), ('benchmarks'), ('datasets')) k(bucket)"""))
def compare_models(spark, sf_dir):
    g = _models(spark, sf_dir)
    return traverse.common_neighbors(*(traverse.model_neighbors(g, _seeds(spark, s)) for s in ("S1", "S2")))


@query(_with_graph("SELECT n AS nodes FROM (SELECT count(*) AS n FROM nodes)"))
def graph_cleared(spark, sf_dir):
    """How many nodes go when the stored graph is cleared; it is empty then."""
    store = Store(spark, _scratch(spark, "store"))
    g = star_graph.star_graph(spark, sf_dir)
    store.save(g.with_(documents=g.documents.select("id", "text")))
    gone = store.clear(True)
    assert store.graph().nodes.isEmpty()
    return spark.createDataFrame([(gone,)], "nodes long")


@query(_reach_sql("'S1'", 3, "SELECT dst AS src, src AS dst, type FROM rels", """, dated AS (SELECT r.id, n.name, CASE n.label WHEN 'Part' THEN 'AIModel' ELSE 'Technique' END AS labels,
        CASE n.label WHEN 'Part' THEN lpad(p.p_size::VARCHAR, 4, '0') ELSE '1900' END AS published
        FROM reach r JOIN ents n ON n.id = r.id LEFT JOIN part p ON 'P' || p.p_partkey = r.id WHERE r.dist > 0 AND n.label IN ('Part', 'Region'))
    SELECT id, name, labels, published FROM dated ORDER BY published, id LIMIT 20"""))
def lineage(spark, sf_dir):
    """The first twenty models and techniques that lead to a supplier, by their dates, as the feature has it."""
    g = _models(spark, sf_dir)
    sizes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
        F.create_map(F.lit("release_date"), F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("props"),
    )
    found = traverse.lineage(g.with_(entities=g.entities.join(sizes, "id", "left")), "S1")
    return found.select("id", "name", F.array_join("labels", ",").alias("labels"), "published")


@query("SELECT p_partkey, p_size % 2 = 0 AS digest FROM part")
def digest_names(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.upper(F.md5("p_name"))).otherwise(F.concat("p_name", F.md5("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_digest(name).alias("digest"))


@query(_with_graph("""SELECT 'how many' AS question, NULL AS id, (SELECT count(*) FROM nodes WHERE label = 'Supplier') AS n
    UNION ALL SELECT 'connected', e.dst, NULL FROM (SELECT DISTINCT e.dst, e.type FROM und e JOIN ents a ON a.id = e.src WHERE a.id = 'N7') e
    UNION ALL SELECT 'types', type, count(*) FROM rels GROUP BY type
    UNION ALL SELECT 'listed', id, NULL FROM nodes WHERE label = 'Region'"""))
def plain_questions(spark, sf_dir):
    """Questions in words, answered by statements over the views."""
    engine = Engine(spark, graph=star_graph.star_graph(spark, sf_dir))
    rows = [("how many", None, r["count"]) for r in engine.query("How many suppliers are there?")]
    rows += [("connected", r["id"], None) for r in engine.query("What is connected to Nation_7?")]
    rows += [("types", r["type"], r["count"]) for r in engine.query("How many relationships of each type?")]
    rows += [("listed", r["id"], None) for r in engine.query("list all regions")]
    return spark.createDataFrame(rows, "question string, id string, n long")


@query("""SELECT 'D' || doc_id AS id, md5(text) AS digest, source FROM documents""")
def prepared_store(spark, sf_dir):
    """The documents of a stored graph after it was put in order."""
    store = Store(spark, _scratch(spark, "store"))
    g = star_graph.star_graph(spark, sf_dir)
    store.save(g.with_(documents=g.documents.select("id", "text", "source_file")))
    jobs.prepare(store, F.lit("2024-01-01").cast("timestamp"))
    return store.graph().documents.select("id", F.md5("text").alias("digest"), F.col("source_file").alias("source"))
