"""The property graph as three tables, with its maintenance passes.

entities(id, name, labels, description, ...), documents(id, text, source_file, page, ...) and
relationships(src, dst, type, ...). Relationships are stored once and directed; traversals see them from both ends.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import config
from weftgraph.functions import text

ENTITIES = (
    "id string, name string, labels array<string>, description string, source_document string, source_chunk string, "
    "confidence double, embedding_text string, embedding array<float>, embedded_at timestamp, props map<string,string>"
)
DOCUMENTS = (
    "id string, text string, source_file string, source_path string, page int, chunk_index int, "
    "content_fingerprint string, char_count int, embedding array<float>, embedded_at timestamp"
)
RELATIONSHIPS = (
    "src string, dst string, type string, source_file string, source_chunk string, source_chunk_text string, "
    "confidence double, extracted_at timestamp, props map<string,string>"
)


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    documents: DataFrame
    relationships: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """Entities and documents alike: id, name, labels, description."""
        entities = self.entities.select("id", "name", "labels", "description")
        documents = self.documents.select(
            "id", F.lit(None).cast("string").alias("name"), F.array(F.lit("Document")).alias("labels"),
            F.lit(None).cast("string").alias("description"),
        )
        return entities.unionByName(documents)

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (ENTITIES, DOCUMENTS, RELATIONSHIPS)))


def cut(frame: DataFrame) -> DataFrame:
    """The frame, checkpointed: long loops neither grow their plan nor lose their work with an executor."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="weftgraph-"))
    return frame.checkpoint()


def kept_types(relationships: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Relationships whose type, in any case, isn't excluded; before a traversal, so that the scan can skip them."""
    names = [t.upper() for t in excluded]
    return relationships.where(~F.upper("type").isin(names)) if names else relationships


def undirected(relationships: DataFrame) -> DataFrame:
    """Each relationship from either end: (src, dst, type)."""
    forward = relationships.select("src", "dst", "type")
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def spanned(ids: DataFrame) -> Callable[[Column | str], Column]:
    """Whether an identifier lies between the least and the greatest of some (the frame's first column), so that it can be one.

    Exact, and told by two values: what can't be one needn't be shuffled to a join with them.
    """
    c = ids.columns[0]
    low, high = ids.agg(F.min(c), F.max(c)).first()
    return lambda value: F.lit(False) if low is None else F.coalesce(text.col(value).between(low, high), F.lit(False))


#: Rows of identifiers (under 100 bytes each) and of texts or vectors that a join sends to all executors at most.
SENT_IDS, SENT_TEXTS = 100_000, 10_000


def sent(frame: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """A join's right side: sent to all executors if it has few rows by count, else shuffled. Spark goes by the size of compressed
    files and usual widths of columns, and collects millions of identifiers in the driver that take little room in their files."""
    return travels(frame.count(), most)(frame)


def travels(rows: int, most: int = SENT_IDS) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if rows <= most else lambda frame: frame.hint("merge")


def label_set(labels: Column | str = "labels") -> Column:
    return F.array_sort(F.coalesce(text.col(labels), F.array().cast("array<string>")))


def has_label(labels: Column | str, *wanted: str) -> Column:
    """Whether a node has one of the labels, whatever their case."""
    low = F.transform(F.coalesce(text.col(labels), F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(low, F.array(*[F.lit(w.lower()) for w in wanted]))


def canonical_labels(entities: DataFrame, vocabulary: Sequence[str] = config.ENTITY_LABELS) -> DataFrame:
    """Labels in the vocabulary's spelling where they were capitalised like a plain word; others stay."""
    changed = {v.capitalize(): v for v in vocabulary if v.capitalize() != v}
    known = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
    labels = F.transform("labels", lambda label: F.coalesce(F.try_element_at(known, label), label))
    return entities.withColumn("labels", F.array_distinct(labels))


def backfill_document_edges(
    graph: Graph, now: Column, entity_ids: DataFrame | None = None, document_ids: DataFrame | None = None
) -> DataFrame:
    """Relationships with the provenance of those between a document and an entity filled in where it is missing.

    Relationships that can't have a document as an end go past the joins; texts are joined last, to those that are filled.
    """
    documents = graph.documents.select(
        F.col("id").alias("_doc"), F.coalesce("source_file", "id").alias("_file"), F.substring("text", 1, 500).alias("_text")
    )
    entities = graph.entities.select(F.col("id").alias("_entity"))
    if document_ids is not None:
        documents = documents.join(sent(document_ids.select(F.col("id").alias("_doc")).distinct()), "_doc", "left_semi")
    if entity_ids is not None:
        entities = entities.join(sent(entity_ids.select(F.col("id").alias("_entity")).distinct()), "_entity", "left_semi")
    n = documents.count()
    rels, doc_ids, entities = graph.relationships, travels(n)(documents.select("_doc")), sent(entities)
    documents = travels(n, SENT_TEXTS)(documents)
    can_be = spanned(graph.documents.select("id"))
    touched = can_be("src") | can_be("dst")
    out = rels.where(touched).join(doc_ids, F.col("src") == F.col("_doc"), "left")
    out = out.join(doc_ids.withColumnRenamed("_doc", "_doc2"), F.col("dst") == F.col("_doc2"), "left")
    other = F.when(F.col("_doc").isNotNull(), F.col("dst")).when(F.col("_doc2").isNotNull(), F.col("src"))
    # nobody is called so: rows without another end don't meet in one task
    nobody = F.concat(F.lit("\0"), "src", F.lit("\0"), "dst")
    out = out.withColumn("_other", F.coalesce(other, nobody)).join(entities, F.col("_other") == F.col("_entity"), "left")
    hit = F.col("_entity").isNotNull()
    chosen = F.when(hit, F.coalesce("_doc", "_doc2")).otherwise(nobody)
    out = out.withColumn("_at", chosen).drop("_doc", "_doc2").join(documents, F.col("_at") == F.col("_doc"), "left")
    given = F.when(F.col("type") == "MENTIONS", 0.58).otherwise(0.7)

    def fill(name: str, value: Column) -> Column:
        return F.when(hit, F.coalesce(F.col(name), value)).otherwise(F.col(name)).alias(name)

    filled = {
        "source_file": fill("source_file", F.col("_file")),
        "source_chunk": fill("source_chunk", F.col("_doc")),
        "source_chunk_text": fill("source_chunk_text", F.col("_text")),
        "extracted_at": fill("extracted_at", now),
        "confidence": fill("confidence", given),
    }
    return out.select(*[filled.get(c, F.col(c)) for c in rels.columns]).unionByName(rels.where(~touched))


def backfill_entity_edges(graph: Graph, now: Column, entity_ids: DataFrame | None = None) -> DataFrame:
    """Relationships with the provenance of those between two entities filled in; the start's source goes first."""
    def side(prefix: str) -> DataFrame:
        return sources.select(F.col("id").alias(f"{prefix}id"), F.col("file").alias(f"{prefix}file"), F.col("chunk").alias(f"{prefix}chunk"))

    sources = graph.entities.select("id", F.col("source_document").alias("file"), F.col("source_chunk").alias("chunk"))
    hinted = travels(sources.count())
    rels = graph.relationships
    out = rels.join(hinted(side("_a")), F.col("src") == F.col("_aid"), "left").join(hinted(side("_b")), F.col("dst") == F.col("_bid"), "left")
    hit = F.col("_aid").isNotNull() & F.col("_bid").isNotNull()
    if entity_ids is not None:
        chosen = entity_ids.select(F.col("id").alias("_x")).distinct()
        for end in ("src", "dst"):
            marked = sent(chosen.select(F.col("_x").alias(f"_in_{end}")))
            out = out.join(marked, F.col(end) == F.col(f"_in_{end}"), "left")
        hit &= F.col("_in_src").isNotNull() | F.col("_in_dst").isNotNull()

    def fill(name: str, value: Column) -> Column:
        return F.when(hit, F.coalesce(F.col(name), value)).otherwise(F.col(name)).alias(name)

    filled = {
        "source_file": fill("source_file", F.coalesce("_afile", "_bfile", F.lit("unknown"))),
        "source_chunk": fill("source_chunk", F.coalesce("_achunk", "_bchunk")),
        "extracted_at": fill("extracted_at", now),
        "confidence": fill("confidence", F.lit(0.68)),
    }
    return out.select(*[filled.get(c, F.col(c)) for c in rels.columns])


def _latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: per key the new row's values where it has any, else the old row's; maps are joined, new entries first."""
    tagged = old.withColumn("_order", F.lit(1)).unionByName(new.withColumn("_order", F.lit(0)), allowMissingColumns=True)
    aggs = []
    for f in old.schema.fields:
        if f.name in keys:
            continue
        if isinstance(f.dataType, T.MapType):
            by = F.sort_array(F.collect_list(F.when(F.col(f.name).isNotNull(), F.struct("_order", F.map_entries(f.name).alias("e")))))
            entries = F.flatten(F.transform(by, lambda x: x["e"]))
            distinct = F.aggregate(
                entries, F.array().cast("array<struct<key:string,value:string>>"),
                lambda got, e: F.when(F.exists(got, lambda g: g["key"] == e["key"]), got).otherwise(F.array_append(got, e)),
            )
            aggs.append(F.map_from_entries(distinct).alias(f.name))
        else:
            aggs.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col("_order"))).alias(f.name))
    merged = tagged.groupBy(*keys).agg(*aggs) if aggs else tagged.select(*keys).distinct()
    return merged.select(*old.columns)


def upsert(graph: Graph, new: Graph) -> Graph:
    """The graph with new nodes and relationships merged in, by id and by (src, dst, type)."""
    return Graph(
        _latest(graph.entities, new.entities, ["id"]),
        _latest(graph.documents, new.documents, ["id"]),
        _latest(graph.relationships, new.relationships, ["src", "dst", "type"]),
    )


def set_embeddings(nodes: DataFrame, embedded: DataFrame, now: Column) -> DataFrame:
    """Nodes with embeddings (id, embedding, embedding_text) put in where there are new ones."""
    fresh = sent(embedded.select("id", *[F.col(c).alias(f"_{c}") for c in embedded.columns if c != "id"]), SENT_TEXTS)
    out = nodes.join(fresh, "id", "left").withColumn(
        "embedded_at", F.when(F.col("_embedding").isNotNull(), now).otherwise(F.col("embedded_at"))
    )
    for c in embedded.columns:
        if c != "id" and c in nodes.columns:
            out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*nodes.columns)


def without_embedding(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates (id, ...) whose stored node has no embedding yet."""
    return candidates.join(sent(stored.where("embedding IS NOT NULL").select("id")), "id", "left_anti")


def statistics(graph: Graph, top: int = 15) -> dict[str, DataFrame]:
    """Counts: nodes, relationships, entities with an embedding, and the commonest sets of labels."""
    nodes = graph.nodes
    return {
        "nodes": nodes.agg(F.count(F.lit(1)).alias("count")),
        "relationships": graph.relationships.agg(F.count(F.lit(1)).alias("count")),
        "embedded": graph.entities.agg(F.count_if(F.col("embedding").isNotNull()).alias("count")),
        "labels": label_counts(nodes, top),
    }


def label_counts(nodes: DataFrame, top: int = 15) -> DataFrame:
    counted = nodes.groupBy(label_set().alias("labels")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), F.array_join("labels", ",")).limit(top)


def clear(graph: Graph, confirm: bool = False) -> tuple[Graph, int]:
    """An empty graph and the number of nodes that went; only if confirmed."""
    if not confirm:
        raise ValueError("clearing a graph needs confirm=True")
    return empty_graph(graph.entities.sparkSession), graph.nodes.count()
