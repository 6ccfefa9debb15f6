"""Vector, keyword and name search, and the resolution of a name to one entity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.config import Settings
from weftgraph.functions import text, vector
from weftgraph.operators.graph import Graph, has_label

K1, B = 1.2, 0.75


def _scaled(cosine: Column, scale: str) -> Column:
    if scale not in ("normalized", "raw"):
        raise ValueError(f"score_scale must be normalized or raw, not {scale!r}")
    return (1 + cosine) / 2 if scale == "normalized" else cosine


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def vector_scores(nodes: DataFrame, query: Column, *, embedding: str = "embedding", scale: str = "normalized") -> DataFrame:
    """Nodes with an embedding, with their score against the query."""
    scored = nodes.where(F.col(embedding).isNotNull()).withColumn("score", _scaled(vector.cosine(F.col(embedding), query), scale))
    return scored.where("score IS NOT NULL")


def vector_search(
    nodes: DataFrame,
    query: Column,
    *,
    top_k: int = 10,
    threshold: float = 0.7,
    labels: Sequence[str] | None = None,
    prefilter: bool = False,
    id_col: str = "id",
    scale: str = "normalized",
) -> DataFrame:
    """The top k by score, ties by id; threshold and labels are applied to those k, or to all nodes if ``prefilter``."""
    fits = F.col("score") >= threshold
    if labels:
        fits = fits & has_label("labels", *labels)
    scored = vector_scores(nodes, query, scale=scale)
    order = (F.desc("score"), F.col(id_col))
    if prefilter:
        return scored.where(fits).orderBy(*order).limit(top_k)
    return scored.orderBy(*order).limit(top_k).where(fits).orderBy(*order)


def document_search(documents: DataFrame, query: Column, *, top_k: int = 5, threshold: float = 0.72, scale: str = "normalized"):
    found = vector_search(documents, query, top_k=top_k, threshold=threshold, scale=scale)
    content = F.coalesce(F.col("text"), F.lit("")).alias("content")
    page = F.coalesce(F.col("page"), F.lit(-1)).alias("page")
    return found.select("id", content, "source_file", "source_path", page, "score")


def clean_keywords(keywords: Sequence[str]) -> list[str]:
    low = (k.strip().lower() for k in keywords if isinstance(k, str))
    return list(dict.fromkeys(k for k in low if len(k) >= 3))


def keyword_search(
    documents: DataFrame, keywords: Sequence[str], *, top_k: int = 8, min_hits: int = 2, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """Documents that contain at least so many of the keywords, by the share that they contain."""
    wanted = clean_keywords(keywords)
    if not wanted:
        return documents.limit(0).withColumn("hits", F.lit(0)).withColumn("score", F.lit(0.0))
    hits = text.keyword_hits(F.col(text_col), F.array(*map(F.lit, wanted)))
    found = documents.withColumn("hits", hits).where(F.col("hits") >= max(1, min_hits))
    return found.withColumn("score", F.col("hits") / F.lit(float(len(wanted)))).orderBy(F.desc("score"), id_col).limit(top_k)


def node_by_id(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id).limit(1)


def node_by_name(graph: Graph, name: str) -> DataFrame:
    """A node of that name, else of that name in another case; ties by id."""
    same = graph.nodes.where(F.lower("name") == name.lower())
    return same.orderBy((F.col("name") != name).cast("int"), "id").limit(1)


def name_search(entities: DataFrame, query: str, *, limit: int = 5) -> DataFrame:
    """Entities ranked by BM25 of the query's words over name and description."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "description")), F.lit("[a-z0-9]+"), F.lit(0))
    docs = entities.select("id", "name", "description", "labels", words.alias("_words"))
    asked = list(dict.fromkeys(_words(query)))
    if not asked:
        return docs.drop("_words").limit(0).withColumn("score", F.lit(0.0))
    # one pass gives the corpus' statistics for all asked words, another one the scores
    sums = [F.sum(F.array_contains("_words", w).cast("int")).alias(f"d{i}") for i, w in enumerate(asked)]
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_words")).alias("mean"), *sums).first()
    if not total["n"]:
        return docs.drop("_words").limit(0).withColumn("score", F.lit(0.0))
    score = F.lit(0.0)
    for i, w in enumerate(asked):
        df = total[f"d{i}"] or 0
        times = F.size(F.expr(f"filter(_words, x -> x = '{w}')"))  # w is of letters and digits only
        rarity = F.log(F.lit(1 + (total["n"] - df + 0.5) / (df + 0.5)))
        length = 1 - B + B * F.size("_words") / F.lit(max(total["mean"], 1e-9))
        score = score + rarity * times * (K1 + 1) / (times + K1 * length)
    return docs.withColumn("score", score).where("score > 0").drop("_words").orderBy(F.desc("score"), "id").limit(limit)


def _words(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def similar_entities(entities: DataFrame, entity_id: str, *, top_k: int = 5, threshold: float = 0.5, scale: str = "normalized"):
    """Entities nearest to a stored one, itself left out."""
    row = entities.where(F.col("id") == entity_id).select("embedding").first()
    if row is None or row[0] is None:
        return entities.limit(0).withColumn("score", F.lit(0.0))
    found = vector_search(entities, query_vector(row[0]), top_k=top_k + 1, threshold=threshold, scale=scale)
    return found.where(F.col("id") != entity_id).orderBy(F.desc("score"), "id").limit(top_k)


def accepts(query: Column, name: Column, score: Column, second: Column, settings: Settings = Settings()) -> Column:
    """Whether the best of a vector search may stand for the query: clearly ahead, and alike in its words."""
    asked, found = text.match_form(query), text.match_form(name)
    overlap = text.plain_overlap(query, name)
    within = (F.contains(found, asked) | F.contains(asked, found)) & (overlap >= settings.resolve_min_overlap)
    margin = F.coalesce(score - second, F.lit(1.0))
    sure = (score >= settings.resolve_min_score) & (margin >= settings.resolve_min_margin)
    return sure & ((asked == found) | within | (overlap >= 0.8))


def resolve(graph: Graph, name_or_id: str, embed=None, settings: Settings = Settings()) -> dict | None:
    """The node that a name or id stands for: by id, by name, by full text, by vector; the first that holds."""
    if not name_or_id or not _words(name_or_id):
        return None
    for found in (node_by_id(graph, name_or_id), node_by_name(graph, name_or_id)):
        if (row := found.first()) is not None:
            return row.asDict(recursive=True)
    top = name_search(graph.entities, name_or_id, limit=settings.fulltext_limit).limit(1)
    alike = top.where(text.plain_overlap(F.lit(name_or_id), F.col("name")) >= 0.5).first()
    if alike is not None:
        return alike.asDict(recursive=True)
    if embed is None:
        return None
    found = vector_search(
        graph.entities, query_vector(embed(name_or_id)), top_k=5, threshold=settings.resolve_min_score, scale=settings.score_scale
    )
    # at most five rows are left, so one window over all of them
    ranked = found.withColumn("_second", F.lead("score").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")))
    best = ranked.orderBy(F.desc("score"), "id").limit(1)
    name = F.coalesce("name", "id")
    row = best.where(accepts(F.lit(name_or_id), name, F.col("score"), F.col("_second"), settings)).first()
    return None if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k in ("id", "name", "description", "labels", "score")}
