"""Ingestion jobs: which files are done, what they gave, and the run that takes the rest.

The ledger is a table with a row per (job, path); a job resumes from it after its last batch, failed files stay pending, and
fingerprints of earlier chunks come from the stored documents and from the chunks that wait to be merged, so that a resumed
job still skips what it has seen. A file of which any chunk failed is failed; only its good chunks are stored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Settings
from weftgraph.functions import text
from weftgraph.operators import chunks as chunking
from weftgraph.operators import extract
from weftgraph.operators.graph import (
    Graph,
    backfill_document_edges,
    backfill_entity_edges,
    canonical_labels,
    cut,
    set_embeddings,
    upsert,
    without_embedding,
)
from weftgraph.plans.limits import Progress, RateLimiter
from weftgraph.sources import files as sources
from weftgraph.sources.store import GRAPH_TABLES, Store

LOG = logging.getLogger(__name__)
DONE, FAILED, SKIPPED = "done", "failed", "skipped"


def mark(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with rows put in, each replacing its file's earlier state."""
    kept = ledger.join(rows.select("job_id", "path"), ["job_id", "path"], "left_anti")
    return kept.unionByName(rows.select(*ledger.columns))


def status(store: Store, job_id: str) -> dict:
    rows = store.job_files().where(F.col("job_id") == job_id)
    by = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "nodes", "rels")]).first()
    total = sum(by.values())
    state = "not_started" if not total else "completed_with_errors" if by.get(FAILED) else "completed"
    return {
        "job_id": job_id, "status": state, "total_files": total, "processed": by.get(DONE, 0), "failed": by.get(FAILED, 0),
        "skipped": by.get(SKIPPED, 0), "progress_percentage": 100.0 * by.get(DONE, 0) / total if total else 0.0, **sums.asDict(),
    }


def failed_files(store: Store, job_id: str) -> DataFrame:
    return store.job_files().where((F.col("job_id") == job_id) & (F.col("status") == FAILED)).select("path", "error")


def summary(store: Store, job_id: str, first: int = 10) -> str:
    s = status(store, job_id)
    lines = [
        f"Job {job_id}: {s['processed']} of {s['total_files']} files, {s['failed']} failed, {s['skipped']} skipped",
        f"{s['chunks']} chunks, {s['nodes']} nodes, {s['rels']} relationships",
        *(f"  {r['path']}: {r['error']}" for r in failed_files(store, job_id).orderBy("path").limit(first).collect()),
    ]
    return "\n".join(lines)


def reset(store: Store, job_id: str) -> None:
    store.write("job_files", cut(store.job_files().where(F.col("job_id") != job_id)))


def chunk_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """Pages as cleaned, numbered chunks; files of one name in several folders are several files."""
    cleaned = chunking.clean(chunking.split(pages.drop("error"), settings), settings, file_col="source_path")
    return chunking.number(cleaned, file_col="source_path")


def _limiter(settings: Settings) -> Callable[[], RateLimiter]:
    """Each of the tasks that ask a service gets its share of the budget."""
    budget, share = (settings.requests_per_minute, settings.tokens_per_minute), 1.0 / max(1, settings.extract_workers)
    return lambda: RateLimiter(*budget, share)


def extracted_pages(
    known: DataFrame, pages: DataFrame, extractor: extract.Extractor, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """The new chunks of pages with nodes, relationships and error; and per file: pages, had (its chunks), chunks, nodes, rels
    (as extracted) and error.

    At most ``settings.extract_workers`` tasks ask the extractor. A file has an error if it couldn't be read or if any of its
    chunks failed; chunks that failed are rows with an error, and aren't to be stored.
    """
    good = cut(chunk_pages(pages.where("error IS NULL"), settings))
    fresh = good
    if settings.dedup_across_job:
        fresh = chunking.without_known(chunking.across_files(good, ["source_path", "chunk_index"]), known)
    fresh = fresh.repartition(max(1, settings.extract_workers))
    found = cut(extract.extract(fresh, extractor, settings=settings, limiter_for=_limiter(settings)))
    gave = found.groupBy("source_path").agg(
        F.count_if(F.col("error").isNull()).alias("chunks"), F.sum(F.size("nodes")).alias("nodes"),
        F.sum(F.size("relationships")).alias("rels"), F.count(F.col("error")).alias("failed"), F.min("error").alias("chunk_error"),
    )
    per_file = pages.groupBy("source_path").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("pages"))
    had = good.groupBy("source_path").agg(F.count(F.lit(1)).alias("had"))
    joined = per_file.join(had, "source_path", "left").join(gave, "source_path", "left")
    told = F.concat(F.col("failed").cast("string"), F.lit(" chunks failed: "), F.col("chunk_error"))
    return found, joined.withColumn("error", F.coalesce("error", F.when(F.col("failed") > 0, told))).drop("failed", "chunk_error")


def merge_extracted(
    graph: Graph, found: DataFrame, embedder: Callable[[Sequence[str]], list[list[float]]], now: Column, settings: Settings = Settings()
) -> Graph:
    """The graph with extracted chunks merged in, embedded, and with the provenance of its relationships filled in."""
    nodes = canonical_labels(extract.enriched_nodes(found))
    rels = extract.enriched_relationships(found, now)
    documents = found.select(
        "id", "text", "source_file", "source_path", "page", "chunk_index", "content_fingerprint", "char_count",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("timestamp").alias("embedded_at"),
    )
    entities = chunking.first_of(nodes, ["id"], ["source_chunk"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("embedding_text", "string"), ("embedding", "array<float>"), ("embedded_at", "timestamp"))]
    rels = rels.groupBy("src", "dst", "type").agg(F.min_by(F.struct(*[c for c in rels.columns if c not in ("src", "dst", "type")]), "source_chunk").alias("r"))
    rels = rels.select("src", "dst", "type", "r.*")
    merged = upsert(graph, Graph(entities.select("*", *none), documents, rels))

    # only what has no embedding yet is sent to the service
    asked = merged.entities.withColumn("embedding_text", text.embedding_text(F.coalesce("name", "id"), "description"))
    bare = asked.select("id", "embedding_text")
    bare_documents = merged.documents.select("id", "text")
    if settings.skip_existing_embeddings:
        bare, bare_documents = without_embedding(bare, merged.entities), without_embedding(bare_documents, merged.documents)
    workers, limiter = max(1, settings.extract_workers), _limiter(settings)
    vectors, document_vectors = (
        cut(extract.embed(frame.repartition(workers), embedder, text_col=c, settings=settings, limiter_for=limiter)).where("embedding IS NOT NULL")
        for frame, c in ((bare, "embedding_text"), (bare_documents, "text"))
    )
    merged = merged.with_(
        entities=cut(set_embeddings(merged.entities, vectors, now)),
        documents=cut(set_embeddings(merged.documents, document_vectors.drop("text"), now)),
    )
    merged = merged.with_(relationships=cut(backfill_document_edges(merged, now)))
    return merged.with_(relationships=cut(backfill_entity_edges(merged, now)))


def run(
    store: Store,
    folder: str,
    job_id: str,
    extractor: extract.Extractor,
    embedder: Callable[[Sequence[str]], list[list[float]]],
    now: Column,
    *,
    resume: bool = True,
    settings: Settings = Settings(),
    reader: Callable[[bytes], Sequence[str]] = sources.pdf_reader,
    on_progress: Callable[[str], None] = LOG.info,
) -> str:
    """Takes a folder's files that aren't done, batch by batch, and merges what they gave; the job's summary.

    A batch's chunks, with what the extractor made of them, and its files' ledger are one commit: a job that stops goes on
    after its last batch and asks the extractor nothing twice. The graph is merged and embedded once, after the last batch,
    from all chunks that wait for it, in one commit as well.
    """
    spark: SparkSession = store.spark
    if not resume:
        reset(store, job_id)
    listed = sources.list_files(spark, folder, recursive=True, ordered=False)
    if listed.select("path").isEmpty():
        return "No PDF or TXT files found in the folder."
    done = store.job_files().where((F.col("job_id") == job_id) & F.col("status").isin(DONE, SKIPPED))
    batches = cut(sources.batches(listed, done, settings.checkpoint_files))
    total = batches.count()
    progress = Progress(total, on_progress)
    for number in range(-(-total // settings.checkpoint_files)):
        progress.start()
        # the paths of one batch
        paths = [r["path"] for r in batches.where(F.col("batch") == number).select("path").collect()]
        pages = cut(sources.pages(sources.few_tasks(sources.files_at(spark, paths)), reader))
        known = store.graph().documents.select("content_fingerprint").unionByName(store.extracted().select("content_fingerprint"))
        found, gave = extracted_pages(known, pages, extractor, settings)
        state = F.when(F.col("error").isNotNull(), FAILED).when(F.coalesce("had", F.lit(0)) == 0, SKIPPED).otherwise(DONE)
        rows = gave.select(
            F.lit(job_id).alias("job_id"), F.col("source_path").alias("path"), state.alias("status"), "error",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chunks", "nodes", "rels")],
            F.lit(folder).alias("folder"), now.alias("finished"),
        )
        rows = cut(rows)
        store.commit(
            {"job_files": mark(store.job_files(), rows)}, {"extracted": found.where("error IS NULL").select(*store.extracted().columns)}
        )
        given = rows.select("chunks", "nodes", "rels", "error").collect()
        totals = [sum(r[c] for r in given) for c in ("chunks", "nodes", "rels")]
        LOG.info("batch %d of job %s: %d chunks, %d nodes, %d relationships", number + 1, job_id, *totals)
        progress.finish_all([(r["chunks"], r["error"]) for r in given])
    merge(store, embedder, now, settings)
    return summary(store, job_id)


def merge(store: Store, embedder: Callable[[Sequence[str]], list[list[float]]], now: Column, settings: Settings = Settings()) -> None:
    """Merges the chunks that wait into the graph; does nothing if there are none."""
    waiting = store.extracted()
    if not waiting.isEmpty():
        graph = merge_extracted(store.graph(), waiting, embedder, now, settings)
        store.commit({**{name: getattr(graph, name) for name in GRAPH_TABLES}, "extracted": None})


def prepare(store: Store, now: Column) -> None:
    """Puts the whole stored graph in order: canonical labels, provenance of all relationships, tables laid out by their keys."""
    graph = store.graph()
    graph = graph.with_(entities=cut(canonical_labels(graph.entities)))
    graph = graph.with_(relationships=cut(backfill_document_edges(graph, now)))
    graph = graph.with_(relationships=cut(backfill_entity_edges(graph, now)))
    store.commit(store.optimized(graph))


def retry_failed(store: Store, job_id: str, *args, **options) -> str:
    """Runs a job again over its own folder; its failed files are still pending."""
    row = store.job_files().where((F.col("job_id") == job_id) & F.col("folder").isNotNull()).select("folder").first()
    if row is None or failed_files(store, job_id).isEmpty():
        return "No failed files to retry."
    return run(store, row["folder"], job_id, *args, **options)
