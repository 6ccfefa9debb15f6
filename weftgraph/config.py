"""Settings of the engine. Every value can be overridden per engine; nothing is read at import time."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

# The vocabularies of entity labels and relationship types.
ENTITY_LABELS = (
    "AIModel", "AICompany", "Researcher", "Paper", "Dataset", "Architecture", "Technique", "Benchmark", "Framework",
    "Application", "UseCase", "Feature", "Concept", "Organization", "Event", "License",
)
RELATIONSHIP_TYPES = (
    "DEVELOPED_BY", "CREATED", "AUTHORED", "TRAINED_ON", "FINE_TUNED_FROM", "USES_ARCHITECTURE", "IMPLEMENTS", "BASED_ON",
    "EXTENDS", "REQUIRES", "EVALUATED_ON", "OUTPERFORMS", "ACHIEVES", "POWERS", "HAS_FEATURE", "SUPPORTS", "ENABLES",
    "AFFILIATED_WITH", "ACQUIRED", "PARTNERED_WITH", "FUNDED_BY", "RELEASED_AT", "LICENSED_UNDER", "RELATED_TO",
    "SIMILAR_TO", "CONTRASTS_WITH", "PART_OF", "INSTANCE_OF", "SUCCEEDED_BY",
)
# What entities and relationships may carry besides their keys.
ENTITY_FIELDS = {
    "AIModel": ("release_date", "parameters", "context_length", "training_tokens", "modality", "open_source", "version"),
    "AICompany": ("founded_date", "headquarters", "valuation", "employee_count", "website"),
    "Researcher": ("affiliation", "h_index", "notable_work"),
    "Paper": ("abstract", "publication_date", "venue", "citation_count", "arxiv_id", "doi"),
    "Architecture": ("introduced_in", "key_innovation"),
    "Technique": ("category", "introduced_in"),
}
RELATIONSHIP_FIELDS = {
    "OUTPERFORMS": ("benchmark", "score_difference", "metric"),
    "ACHIEVES": ("score", "metric", "date"),
    "TRAINED_ON": ("data_percentage", "tokens_used"),
    "FINE_TUNED_FROM": ("method", "dataset_used"),
}


def parse_bool(value: str) -> bool:
    return value.strip().lower() in {"1", "true", "yes", "y", "on"}


def parse_csv(value: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.split(",") if x.strip())


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 2000
    chunk_overlap: int = 200
    min_chunk_chars: int = 1
    normalize_whitespace: bool = True
    dedup_within_file: bool = True
    dedup_across_job: bool = True
    chunk_batch: int = 50
    extract_workers: int = 5
    batches_per_worker: int = 2
    min_batches_per_file: int = 8
    embed_batch: int = 96
    #: Files of a job's batch: what a job that stops has to do again at most.
    checkpoint_files: int = 1000
    embedding_dimension: int = 3072
    skip_existing_embeddings: bool = True
    requests_per_minute: int = 500
    tokens_per_minute: int = 150_000
    tokens_per_chunk: int = 2000
    max_retries: int = 3
    retry_delay: float = 5.0
    entity_threshold: float = 0.7
    document_threshold: float = 0.72
    document_top_k: int = 7
    fallback_depth: int = 10
    context_depth: int = 3
    #: Nodes, relationships and bridges of an expansion that reach the driver at most.
    context_rows: int = 10_000
    vector_weight: float = 0.6
    graph_weight: float = 0.4
    excluded_types: tuple[str, ...] = ("MENTIONS",)
    path_max_distance: int = 5
    global_context: bool = True
    max_communities: int = 5
    max_facts: int = 8
    resolve_min_score: float = 0.78
    resolve_min_margin: float = 0.06
    resolve_min_overlap: float = 0.5
    fulltext_limit: int = 5
    sql_fallback: bool = False
    ungrounded_min: float = 0.05
    ungrounded_max: float = 0.25
    min_evidence: int = 1
    planner_fast_path: bool = True
    plan_cache: bool = True
    plan_cache_size: int = 256
    #: "normalized" reports (1 + cos) / 2, "raw" the cosine itself.
    score_scale: str = "normalized"

    def with_(self, **values) -> Settings:
        return replace(self, **values)

    @classmethod
    def from_env(cls, prefix: str = "WEFTGRAPH_", env: dict[str, str] | None = None) -> Settings:
        """Settings from variables such as WEFTGRAPH_CHUNK_SIZE."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            if (raw := env.get(prefix + f.name.upper())) is not None:
                kind = type(getattr(cls(), f.name))
                found[f.name] = {bool: parse_bool, tuple: parse_csv}.get(kind, kind)(raw)
        return cls(**found)
