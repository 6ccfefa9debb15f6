"""One object for everything a user of the library does: ingest, explore, connect, compare, ask, query."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Settings
from weftgraph.functions import text
from weftgraph.operators import extract, search, traverse
from weftgraph.operators.graph import Graph, has_label, statistics
from weftgraph.plans import jobs
from weftgraph.plans.hybrid import Hybrid
from weftgraph.plans.planner import Planner, extractive_answer
from weftgraph.sources import files
from weftgraph.sources.store import Store

#: Words that a read-only statement doesn't have, even inside literals.
WRITES = re.compile(
    r"\b(create|merge|delete|detach|set|drop|remove|insert|update|truncate|alter|load|foreach|replace|overwrite|refresh|cache|"
    r"uncache|clear|add|analyze|msck|use|grant|revoke)\b",
    re.IGNORECASE,
)


#: Words of a question that name a type of relationship.
RELATION_WORDS = (
    ("develop", "DEVELOPED_BY"), ("train", "TRAINED_ON"), ("fine-tun", "FINE_TUNED_FROM"), ("based on", "BASED_ON"),
    ("evaluat", "EVALUATED_ON"), ("outperform", "OUTPERFORMS"), ("implement", "IMPLEMENTS"), ("partner", "PARTNERED_WITH"),
    ("acquire", "ACQUIRED"), ("author", "AUTHORED"), ("create", "CREATED"), ("use", "USES_ARCHITECTURE"),
)
_CALLED = "lower(coalesce(name, id)) = lower(:name)"
#: Relationships from either end. Nodes of one name are few and are sent to them: relationships stay where they are.
_ENDS = "SELECT src AS node, dst AS id, type FROM relationships UNION ALL SELECT dst, src, type FROM relationships"
#: Forms of questions with statements over the views; a group is a parameter, by its place.
TEMPLATES = (
    (r"how many (?:relationships|edges|connections)\b.*(?:type|kind)", "SELECT type, count(*) AS count FROM relationships GROUP BY type ORDER BY count DESC, type", ()),
    (r"how many (?:relationships|edges|connections)\b", "SELECT count(*) AS count FROM relationships", ()),
    (r"how many (?:nodes|entities)\b", "SELECT count(*) AS count FROM nodes", ()),
    (r"how many (\w+)", "SELECT count(*) AS count FROM nodes WHERE exists(labels, l -> lower(l) LIKE :label)", ("label",)),
    (r"most connected", """SELECT id, count(*) AS degree FROM (SELECT src AS id FROM relationships UNION ALL SELECT dst FROM relationships)
        GROUP BY id ORDER BY degree DESC, id LIMIT 10""", ()),
    (r"(?:connected|related) to (.+?)\??$", f"""SELECT id, type FROM (SELECT /*+ BROADCAST(a) */ DISTINCT a.id AS node, n.id, n.type
        FROM (SELECT id FROM nodes WHERE {_CALLED}) a JOIN ({_ENDS}) n ON n.node = a.id)""", ("name",)),
    (r"(?:who|what|which \w+) (?:has |have |is |are |was |were )?(\w[\w-]*(?: on| with)?) (?:by |from )?(.+?)\??$", f"""SELECT DISTINCT o.id, coalesce(o.name, o.id) AS name, r.type
        FROM nodes a JOIN relationships r ON r.type = :cue AND a.id IN (r.src, r.dst) JOIN nodes o ON o.id = CASE WHEN r.src = a.id THEN r.dst ELSE r.src END
        WHERE {_CALLED.replace('name, id', 'a.name, a.id')} ORDER BY o.id""", ("cue", "name")),
    (r"(?:list|show|which) (?:all |the |me )*(\w+)\??$", """SELECT id, coalesce(name, id) AS name FROM nodes
        WHERE exists(labels, l -> lower(l) LIKE :label) ORDER BY id""", ("label",)),
    (r"(?:what|who) (?:is|are|was) (.+?)\??$", f"SELECT id, name, labels, description FROM nodes WHERE {_CALLED} ORDER BY id", ("name",)),
)
#: Rows that reach the driver at most, of a statement or of a context.
MOST_ROWS = 100_000


def is_read_only(statement: str | None) -> bool:
    return bool(statement and statement.strip()) and not WRITES.search(statement)


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        *,
        graph: Graph | None = None,
        settings: Settings | None = None,
        extractor: extract.Extractor | None = None,
        embedder: Callable[[Sequence[str]], list[list[float]]] | None = None,
        planner: Planner | None = None,
        synthesize: Callable[[str, str], str] = extractive_answer,
        reader: Callable[[bytes], Sequence[str]] = files.pdf_reader,
    ):
        self.spark, self.settings = spark, settings or Settings()
        self.store = Store(spark, path) if path else None
        self._graph = graph
        self.extractor = extractor or extract.GazetteerExtractor({})
        self.embedder = embedder or extract.HashingEmbedder()
        self.planner = planner or Planner(self.settings)
        self.synthesize, self.reader = synthesize, reader

    @property
    def graph(self) -> Graph:
        if self._graph is not None:
            return self._graph
        if self.store is None:
            raise ValueError("the engine has neither a graph nor a path")
        return self.store.graph()

    def _node(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _embed_one(self, value: str) -> list[float]:
        return self.embedder([value])[0]

    # ------------------------------------------------------------ ingestion

    def check(self) -> bool:
        """Whether the session works and the store's folder, if there is a store, can be written to."""
        return self.spark.range(1).count() == 1 and (self.store is None or self.store.probe())

    def refresh(self) -> None:
        """Lets the views of the tables see what has been committed since."""
        self.register_views()

    def ingest(
        self, folder: str, job_id: str = "default", *, resume: bool = True, on_progress: Callable[[str], None] = jobs.LOG.info
    ) -> str:
        return jobs.run(
            self.store, folder, job_id, self.extractor, self.embedder, F.current_timestamp(), resume=resume,
            settings=self.settings, reader=self.reader, on_progress=on_progress,
        )

    def ingest_status(self, job_id: str = "default") -> dict:
        return jobs.status(self.store, job_id)

    def retry_failed(self, job_id: str = "default") -> str:
        return jobs.retry_failed(
            self.store, job_id, self.extractor, self.embedder, F.current_timestamp(), settings=self.settings, reader=self.reader
        )

    def reset_job(self, job_id: str = "default") -> None:
        jobs.reset(self.store, job_id)

    def preview(self, folder: str) -> str:
        return files.preview(self.spark, folder, settings=self.settings)

    def statistics(self) -> dict:
        try:
            found = statistics(self.graph)
            return {k: _rows(v) if k == "labels" else v.first()[0] for k, v in found.items()}
        except Exception as e:  # noqa: BLE001  told to the caller
            return {"error": str(e)}

    def clear(self, confirm: bool = False) -> int:
        return self.store.clear(confirm)

    # ------------------------------------------------------------ search and exploration

    def vector_search(self, query: str, top_k: int = 10, threshold: float | None = None, labels: Sequence[str] | None = None) -> DataFrame:
        s = self.settings
        found = search.vector_search(
            self.graph.entities, search.query_vector(self._embed_one(query)), top_k=top_k,
            threshold=s.entity_threshold if threshold is None else threshold, labels=labels, scale=s.score_scale,
        )
        return found.select("id", "name", "description", "labels", "score")

    def document_search(self, query: str, top_k: int = 5, threshold: float | None = None) -> DataFrame:
        s = self.settings
        return search.document_search(
            self.graph.documents, search.query_vector(self._embed_one(query)), top_k=top_k,
            threshold=s.document_threshold if threshold is None else threshold, scale=s.score_scale,
        )

    def resolve(self, name_or_id: str) -> dict | None:
        return search.resolve(self.graph, name_or_id, self._embed_one, self.settings)

    def resolve_id(self, name_or_id: str) -> str | None:
        found = (self.resolve(name_or_id) or {}).get("id")
        return found if isinstance(found, str) and found.strip() else None

    def similar(self, name: str, top_k: int = 5) -> list[dict]:
        best = self.vector_search(name, 1, 0.6).first()
        if best is None:
            return []
        found = search.similar_entities(self.graph.entities, best["id"], top_k=top_k, scale=self.settings.score_scale)
        return _rows(found.select("id", "name", "description", "labels", "score"))

    def entity_context(self, entity_id: str, depth: int = 2) -> dict:
        """A node with its surroundings, its documents and a summary."""
        node = search.node_by_id(self.graph, entity_id).first()
        if node is None:
            return {
                "entity": None, "neighbors": [], "relationships": [], "relationship_types": [], "sources": [],
                "context_summary": f"There is no entity {entity_id!r}.",
            }
        found = traverse.subgraph(self.graph, self._node(entity_id), depth, excluded=self.settings.excluded_types)
        neighbors = _rows(found.nodes.orderBy("id"))
        rels = _rows(found.relationships.select("src", "dst", "type").orderBy("src", "type", "dst"))
        types = sorted({r["type"] for r in rels if r["type"]})
        about = [node["name"] or entity_id, f": {node['description']}" if node["description"] else ""]
        about.append(f" ({', '.join(node['labels'])})" if node["labels"] else "")
        about.append(f"\n{len(neighbors)} nodes within {depth} hops, by {len(types)} types of relationship")
        about.append(f": {', '.join(types)}" if types else "")
        return {
            "entity": node.asDict(recursive=True), "neighbors": neighbors, "relationships": rels, "relationship_types": types,
            "sources": [{"id": n["id"], "name": n["name"]} for n in neighbors if "Document" in (n["labels"] or [])],
            "context_summary": "".join(about),
        }

    def multi_entity_frames(self, ids: Sequence[str], depth: int = 3) -> traverse.Subgraph:
        """What several nodes have around them, and what joins them, as frames of any size."""
        return traverse.expand(self.graph, self._node(*dict.fromkeys(ids)), depth, excluded=self.settings.excluded_types)

    def multi_entity_context(self, ids: Sequence[str], depth: int = 3, limit: int = MOST_ROWS) -> dict:
        """The same as lists of at most ``limit`` nodes and relationships, in the order of their ids; ``truncated`` tells whether
        there are more, and the summary counts all."""
        empty = {"truncated": False, "entities": [], "bridge_nodes": [], "relationship_chains": [], "merged_context": {"nodes": [], "relationships": []}}
        if not ids:
            return empty | {"context_summary": "No entities were given."}
        known = _rows(self.graph.nodes.join(self._node(*dict.fromkeys(ids)), "id", "left_semi").orderBy("id"))
        if not known:
            return empty | {"context_summary": "None of the given entities is known."}
        found = self.multi_entity_frames(ids, depth)
        n_nodes, n_rels = found.nodes.count(), found.relationships.count()
        nodes, bridges = _rows(found.nodes.orderBy("id").limit(limit)), _rows(found.bridges.orderBy("id").limit(limit))
        rels = [
            {"start": r["src"], "end": r["dst"], "type": r["type"]}
            for r in found.relationships.select("src", "dst", "type").orderBy("src", "type", "dst").limit(limit).collect()
        ]
        summary = [f"{len(known)} entities: {', '.join(e['name'] or e['id'] for e in known)}"]
        if bridges:
            summary.append(f"joined by {', '.join(b['name'] or b['id'] for b in bridges[:5])}")
        summary.append(f"{n_nodes} nodes and {n_rels} relationships around them")
        return {
            "truncated": max(n_nodes, n_rels) > limit, "entities": known, "bridge_nodes": bridges, "merged_context": {"nodes": nodes, "relationships": rels},
            "relationship_chains": [f"{r['start']} --[{r['type']}]--> {r['end']}" for r in rels[:20]], "context_summary": "\n".join(summary),
        }

    def explore(self, name: str) -> dict:
        best = self.vector_search(name, 1, 0.6).first()
        if best is None:
            return {"found": False, "message": f"Nothing like {name!r} was found."}
        return {"found": True, **self.entity_context(best["id"])}

    def find_connections(self, a: str, b: str, max_depth: int | None = None) -> dict:
        ends = [self.resolve_id(x) for x in (a, b)]
        for asked, found in zip((a, b), ends, strict=True):
            if found is None:
                return {"connected": False, "path": None, "hops": -1, "description": f"There is no entity {asked!r}."}
        s = self.settings
        return traverse.find_connections(self.graph, *ends, max_depth or s.path_max_distance, excluded=s.excluded_types)

    def neighbors(self, entity_id: str, depth: int = 1, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
        found = traverse.neighbors(
            self.graph, self._node(entity_id), depth, direction=direction, types=types, excluded=self.settings.excluded_types
        )
        return found.drop("seed").orderBy("dist", "id", "relationship")

    def lineage(self, entity_id: str) -> dict:
        found = _rows(traverse.lineage(self.graph, entity_id))
        return {"origin": entity_id, "descendants": found, "count": len(found)}

    def _model(self, name: str) -> dict | None:
        best = self.vector_search(name, 1, 0.6, ["AIModel"]).first()
        if best is None:
            loose = self.vector_search(name, 3, 0.75).where(has_label("labels", "AIModel"))
            alike = loose.where(text.plain_overlap(F.lit(name), F.col("name")) >= 0.4)
            best = alike.orderBy(F.desc("score"), "id").first()
        return None if best is None else best.asDict(recursive=True)

    def model_info(self, name: str) -> dict:
        """A model's neighbours by what they are to it."""
        model = self._model(name)
        if model is None:
            return {"found": False, "message": f"There is no model {name!r}."}
        found = traverse.model_neighbors(self.graph, self._node(model["id"]), excluded=self.settings.excluded_types)
        buckets: dict[str, list[dict]] = {b: [] for b, _, _ in traverse.MODEL_BUCKETS}
        for row in _rows(found.orderBy("id", "relationship").drop("seed", "dist")):
            buckets[row.pop("bucket")].append(row)
        return {"found": True, "model": model, **buckets}

    def compare_models(self, a: str, b: str) -> dict:
        left, right = self._model(a), self._model(b)
        if left is None or right is None:
            return {"comparable": False, "message": "At least one of the models isn't known."}
        s = self.settings
        around = [traverse.model_neighbors(self.graph, self._node(m["id"]), excluded=s.excluded_types) for m in (left, right)]
        common = {r["bucket"]: r["common"] for r in traverse.common_neighbors(*around).collect()}
        path = traverse.find_connections(self.graph, left["id"], right["id"], 3, excluded=s.excluded_types)
        return {
            "comparable": True, "model_a": left, "model_b": right, **{f"common_{k}": common[k] for k in ("techniques", "benchmarks", "datasets")},
            "directly_connected": path["connected"], "connection_path": path["description"] if path["connected"] else None,
        }

    # ------------------------------------------------------------ questions and queries

    def ask(self, question: str, top_k: int = 10) -> dict:
        try:
            hybrid = Hybrid(self.graph, self.embedder, self.planner, self.settings, self.synthesize, lambda q: str(self.query(q)))
            return hybrid.answer(question, top_k)
        except Exception as e:  # noqa: BLE001  told in the response
            return {"answer": f"Error: {e}", "status": "error", "method": "hybrid", "confidence": 0.0, "doc_chunks_used": 0}

    def register_views(self) -> None:
        """The tables as views entities, documents, relationships and nodes, and neighbours as a SQL table function."""
        g = self.graph
        for name in ("entities", "documents", "relationships", "nodes"):
            getattr(g, name).createOrReplaceTempView(name)
        self.spark.sql(
            """CREATE OR REPLACE TEMPORARY FUNCTION neighbors_of(node STRING)
               RETURNS TABLE (id STRING, type STRING)
               RETURN SELECT dst, type FROM relationships WHERE src = node
                      UNION SELECT src, type FROM relationships WHERE dst = node"""
        )

    def sql(self, statement: str, params: dict | None = None) -> DataFrame:
        """A read-only statement over the views as a frame, whatever its size."""
        if not is_read_only(statement):
            raise ValueError("only read-only statements are run")
        self.register_views()
        return self.spark.sql(statement, args=params or {})

    def execute_sql(self, statement: str, params: dict | None = None, limit: int = MOST_ROWS) -> list[dict]:
        """The rows of a read-only statement over the views, or one row with an error.

        A result of more rows than ``limit`` is an error that says so: ``sql`` has no bound.
        """
        try:
            found = _rows(self.sql(statement, params).limit(limit + 1))
            return found if len(found) <= limit else [{"error": f"the result has more than {limit} rows; sql() gives it as a frame"}]
        except Exception as e:  # noqa: BLE001  told in the row
            return [{"error": str(e)}]

    def prepare(self) -> None:
        """What a database would have indexes for: the stored tables laid out by their keys, labels and provenance put right."""
        jobs.prepare(self.store, F.current_timestamp())

    def query(self, question: str) -> list[dict]:
        """Rows for plain questions, by the first template over the views that fits; see TEMPLATES."""
        for pattern, statement, names in TEMPLATES:
            if match := re.search(pattern, question.strip(), re.IGNORECASE):
                found = {n: f"%{g.strip().lower().rstrip('s')}%" if n == "label" else g.strip() for n, g in zip(names, match.groups(), strict=False)}
                if "cue" in found:
                    found["cue"] = next((t for cue, t in RELATION_WORDS if cue in found["cue"].lower()), None)
                    if found["cue"] is None:
                        continue
                return self.execute_sql(statement, found)
        return [{"error": "no template fits this question"}]
