"""Steps that grow with the tables: what they write, read and compute, on tables small enough for a test."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import SF
from weftgraph.functions import text
from weftgraph.operators import graph, traverse
from weftgraph.plans import catalog_engine, star_graph
from weftgraph.plans.engine import TEMPLATES, Engine
from weftgraph.sources import files


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_files_share_folders(spark):
    root = Path(catalog_engine._folder(spark, SF).removeprefix("file:"))
    texts = {r["doc_id"]: (r["text"] or "") + "\n" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {int(p.stem.removeprefix("doc_id=")): p.read_bytes().decode() for p in root.rglob("*.txt")}
    assert found == texts
    assert len([p for p in root.rglob("*") if p.is_dir()]) < len(texts) / 10  # it was a folder for each file


def test_contents_are_read_without_sorting(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    listed = lambda **how: files.list_files(spark, str(tmp_path), recursive=True, **how)
    assert "Sort" in _plan(listed()) and "Sort" not in _plan(listed(ordered=False))
    assert listed(ordered=False).select(F.col("content").cast("string")).first()[0] == "a"


def test_a_name_is_made_in_one_pass(spark):
    rows = [
        (None, "Unknown"), ("  ", "Unknown"), ("http://a/b", "External Link"), ("https://site.org/some_long-page", "some long page"),
        (" see http://x.org now ", "see now"), ("www.x.org", "Unknown"), ("x" * 60, "x" * 50 + "..."), ("word " * 20, "word " * 9 + "word..."),
        ("Title: " + "more " * 20, "Title"), ("One - " + "more " * 20, "One"), ("It's " + "more " * 20, ("It's " + "more " * 20).strip()),
    ]
    frame = spark.createDataFrame([(r[0],) for r in rows], "raw string").select("raw", text.node_name("raw").alias("name"))
    assert [tuple(r) for r in frame.collect()] == rows
    assert _plan(frame).count("regexp_replace") < 10  # the text was cleaned anew at each use, more than a hundred times


def test_an_overlap_reads_its_text_once(spark):
    frame = spark.createDataFrame([("The license is public-domain",), ("of the",), (None,), ("xlicense",)], "t string")
    out = frame.select("t", text.token_overlap(F.lit("Which license is the public one"), "t").alias("share"), text.keyword_hits("t", F.array(F.lit("lic"), F.lit("pub"))).alias("hits"))
    assert [(round(r["share"], 3), r["hits"]) for r in out.collect()] == [(0.667, 2), (0.0, 0), (0.0, 0), (0.0, 1)]
    assert _plan(out.select("share")).count("lower(coalesce(t") == 1  # three times before


def test_files_are_read_once_whatever_their_kind(spark, tmp_path):
    for name, content in (("a.txt", b"a\r\nb"), ("b.pdf", b"one. two"), ("c.md", b"c"), ("d.txt", b"\xff"), ("e.pdf", b"bad")):
        (tmp_path / name).write_bytes(content)

    def reader(content):
        return content.decode().split(". ") if content != b"bad" else 1 / 0

    listed = files.list_files(spark, str(tmp_path), (".txt", ".pdf", ".md"), recursive=True, ordered=False)
    pages = files.pages(files.few_tasks(listed), reader)
    assert _plan(pages).count("Relation [path") == 1  # a scan for each kind before
    got = {(r["source_file"], r["page"]): (r["text"], r["error"]) for r in pages.collect()}
    assert got == {
        ("a.txt", 0): ("a\nb", None), ("b.pdf", 0): ("one", None), ("b.pdf", 1): ("two", None), ("c.md", 0): (None, "unsupported file type .md"),
        ("d.txt", 0): (None, "not valid UTF-8"), ("e.pdf", 0): (None, "ZeroDivisionError: division by zero"),
    }


def _edge(*rows):
    return [(*r, None, None, None, None, None) for r in rows]


EDGE = "src string, dst string, type string, source_file string, source_chunk string, source_chunk_text string, confidence double, extracted_at timestamp"


def test_only_what_can_touch_a_document_is_joined_with_documents(spark):
    documents = spark.createDataFrame([("D1", "one", "f"), ("D3", "three", None)], "id string, text string, source_file string")
    entities = spark.createDataFrame([("A",), ("D2",), ("Z",)], "id string")
    rels = spark.createDataFrame(
        _edge(("D1", "A", "MENTIONS"), ("Z", "D3", "IS"), ("D1", "D3", "NEAR"), ("A", "Z", "KNOWS"), ("D2", "A", "IS"), ("D1", "lost", "IS"), (None, "A", "IS")), EDGE
    )
    g = graph.Graph(entities, documents, rels)
    filled = graph.backfill_document_edges(g, F.lit("2024-01-01").cast("timestamp"))
    got = {(r["src"], r["dst"]): (r["source_file"], r["source_chunk"], r["source_chunk_text"], r["confidence"]) for r in filled.collect()}
    none = (None, None, None, None)
    assert got == {
        ("D1", "A"): ("f", "D1", "one", 0.58), ("Z", "D3"): ("D3", "D3", "three", 0.7), ("D1", "D3"): none, ("A", "Z"): none, ("D2", "A"): none,
        ("D1", "lost"): none, (None, "A"): none,
    }
    assert "Union" in _plan(filled)  # all went through the joins before
    bare = graph.backfill_document_edges(g.with_(documents=documents.limit(0)), F.current_timestamp())
    assert bare.count() == 7 and bare.where("source_chunk IS NOT NULL").count() == 0


def test_facts_shuffle_only_what_can_begin_at_a_document(spark):
    g = star_graph.star_graph(spark, SF)
    can_be = graph.spanned(g.documents.select("id"))
    kept = graph.undirected(g.relationships).where(can_be("src"))
    assert {r[0] for r in kept.select("type").distinct().collect()} == {"MENTIONS"}  # orders and line items went to the join before


def test_a_named_node_is_sent_to_the_relationships(spark):
    rels = spark.createDataFrame([("a", "x", "R"), ("x", "b", "R"), ("x", "b", "R"), ("c", "y", "S"), ("x", "x", "S"), ("a", "z", "R")], "src string, dst string, type string")
    ents = spark.createDataFrame([(i, n, ["L"], None) for i, n in (("x", "Both"), ("y", "both"), ("z", None))], "id string, name string, labels array<string>, description string")
    docs = spark.createDataFrame([], "id string")
    engine = Engine(spark, graph=graph.Graph(ents, docs, rels))
    rows = engine.query("What is connected to Both?")
    assert sorted((r["id"], r["type"]) for r in rows) == [("a", "R"), ("b", "R"), ("c", "S"), ("x", "S")]
    statement, = (s for pattern, s, _ in TEMPLATES if pattern.startswith("(?:connected"))
    plan = engine.sql(statement, {"name": "Both"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_links_are_written_once_for_both_ends(spark):
    rels = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "c", "R")], "src string, dst string, type string")
    links = traverse._links(rels, "both", 3)
    assert sorted(tuple(r) for r in links.collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "c"), ("c", "c")]
    assert "explode" in _plan(links)  # both directions were written before
    assert sorted(tuple(r) for r in traverse._links(rels, "in", 3).collect()) == [("b", "a"), ("c", "b"), ("c", "c")]


def test_distinct_pairs_take_tasks_by_their_rows(spark, monkeypatch):
    frame = spark.range(100).selectExpr("id % 40 AS a", "id % 8 AS b")
    monkeypatch.setattr(star_graph, "PAIRS_OF_A_TASK", 10)
    pairs = star_graph._pairs(frame, "a", "b")
    assert pairs.count() == 40 and pairs.rdd.getNumPartitions() == 10  # 4 at most before, as the session has it


def test_identifiers_are_sent_by_their_number(spark, tmp_path, monkeypatch):
    travels = graph.travels
    monkeypatch.setattr(graph, "travels", lambda rows, most=100: travels(rows, min(most, 100)))
    # equal columns take no room in a file, so that Spark takes the entities for small
    ids = spark.range(5000).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("id"))
    ids.select("id", F.lit("f").alias("source_document"), F.lit("c").alias("source_chunk")).write.parquet(f"{tmp_path}/e")
    entities = spark.read.parquet(f"{tmp_path}/e")
    rels = spark.createDataFrame([("E1", "E2", "T")], "src string, dst string, type string").select("*", *[
        F.lit(None).cast(t).alias(c) for c, t in (("source_file", "string"), ("source_chunk", "string"), ("source_chunk_text", "string"), ("confidence", "double"), ("extracted_at", "timestamp"))
    ])
    documents = ids.select(F.concat(F.lit("D"), "id").alias("id"), F.lit("f").alias("source_file"), F.lit("t").alias("text"))
    g, now = graph.Graph(entities, documents, rels), F.lit("2024-01-01").cast("timestamp")
    for out in (graph.backfill_document_edges(g, now), graph.backfill_entity_edges(g, now)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()  # all entities were collected in the driver before
    assert [tuple(r) for r in out.select("src", "source_file", "source_chunk", "confidence").collect()] == [("E1", "f", "c", 0.68)]
    few = graph.Graph(entities.limit(3), documents.limit(3), rels)
    assert "BroadcastHashJoin" in graph.backfill_entity_edges(few, now)._jdf.queryExecution().executedPlan().toString()


def test_a_search_between_few_nodes_meets_half_way(spark, monkeypatch):
    # a hub with many spokes; the targets lie on a path from the seed, one beyond the depth and one nowhere
    hub = [("A", f"X{i}", "T") for i in range(500)] + [(f"X{i}", f"Y{i}", "T") for i in range(500)]
    path = [(a, b, "T") for a, b in zip("ABCDEFG", "BCDEFGH", strict=True)]
    rels = spark.createDataFrame(hub + path + [("A", "H", "MENTIONS")], "src string, dst string, type string")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    seeds, targets = frame("A", "A"), frame("A", "B", "D", "F", "H", "X7", "Z")
    rows = []
    real = traverse._small
    monkeypatch.setattr(traverse, "_small", lambda frame, n: rows.append(n) or real(frame, n))
    for depth in (1, 4, 5):
        every = {r["id"]: r["dist"] for r in traverse.distance_to_any(rels, seeds, depth, excluded=["mentions"]).collect()}
        wanted = {k: v for k, v in every.items() if k in "ABDFHZ" or k == "X7"}
        for few in (0, 100):
            monkeypatch.setattr(traverse, "FEW_TARGETS", few)
            found = traverse.distance_between(rels, seeds, targets, depth, excluded=["mentions"]).collect()
            assert {r["id"]: r["dist"] for r in found} == wanted and len(found) == len(wanted)
    rows.clear()
    traverse.distance_between(rels, seeds, frame("B", "C"), 5).collect()
    assert max(rows) < 600  # all of the hub's surroundings, 1,000 rows and more, were walked to the full depth before


def test_vectors_are_those_of_each_feature_alone(spark):
    import hashlib
    import re

    value, dim = "Some words, some WORDS again; ä b2 some", 16
    words = re.findall("[a-z0-9]+", value.lower())
    row = [0.0] * dim
    for feature in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        row[h % dim] += 1.0 if h >> 63 else -1.0
    size = sum(x * x for x in row) ** 0.5
    from weftgraph.operators.extract import HashingEmbedder

    assert HashingEmbedder(dim)([value, None, ""]) == [[x / size for x in row], [0.0] * dim, [0.0] * dim]
