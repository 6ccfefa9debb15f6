from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import EDGES, ids
from weftgraph.operators import aggregate, graph, rank, search, traverse
from weftgraph.operators.graph import Graph

SKIP = ("MENTIONS",)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def dist(spark, golden, start, **options):
    found = traverse.distances(golden.relationships, seeds(spark, start), options.pop("depth", 3), **options)
    return {r["id"]: r["dist"] for r in found.collect()}


def test_distances(spark, golden):
    without = dist(spark, golden, "GPT-4", excluded=SKIP)
    assert without == {
        "GPT-4": 0, "MMLU": 1, "OpenAI": 1, "RLHF": 1, "Transformer": 1, "Claude-3": 2, "GPT-3.5": 2, "Microsoft": 2,
        "Anthropic": 3, "HumanEval": 3,
    }
    every = dist(spark, golden, "GPT-4")
    assert every == without | {"doc1": 1, "Anthropic": 2}


def test_distances_agree_with_a_plain_search(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    rels = spark.createDataFrame([(a, b, "T") for a, b in pairs], "src string, dst string, type string")
    near: dict[str, set] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected, level = {"n0": 0}, {"n0"}
    for hop in range(1, 5):
        level = {y for x in level for y in near.get(x, ())} - set(expected)
        expected |= dict.fromkeys(level, hop)
    found = traverse.distances(rels, spark.createDataFrame([("n0",)], "id string"), 4)
    assert {r["id"]: r["dist"] for r in found.collect()} == expected


def test_neighbors(spark, golden):
    found = traverse.neighbors(golden, seeds(spark, "GPT-4")).collect()
    assert {(r["id"], r["relationship"]) for r in found} == {
        ("OpenAI", "DEVELOPED_BY"), ("Transformer", "USES_ARCHITECTURE"), ("RLHF", "IMPLEMENTS"), ("MMLU", "EVALUATED_ON"),
    }
    assert ids(traverse.neighbors(golden, seeds(spark, "OpenAI"), direction="in")) == {"GPT-4", "GPT-3.5"}
    assert ids(traverse.neighbors(golden, seeds(spark, "OpenAI"), direction="out")) == {"Microsoft"}
    two = traverse.neighbors(golden, seeds(spark, "GPT-4"), 2, types=["DEVELOPED_BY"]).collect()
    assert {(r["id"], r["dist"]) for r in two} == {("OpenAI", 1), ("GPT-3.5", 2)}
    assert traverse.neighbors(golden, seeds(spark, "GPT-4"), 3, limit=2).count() == 2


def test_paths(spark, golden):
    path = traverse.shortest_path(golden, "GPT-4", "Anthropic")
    assert [n["id"] for n in path["nodes"]] == ["GPT-4", "RLHF", "Claude-3", "Anthropic"]
    assert [r["type"] for r in path["relationships"]] == ["IMPLEMENTS", "IMPLEMENTS", "DEVELOPED_BY"]
    assert traverse.shortest_path(golden, "GPT-4", "Anthropic", 2) is None
    assert len(traverse.shortest_path(golden, "GPT-4", "Anthropic", excluded=())["relationships"]) == 2
    assert traverse.shortest_path(golden, "GPT-4", "nobody") is None
    assert traverse.shortest_path(golden, "GPT-4", "GPT-4")["relationships"] == []
    pairs = spark.createDataFrame([("GPT-4", "Microsoft"), ("GPT-4", "Anthropic"), ("MMLU", "HumanEval")], "start string, end string")
    found = {(r["start"], r["end"]): r["length"] for r in traverse.path_length(golden.relationships, pairs).collect()}
    assert found == {("GPT-4", "Microsoft"): 2, ("GPT-4", "Anthropic"): 3, ("MMLU", "HumanEval"): 4}


def test_connections(golden):
    found = traverse.find_connections(golden, "GPT-4", "Microsoft")
    assert found["hops"] == 2 and found["description"] == "GPT-4 --[DEVELOPED_BY]--> OpenAI --[PARTNERED_WITH]--> Microsoft"
    through = traverse.find_connections(golden, "GPT-4", "Anthropic", excluded=())
    assert through["hops"] == 1 and through["description"] == "GPT-4 --[MENTIONS]--> Anthropic"
    assert traverse.find_connections(golden, "GPT-4", "nobody")["hops"] == -1


@pytest.mark.parametrize(("depth", "edges", "nodes", "bridges"), [
    (1, 8, 8, {"RLHF", "Transformer"}), (2, 10, 10, {"Anthropic", "RLHF", "Transformer"}),
])
def test_expansion(spark, golden, depth, edges, nodes, bridges):
    found = traverse.expand(golden, seeds(spark, "GPT-4", "Claude-3"), depth)
    assert found.relationships.count() == edges and found.nodes.count() == nodes and ids(found.bridges) == bridges


def test_subgraph(spark, golden):
    found = traverse.subgraph(golden, seeds(spark, "GPT-4"), 1)
    assert ids(found.nodes) == {"GPT-4", "MMLU", "OpenAI", "RLHF", "Transformer", "doc1"} and found.relationships.count() == 4
    triangle = spark.createDataFrame([("A", "B", "T"), ("A", "C", "T"), ("B", "C", "T")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x, x, ["X"], None) for x in "ABC"], "id string, name string, labels array<string>, description string")
    small = Graph(nodes, golden.documents.limit(0), triangle)
    assert traverse.subgraph(small, seeds(spark, "A"), 1).relationships.count() == 3
    assert traverse.subgraph(small, seeds(spark, "A"), 1, edges="trail").relationships.count() == 2


def test_models(spark, golden):
    left, right = (traverse.model_neighbors(golden, seeds(spark, m)) for m in ("GPT-4", "Claude-3"))
    assert {(r["bucket"], r["id"]) for r in left.collect()} == {
        ("developed_by", "OpenAI"), ("architecture", "Transformer"), ("techniques", "RLHF"), ("benchmarks", "MMLU"),
    }
    common = {r["bucket"]: r["common"] for r in traverse.common_neighbors(left, right).collect()}
    assert common == {"techniques": 1, "benchmarks": 0, "datasets": 0}


def test_lineage(spark, golden):
    papers = golden.entities.withColumn("props", F.when(F.col("id") == "Claude-3", F.create_map(F.lit("release_date"), F.lit("2024"))).otherwise(F.col("props")))
    found = traverse.lineage(golden.with_(entities=papers), "RLHF").collect()
    assert [(r["id"], r["published"]) for r in found] == [("GPT-4", "1900"), ("Claude-3", "2024")]


def test_rerank(spark, golden):
    found = spark.createDataFrame([("GPT-4", 0.95), ("GPT-3.5", 0.85), ("Claude-3", 0.75)], "id string, score double")
    out = rank.rerank(found, golden.relationships, seeds(spark, "GPT-4"))
    assert [(r["id"], r["score"]) for r in out.collect()] == [("GPT-4", 0.97), ("GPT-3.5", 0.7767), ("Claude-3", 0.7167)]
    flat = rank.rerank(found, golden.relationships, seeds(spark, "GPT-4"), graph_weight=0)
    assert flat.first()["score"] == 0.57
    close = rank.proximity(F.lit(1), 5)
    assert round(0.6 * 0.8 + 0.4 * spark.range(1).select(close).first()[0], 3) == 0.813


def test_merges(spark):
    rows = [
        ("a", None, "x", ["L"], 0.5, 0, 0), ("a", None, None, None, 0.9, 1, 0), ("a", None, "late", ["M"], 0.9, 2, 0), (None, "n", "d", None, 0.1, 0, 1),
        (None, None, "lost", None, 1.0, 0, 2),
    ]
    frame = spark.createDataFrame(rows, "id string, name string, description string, labels array<string>, score double, grp int, pos int")
    found = [(r["id"] or r["name"], r["score"], r["description"], r["labels"]) for r in rank.merge_entities(frame).collect()]
    assert found == [("a", 0.9, "late", ["M"]), ("n", 0.1, "d", None)]
    chunks = spark.createDataFrame(
        [("c", "t", 0.2, 0, 0, 0.9), ("c", "t", 0.8, 1, 0, None), (None, "u", 0.5, 0, 1, None), (None, "u", 0.4, 1, 1, None)],
        "id string, content string, score double, grp int, pos int, hybrid_score double",
    )
    assert [(r["id"], r["score"]) for r in rank.merge_chunks(chunks, 5).collect()] == [("c", 0.2), (None, 0.5)]
    snippets = spark.createDataFrame([(" b ", 0, 0), ("a", 0, 1), ("b", 1, 0), ("", 1, 1)], "snippet string, grp int, pos int")
    assert [r[0] for r in rank.merge_snippets(snippets).collect()] == ["b", "a"]


def test_confidence(spark):
    made = rank.confidence(F.array(*map(F.lit, (0.97, 0.7767, 0.7167))), F.array(F.lit(0.9)), F.lit(1.0), F.lit(0.0), F.lit(False))
    assert spark.range(1).select(made).first()[0] == 0.802
    none = F.array().cast("array<double>")
    assert spark.range(1).select(rank.confidence(none, none, F.lit(1.0), F.lit(0.0), F.lit(False))).first()[0] == 0.05
    assert spark.range(1).select(rank.confidence(none, F.array(F.lit(1.0)), F.lit(1.0), F.lit(1.0), F.lit(True))).first()[0] == 0.2


def test_relevant_chunks_and_anchors(spark):
    chunks = spark.createDataFrame([("1", "transformer models scale", 0.1), ("2", "cooking", 0.9)], "id string, content string, score double")
    kept = rank.relevant_chunks(chunks, F.lit("how do transformer models scale?"), F.array().cast("array<string>")).collect()
    assert [(r["id"], r["hybrid_score"]) for r in kept] == [("1", 1.15)]
    found = spark.createDataFrame([("x", "OpenAI", 0.2, 0), ("y", "Other", 0.9, 1)], "id string, name string, score double, pos int")
    assert [r["id"] for r in rank.anchors(found, F.lit("OpenAI?")).collect()] == ["x"]
    assert [r["id"] for r in rank.anchors(found, F.lit("nothing known")).collect()] == ["y"]


def test_statistics_and_communities(golden):
    found = graph.statistics(golden)
    assert (found["nodes"].first()[0], found["relationships"].first()[0], found["embedded"].first()[0]) == (11, 12, 10)
    assert [(r["labels"], r["count"]) for r in found["labels"].collect()][:2] == [(["AICompany"], 3), (["AIModel"], 3)]
    top = aggregate.communities(golden.entities, 2).collect()
    assert [(r["community"], r["mentions"], r["exemplars"]) for r in top][0] == ("AICompany", 3, ["Anthropic", "Microsoft", "OpenAI"])
    assert aggregate.global_facts(golden).count() == 0
    assert aggregate.global_facts(golden, excluded=()).first()["examples"] == ["Anthropic", "GPT-4"]


def test_upsert_and_labels(spark, golden):
    new = golden.with_(entities=golden.entities.where("id = 'GPT-4'").withColumn("name", F.lit(None).cast("string")).withColumn("description", F.lit("new")))
    row = graph.upsert(golden, new).entities.where("id = 'GPT-4'").first()
    assert (row["name"], row["description"]) == ("GPT-4", "new") and graph.upsert(golden, golden).relationships.count() == len(EDGES)
    labels = spark.createDataFrame([(["Aimodel", "AIModel", "Paper", "Usecase"],)], "labels array<string>")
    assert graph.canonical_labels(labels).first()[0] == ["AIModel", "Paper", "UseCase"]
    with pytest.raises(ValueError):
        graph.clear(golden)
    assert graph.clear(golden, True)[1] == 11


def test_search(spark, golden):
    from weftgraph.operators.extract import HashingEmbedder

    embed = lambda t: HashingEmbedder(64)([t])[0]
    found = search.vector_search(golden.entities, search.query_vector(embed("Transformer: Transformer is a Architecture")), top_k=3, threshold=0.5)
    assert found.first()["id"] == "Transformer"
    assert search.vector_search(golden.entities, search.query_vector(embed("x")), top_k=3, threshold=2.0).count() == 0
    assert search.resolve(golden, "GPT-4")["id"] == "GPT-4" and search.resolve(golden, "gpt-4")["id"] == "GPT-4"
    assert search.resolve(golden, "openai company")["id"] == "OpenAI" and search.resolve(golden, "??") is None
    assert search.name_search(golden.entities, "claude").first()["id"] == "Claude-3"
    similar = search.similar_entities(golden.entities, "GPT-4", top_k=2, threshold=0.0)
    assert similar.count() == 2 and "GPT-4" not in ids(similar)
    hits = search.keyword_search(golden.documents, ["OpenAI", "company", "zz", "nothing"], min_hits=2).first()
    assert (hits["hits"], hits["score"]) == (2, pytest.approx(2 / 3))
    accept = lambda q, n, s, z: spark.range(1).select(search.accepts(F.lit(q), F.lit(n), F.lit(s), F.lit(z).cast("double"))).first()[0]
    assert accept("gpt 4", "GPT-4", 0.8, None) and not accept("gpt 4", "GPT-4", 0.8, 0.79) and not accept("claude", "GPT-4", 0.99, None)


def test_large_frontiers_are_joined_by_shuffling(spark, golden, monkeypatch):
    seeds = spark.createDataFrame([("GPT-4",), ("Claude-3",)], "id string")

    def walked():
        return (
            {tuple(r) for r in traverse.distances(golden.relationships, seeds, 3).collect()},
            {tuple(r) for r in traverse.neighbors(golden, seeds, 2, limit=None).drop("labels").collect()},
            traverse.shortest_path(golden, "GPT-3.5", "MMLU"),
        )

    before = walked()
    monkeypatch.setattr(traverse, "BROADCAST_FRONTIER", 0)
    assert walked() == before and before[2] is not None
