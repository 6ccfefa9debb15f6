from __future__ import annotations

import json

import pytest

from weftgraph import cli
from weftgraph.config import Settings
from weftgraph.operators.extract import HashingEmbedder
from weftgraph.plans import evaluate, hybrid
from weftgraph.plans.agent import Agent, message_text
from weftgraph.plans.engine import Engine
from weftgraph.plans.planner import Cache, Planner, extractive_answer, parse_reply

LOOSE = Settings(entity_threshold=0.55, document_threshold=0.55)


@pytest.fixture(scope="module")
def engine(spark, golden):
    return Engine(spark, graph=golden, embedder=HashingEmbedder(64), settings=LOOSE)


def test_plans_without_a_model():
    p = Planner()
    assert p.sub_questions(" who  made GPT-4 and why? ") == ["who made GPT-4 and why?"] and p.sub_questions("") == []
    plan = p.retrieval_plan("How many GPT-4 models, gpt-4?")
    assert plan["lexical_keywords"] == ["How", "many", "GPT-4", "models"] and plan["numeric_focus"] and plan["min_lexical_hits"] == 2


def test_plans_with_a_model():
    said = []

    def model(prompt):
        said.append(prompt)
        if "sub_questions" in prompt:
            return '```json\n{"sub_questions": ["A is?", "a is", "B;", 3, ""]}\n```'
        return json.dumps({"semantic_queries": ["x"] * 9 + ["y"], "lexical_keywords": "no", "min_lexical_hits": "9"})

    p = Planner(model=model)
    assert p.sub_questions("A and B?") == ["A is?", "a is", "B"]
    assert p.sub_questions("a  AND b?") == ["A is?", "a is", "B"] and len(said) == 1
    assert p.sub_questions("only one?") == ["only one?"] and len(said) == 1
    plan = p.retrieval_plan("A and B?")
    assert plan["semantic_queries"] == ["x", "y"] and plan["lexical_keywords"] == [] and plan["min_lexical_hits"] == 4
    broken = Planner(model=lambda _: "no json")
    assert broken.sub_questions("A and B?") == ["A and B?"] and broken.retrieval_plan("A and B?")["min_lexical_hits"] == 2


def test_curation():
    chunks = [{"id": "1", "content": "a", "score": 0.2}, {"id": "2", "content": "b", "score": 0.9}, {"id": "3", "content": "c", "score": 0.5}]
    chosen, snippets = Planner().curate("plain question", chunks, 2)
    assert [c["id"] for c in chosen] == ["2", "3"] and snippets == []
    reply = json.dumps({"selected_chunk_ids": ["1", "zz"], "evidence_snippets": [{"chunk_id": "1", "text": "q" * 300}, {"chunk_id": "9", "text": "no"}]})
    chosen, snippets = Planner(model=lambda _: reply).curate("this and that", chunks, 2)
    assert [c["id"] for c in chosen] == ["1", "2"] and snippets == ["q" * 220]


def test_small_parts():
    assert parse_reply([{"text": '{"a": 1}'}]) == {"a": 1} and parse_reply("[1]") is None
    c = Cache(2)
    for k in ("a", "b", "c"):
        c.put(k, k)
    assert c.get("a") is None and c.get(" C ") == "c"
    assert "not found in the provided source" in extractive_answer("q", "")
    assert message_text(["a", {"text": "b"}, {"x": 1}]) == "ab"
    assert hybrid.confidence([{"score": 0.97}, {"score": 0.7767}, {"score": 0.7167}], [{"score": 0.9}], [], 1.0, False) == 0.802


def test_an_answer_from_graph_and_documents(engine):
    found = engine.ask("GPT-4 model developed by OpenAI")
    assert found["status"] == "success" and found["method"] == "hybrid_sota" and found["doc_chunks_used"] == 1
    assert "GPT-4" in {e["id"] for e in found["entities_found"]} and 0 < found["confidence"] <= 1
    assert found["sub_question_coverage"] == 1.0 and found["global_context"]["communities"]
    assert set(found) == {
        "answer", "entities_found", "graph_context", "bridge_nodes", "global_context", "doc_chunks_used", "sub_questions",
        "sub_question_coverage", "confidence", "method", "status",
    }
    report = evaluate.run(engine.ask, [evaluate.Case("GPT-4 model developed by OpenAI", ("openai",)), evaluate.Case("zebra stripes", ("zebra",))])
    assert report["total_cases"] == 2 and report["passed_cases"] == 1 and report["pass_rate"] == 0.5


def test_no_evidence_and_failures(spark, golden):
    strict = Engine(spark, graph=golden, embedder=HashingEmbedder(64), settings=Settings(entity_threshold=0.99, document_threshold=0.99))
    found = strict.ask("zebra stripes")
    assert (found["method"], found["confidence"]) == ("grounded_abstain", 0.05)

    def fail(question, context):
        raise RuntimeError("down")

    broken = Engine(spark, graph=golden, embedder=HashingEmbedder(64), settings=LOOSE, synthesize=fail).ask("GPT-4 model developed by OpenAI")
    assert broken["status"] == "error" and broken["confidence"] <= 0.2
    shrug = Engine(spark, graph=golden, embedder=HashingEmbedder(64), settings=LOOSE, synthesize=lambda q, c: "It is common knowledge.")
    assert shrug.ask("GPT-4 model developed by OpenAI")["method"] == "hybrid_abstain"


def test_exploring(engine):
    context = engine.entity_context("GPT-4", 1)
    assert context["sources"] == [{"id": "doc1", "name": None}] and context["relationship_types"] == ["DEVELOPED_BY", "EVALUATED_ON", "IMPLEMENTS", "USES_ARCHITECTURE"]
    assert engine.entity_context("nobody")["relationship_types"] == []
    wide = engine.multi_entity_context(["GPT-4", "Claude-3"], 1)
    assert {b["id"] for b in wide["bridge_nodes"]} == {"RLHF", "Transformer"} and len(wide["relationship_chains"]) == 8
    assert engine.multi_entity_context([])["entities"] == [] and "None" in engine.multi_entity_context(["zz"])["context_summary"]
    assert engine.find_connections("gpt-4", "Microsoft")["hops"] == 2 and not engine.find_connections("gpt-4", "??")["connected"]
    info = engine.model_info("GPT-4: GPT-4 is a AIModel known to many people")
    assert info["found"] and [x["id"] for x in info["techniques"]] == ["RLHF"] and [x["id"] for x in info["developed_by"]] == ["OpenAI"]
    text = "{0}: {0} is a AIModel known to many people"
    compared = engine.compare_models(text.format("GPT-4"), text.format("Claude-3"))
    assert (compared["common_techniques"], compared["common_benchmarks"], compared["directly_connected"]) == (1, 0, True)
    assert engine.lineage("RLHF")["count"] == 2 and engine.neighbors("GPT-4").count() == 4
    assert engine.check()


def test_sql(engine):
    assert engine.execute_sql("SELECT count(*) AS n FROM nodes WHERE array_contains(labels, :l)", {"l": "AIModel"}) == [{"n": 3}]
    assert engine.execute_sql("SELECT id FROM neighbors_of('OpenAI') ORDER BY id") == [{"id": "GPT-3.5"}, {"id": "GPT-4"}, {"id": "Microsoft"}]
    assert "error" in engine.execute_sql("DROP VIEW nodes")[0] and "error" in engine.execute_sql("SELECT zz FROM nodes")[0]
    assert engine.query("How many AIModels are there?") == [{"count": 3}]
    assert {r["id"] for r in engine.query("What is connected to OpenAI?")} == {"GPT-3.5", "GPT-4", "Microsoft"}


def test_tools_and_agent(engine):
    agent = Agent(engine)
    assert agent.ask("How is GPT-4 related to Microsoft?")["answer"].startswith("Connected: GPT-4 --")
    assert "joined by" in agent.ask("What joins GPT-4 and Claude-3?")["answer"]
    assert agent.ask("What is OpenAI?", detailed_trace=True)["trace"][0]["tool"] == "get_entity_context"
    tools = agent.tools
    assert "at least two" in tools.multi_hop_search("GPT-4") and "GPT-4" in tools.explore_neighborhood("GPT-4", 1)
    assert "a.txt" in tools.search_documents("GPT-4 is a large model that was developed by OpenAI.") and tools.search_vector_store("GPT-4 model", 2)


def test_command_line(spark, engine, tmp_path, capsys):
    assert cli.chat_line(engine, "connect GPT-4 to Microsoft").startswith("GPT-4 --") and cli.chat_line(engine, "quit") is None
    assert cli.chat_line(engine, "connect a to b to c") == "connect A to B" and "nodes" in cli.chat_line(engine, "stats")
    assert cli.main([str(tmp_path / "s"), "stats"], spark) == 0 and '"nodes": 0' in capsys.readouterr().out


def test_the_hybrid_query_asks_the_whole_text(spark, monkeypatch):
    from tests.conftest import SF
    from weftgraph.plans import catalog

    asked = []
    whole = catalog.table(spark, SF, "benchmark").where("item_id = 0").first()["text"]
    monkeypatch.setattr(catalog.Hybrid, "answer", lambda self, question: asked.append(question) or {
        "status": "", "method": "", "confidence": 0.0, "doc_chunks_used": 0, "entities_found": [],
    })
    catalog.hybrid_query(spark, SF)
    assert asked == [whole] and len(whole) > 200


def test_plain_questions_become_statements(engine):
    assert engine.query("How many companies are known?") == [{"count": 0}] and engine.query("how many AICompany nodes?") == [{"count": 3}]
    assert engine.query("How many relationships are there?") == [{"count": 12}]
    assert {r["id"] for r in engine.query("What is connected to microsoft?")} == {"OpenAI"}
    assert {r["id"] for r in engine.query("Who developed GPT-4?")} == {"OpenAI"}
    assert {r["id"] for r in engine.query("What was evaluated on MMLU?")} == {"GPT-4"}
    assert {r["id"] for r in engine.query("Show all techniques")} == {"RLHF"}
    assert engine.query("What is RLHF?")[0]["description"].startswith("RLHF is a Technique")
    assert engine.query("Which is the most connected?")[0]["id"] == "GPT-4"
    assert "error" in engine.query("Hello there")[0]


def test_an_agent_with_a_model(engine):
    said = []

    def model(prompt):
        said.append(prompt)
        if len(said) == 1:
            return '{"tool": "find_connections", "arguments": ["GPT-4", "Microsoft"]}'
        if len(said) == 2:
            return [{"text": '```json\n{"tool": "get_entity_context", "arguments": []}\n```'}]
        return '{"answer": "By OpenAI."}'

    found = Agent(engine, model).ask("How are GPT-4 and Microsoft connected?")
    assert found["answer"] == "By OpenAI." and [t["tool"] for t in found["trace"]] == ["find_connections", "get_entity_context"]
    assert "PARTNERED_WITH" in said[1] and "Error" in said[2] and found["status"] == "success"
    # a model that says nothing useful, or never ends, leaves it to the router
    for reply in ("no idea", '{"tool": "search_documents", "arguments": ["x"]}'):
        found = Agent(engine, lambda _, reply=reply: reply).ask("How are GPT-4 and Microsoft connected?")
        assert "PARTNERED_WITH" in found["answer"] and len(found["trace"]) == 1
