"""The engine's tools as functions that return text, and what chooses among them: a language model, if one is plugged in, that
calls tools until it answers, or else a router by the question's form."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable

from weftgraph.plans.engine import Engine
from weftgraph.plans.planner import parse_reply

EXCERPT = 500
#: Tools that a model may call for one question.
MOST_STEPS = 8
TOOLS = (
    "search_vector_store", "get_entity_context", "find_connections", "search_documents", "explore_neighborhood", "multi_hop_search",
)


def message_text(content) -> str:
    """The text of a message's content: a string, or a list of strings and parts with a text."""
    if isinstance(content, list):
        return "".join(message_text(x) for x in content)
    if isinstance(content, dict):
        return str(content.get("text", ""))
    return str(content or "")


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine

    def search_vector_store(self, query: str, top_k: int = 5) -> str:
        rows = self.engine.vector_search(query, top_k).collect()
        lines = [f"{r['name'] or r['id']} [{r['id']}], score {r['score']:.2f}: {r['description'] or 'no description'}" for r in rows]
        return "\n".join(lines) or "No entity matches."

    def get_entity_context(self, entity_id: str) -> str:
        return self.engine.entity_context(entity_id)["context_summary"]

    def find_connections(self, a: str, b: str) -> str:
        found = self.engine.find_connections(a, b)
        return f"Connected: {found['description']}" if found["connected"] else found["description"]

    def search_documents(self, query: str) -> str:
        rows = self.engine.document_search(query, 3).collect()
        parts = [r["content"] if len(r["content"]) <= EXCERPT else r["content"][:EXCERPT] + "..." for r in rows]
        return "\n\n".join(f"{r['source_file'] or 'unknown'}: {p}" for r, p in zip(rows, parts, strict=True)) or "No document matches."

    def explore_neighborhood(self, entity_id: str, depth: int = 2) -> str:
        context = self.engine.entity_context(entity_id)
        if context["entity"] is None:
            return context["context_summary"]
        wide = self.engine.multi_entity_context([entity_id], depth)
        return "\n".join([context["context_summary"], wide["context_summary"], *wide["relationship_chains"][:10]])

    def multi_hop_search(self, names: str) -> str:
        asked = [n.strip() for n in names.split(",") if n.strip()]
        if len(asked) < 2:
            return "Give at least two names, separated by commas."
        ids = [i for i in map(self.engine.resolve_id, asked) if i]
        if len(ids) < 2:
            return "Fewer than two of these names are known."
        found = self.engine.multi_entity_context(ids)
        bridges = [f"bridge: {b['name'] or b['id']}" for b in found["bridge_nodes"][:5]]
        return "\n".join([found["context_summary"], *bridges, *found["relationship_chains"][:10]])


class Agent:
    """Answers with a trace of the tools and the sources used.

    A model gets the question, the tools with their arguments and what they said so far, and replies with JSON: {"tool": name,
    "arguments": [...]} or {"answer": text}. A reply that is neither, or too many steps, leave the answer to the router, which
    takes one or two tools that the question's form asks for.
    """

    def __init__(self, engine: Engine, model: Callable[[str], str] | None = None):
        self.tools, self.model = Tools(engine), model

    def _call(self, name: str, arguments: list) -> str:
        """What a tool says; an error in a model's call is told to it."""
        try:
            return getattr(self.tools, name)(*arguments)
        except Exception as e:  # noqa: BLE001  told to the model
            return f"Error: {e}"

    def _guided(self, question: str) -> tuple[str, list[tuple[str, list, str]]] | None:
        """The model's answer and its calls; None if it gives none."""
        offered = "\n".join(f"{n}{inspect.signature(getattr(self.tools, n))}" for n in TOOLS)
        calls: list[tuple[str, list, str]] = []
        for _ in range(MOST_STEPS + 1):
            said = "\n".join(f"{n}({json.dumps(a)[1:-1]}) said: {out}" for n, a, out in calls)
            reply = parse_reply(message_text(self.model(
                'Answer from the tools alone. Reply with JSON: {"tool": name, "arguments": [...]} or {"answer": text}.\n'
                f"Tools:\n{offered}\nQuestion: {question}\n{said}"
            ))) or {}
            if isinstance(reply.get("answer"), str):
                return reply["answer"], calls
            if reply.get("tool") not in TOOLS or not isinstance(reply.get("arguments"), list) or len(calls) == MOST_STEPS:
                return None
            calls.append((reply["tool"], reply["arguments"], self._call(reply["tool"], reply["arguments"])))
        return None

    def _steps(self, question: str) -> list[tuple[str, tuple]]:
        if m := re.search(r"(?:connection between|how (?:is|are)) (.+?) (?:and|connected to|related to) (.+?)\??$", question, re.IGNORECASE):
            return [("find_connections", (m[1].strip(), m[2].strip()))]
        if m := re.search(r"what (?:joins|links|connects) (.+?)\??$", question, re.IGNORECASE):
            return [("multi_hop_search", (re.sub(r"\s+and\s+", ", ", m[1]),))]
        if m := re.search(r"(?:who|what) is (.+?)\??$", question, re.IGNORECASE):
            found = self.tools.engine.resolve_id(m[1].strip())
            if found:
                return [("get_entity_context", (found,)), ("search_documents", (question,))]
        return [("search_vector_store", (question,)), ("search_documents", (question,))]

    def ask(self, question: str, detailed_trace: bool = False) -> dict:
        trace, answers, final = [], [], None
        try:
            guided = self._guided(question) if self.model else None
            calls = guided[1] if guided else ((n, list(a), getattr(self.tools, n)(*a)) for n, a in self._steps(question))
            final = guided[0] if guided else None
            for name, arguments, said in calls:
                trace.append({"tool": name, "arguments": arguments, "output": said if detailed_trace else said[:200]})
                answers.append(said)
        except Exception as e:  # noqa: BLE001  told in the response
            return {"answer": f"Error: {e}", "sources": [], "trace": trace, "status": "error"}
        sources = sorted({m for a in answers for m in re.findall(r"^([^\s:]+\.(?:pdf|txt)):", a, re.MULTILINE)})
        return {"answer": "\n\n".join(answers) if final is None else final, "sources": sources, "trace": trace, "status": "success"}
