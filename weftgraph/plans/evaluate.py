"""Judging answers against cases: keywords, grounding, status."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Case:
    question: str
    expected_keywords: tuple[str, ...] = ()
    must_be_grounded: bool = True
    max_confidence_if_ungrounded: float = 0.25


def judge(case: Case, response: dict) -> dict:
    answer = str(response.get("answer") or "")
    confidence, used = float(response.get("confidence") or 0), int(response.get("doc_chunks_used") or 0)
    keywords = all(k.lower() in answer.lower() for k in case.expected_keywords)
    grounded = used > 0 if case.must_be_grounded else confidence <= case.max_confidence_if_ungrounded
    return {
        "question": case.question, "status": response.get("status"), "method": response.get("method"), "confidence": confidence,
        "doc_chunks_used": used, "keyword_match": keywords, "grounded_ok": grounded, "answer_preview": answer[:240],
        "passed": keywords and grounded and response.get("status") == "success",
    }


def run(ask: Callable[[str], dict], cases: Sequence[Case]) -> dict:
    results = [judge(c, ask(c.question)) for c in cases]
    passed = sum(r["passed"] for r in results)
    return {
        "total_cases": len(results), "passed_cases": passed, "pass_rate": round(passed / max(1, len(results)), 3), "results": results,
    }
