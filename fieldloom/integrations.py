"""Scores in the shapes that evaluation hosts call for; the hosts themselves aren't needed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from fieldloom.api import evaluate
from fieldloom.config import EvalConfig


def verdict(report: dict, threshold: float = 1.0) -> tuple[float, bool, str]:
    """(score, success, reason): the reason names at most five failed fields."""
    if report["parse_error"]:
        return 0.0, False, f"parse error: {report['parse_error_message']}"
    bad = [f"{n['path']}={n['score']:.2f}" for n in report["nodes"] if n["score"] < n["threshold"]][:5]
    return report["score"], report["score"] >= threshold, f"failed: {', '.join(bad)}" if bad else "all fields pass"


class StructuredMetric:
    """A metric object that measures a test case with ``actual_output``, ``expected_output`` and ``retrieval_context``."""

    def __init__(self, config: EvalConfig | None = None, threshold: float = 1.0, name: str = "structured"):
        self.config, self.threshold, self.name = config, threshold, name
        self.score: float | None = None
        self.success = False
        self.reason = ""

    def measure(self, case: Any) -> float:
        context = getattr(case, "retrieval_context", None)
        found = evaluate(case.actual_output, getattr(case, "expected_output", None), self.config, source="\n".join(context) if context else None)
        self.score, self.success, self.reason = verdict(found, self.threshold)
        return self.score

    async def a_measure(self, case: Any) -> float:
        return self.measure(case)

    def is_successful(self) -> bool:
        return self.success


class StructuredEvaluator:
    """A callable on (run, example) whose outputs hold the documents, or from which the given functions take them."""

    def __init__(self, config: EvalConfig | None = None, output: str = "output", key: str = "structured", extract_actual: Callable[[Any], Any] | None = None, extract_expected: Callable[[Any], Any] | None = None):
        self.config, self.output, self.key = config, output, key
        self.extract_actual, self.extract_expected = extract_actual, extract_expected

    def __call__(self, run: Any, example: Any = None) -> dict:
        def document(x: Any) -> Any:
            held = getattr(x, "outputs", None) if x is not None else None
            return held.get(self.output, held) if isinstance(held, dict) else held

        actual, expected = (document(x) if own is None else own(x) for x, own in ((run, self.extract_actual), (example, self.extract_expected)))
        score, _, reason = verdict(evaluate(actual, expected, self.config))
        return {"key": self.key, "score": score, "comment": reason}
