"""Rules over one document: a path, a comparison, and a value, path or sum of paths.

A rule is parsed on the driver.  ``check`` judges a parsed document; ``column`` compiles the rule to an
expression over a struct's fields, false where a path is absent or types don't compare.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(?:'([^']*)'|\"([^\"]*)\"|(-?\d+)|(\*))\]")
_PLAIN = re.compile(r"\$(\.[A-Za-z_]\w*)+\Z")
_INSIDE = re.compile(r"\$((?:\.[A-Za-z_]\w*)+)")
OPERATORS = {"eq": "=", "lt": "<", "gt": ">", "lte": "<=", "gte": ">=", "in": "in"}


_TESTS: dict[str, Callable[[Any, Any], Any]] = {"eq": operator.eq, "lt": operator.lt, "gt": operator.gt, "lte": operator.le, "gte": operator.ge, "in": lambda left, right: left in right}


def steps(path: str) -> list[str | int]:
    """The keys and places of a path; '*' for any place."""
    if not path.startswith("$"):
        raise ValueError(f"{path!r} doesn't begin with $")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"can't read {path!r} from {path[at:]!r} on")
        name = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]
        out.append(name if name is not None else int(m[4]) if m[4] else "*")
        at = m.end()
    return out


@lru_cache(maxsize=4096)
def _steps(path: str) -> tuple[str | int, ...]:
    return tuple(steps(path))


def find(document: Any, path: Sequence[str | int]) -> list[Any]:
    """All matches."""
    found = [document]
    for step in path:
        new = []
        for x in found:
            if step == "*" and isinstance(x, (list, dict)):
                new += x if isinstance(x, list) else x.values()
            elif isinstance(step, int) and isinstance(x, list) and -len(x) <= step < len(x):
                new.append(x[step])
            elif isinstance(step, str) and isinstance(x, dict) and step in x:
                new.append(x[step])
        found = new
    return found


MISSING = object()


def navigate(document: Any, path: str) -> Any:
    """The value at a path such as ``a.b[0]``, ``$.a`` or ``[-1].b``, ``MISSING`` if there is none; ``$`` and nothing stand for the document."""
    path = path.strip()
    full = path if path.startswith("$") else f"${path}" if path.startswith("[") else f"$.{path}" if path else "$"
    if "*" in full:
        raise ValueError(f"{path!r} may stand for several values")
    found = find(document, _steps(full))
    return found[0] if found else MISSING


class _Absent(Exception):
    pass


def _first(document: Any, path: str) -> Any:
    found = find(document, _steps(path))
    if not found:
        raise _Absent(f"{path} not found in the document")
    return found[0]


@lru_cache(maxsize=4096)
def _tree(text: str) -> ast.expr:
    """The arithmetic of a right side; paths become names."""
    return ast.parse(_INSIDE.sub(lambda m: "P_" + m[1][1:].replace(".", "__DOT__"), text), mode="eval").body


def _arithmetic(node: ast.expr, leaf: Callable[[str], Any], apply: Callable[[str, Any, Any], Any], constant=lambda x: x) -> Any:
    again = lambda x: _arithmetic(x, leaf, apply, constant)
    if isinstance(node, ast.BinOp) and type(node.op).__name__ in ("Add", "Sub", "Mult", "Div"):
        return apply(type(node.op).__name__, again(node.left), again(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return apply("Sub", constant(0), again(node.operand))
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return constant(node.value)
    if isinstance(node, ast.Name) and node.id.startswith("P_"):
        return leaf("$." + node.id[2:].replace("__DOT__", "."))
    raise ValueError("only + - * / of numbers and paths can be computed")


def _apply(op: str, a: Any, b: Any) -> Any:
    return a + b if op == "Add" else a - b if op == "Sub" else a * b if op == "Mult" else a / b


class Rule:
    """``Rule("$.total").eq("$.net + $.tax")``; each comparison gives a new rule."""

    def __init__(self, path: str, *, name: str = "", op: str | None = None, right: Any = None):
        self.path, self.given, self.op, self.right = path, name, op, right
        steps(path)

    def _bound(self, op: str, right: Any) -> Rule:
        return Rule(self.path, name=self.given, op=op, right=right)

    def eq(self, right):
        return self._bound("eq", right)

    def lt(self, right):
        return self._bound("lt", right)

    def gt(self, right):
        return self._bound("gt", right)

    def lte(self, right):
        return self._bound("lte", right)

    def gte(self, right):
        return self._bound("gte", right)

    def in_(self, right):
        return self._bound("in", right)

    @staticmethod
    def custom(fn: Callable[[dict], bool], *, name: str = "") -> CustomRule:
        return CustomRule(fn, name)

    @property
    def name(self) -> str:
        if self.given or self.op is None:
            return self.given or self.path
        return f"{self.path} {self.op} {self.right if isinstance(self.right, str) else repr(self.right)}"

    def _needs_comparison(self) -> None:
        if self.op is None:
            raise ValueError(f"the rule on {self.path!r} compares with nothing")

    def evaluate(self, document: dict) -> dict:
        self._needs_comparison()
        try:
            left = _first(document, self.path)
            right = self.right
            if isinstance(right, str) and "$" in right:
                text = right.strip()
                right = _first(document, text) if _PLAIN.match(text) else _arithmetic(_tree(text), lambda p: _first(document, p), _apply)
            passed = _TESTS[self.op](left, right)
        except Exception as why:
            return {"name": self.name, "passed": False, "message": str(why)}
        return {"name": self.name, "passed": bool(passed), "message": "" if passed else f"{self.path!r} ({left!r}) does not satisfy {self.op}({right!r})"}

    def column(self, document: Column) -> Column:
        """Whether the struct obeys the rule. Fields must be of comparable types."""
        self._needs_comparison()

        def at(path: str) -> Column:
            x = document
            for step in steps(path):
                x = F.get(x, F.lit(step)) if isinstance(step, int) else F.get(x, F.lit(0)) if step == "*" else x.getField(step)
            return x

        left, right = at(self.path), self.right
        if self.op == "in":
            return F.coalesce(left.isin(list(right)), F.lit(False))
        if isinstance(right, str) and "$" in right:
            text = right.strip()
            functions = {"Add": F.try_add, "Sub": F.try_subtract, "Mult": F.try_multiply, "Div": F.try_divide}
            right = at(text) if _PLAIN.match(text) else _arithmetic(_tree(text), at, lambda op, a, b: functions[op](a, b), F.lit)
        else:
            right = F.lit(right)
        test = {"eq": left == right, "lt": left < right, "gt": left > right, "lte": left <= right, "gte": left >= right}[self.op]
        return F.coalesce(test, F.lit(False))


class CustomRule:
    def __init__(self, fn: Callable[[dict], bool], name: str = ""):
        self.fn, self.name = fn, name or getattr(fn, "__name__", "custom")

    def evaluate(self, document: dict) -> dict:
        try:
            passed, message = bool(self.fn(document)), ""
        except Exception as why:
            passed, message = False, str(why)
        return {"name": self.name, "passed": passed, "message": message or ("" if passed else f"{self.name} failed")}


def results(rules: list[Rule], document: Column) -> Column:
    """An array of (name, passed) of rules over a struct."""
    return F.array(*(F.struct(F.lit(r.name).alias("name"), r.column(document).alias("passed")) for r in rules))


def pass_rate(rules: list[Rule], document: Column) -> Column:
    """The share of rules that a struct obeys; 1 without rules."""
    if not rules:
        return F.lit(1.0)
    return sum((r.column(document).cast("double") for r in rules), F.lit(0.0)) / float(len(rules))
