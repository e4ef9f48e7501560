"""Metrics by name.  A metric says which nodes it fits and scores one in Python; those that
have an expression are also compiled into Spark plans (``fieldloom.plans.typed``).

Subclasses with a ``name`` register themselves; of one name the last holds.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections import Counter
from datetime import date, datetime, timedelta
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from fieldloom.functions.fuzzy import METHODS, similarity

REGISTRY: dict[str, type[Metric]] = {}
SCALAR, OBJECT, ARRAY = "scalar", "object", "array"


class Metric:
    """``kinds``: the node kinds it fits. ``level``: 'node', 'root' or 'any'."""

    name = ""
    kinds: tuple[str, ...] = ()
    level = "node"

    def __init__(self, name: str | None = None):
        if name is not None:
            if not name:
                raise ValueError("a metric's name can't be empty")
            self.name = name

    def __init_subclass__(cls, **more):
        super().__init_subclass__(**more)
        if cls.__dict__.get("name"):
            REGISTRY[cls.name] = cls

    def fits(self, kind: str, root: bool) -> bool:
        return self.level == "any" or (root if self.level == "root" else kind in self.kinds)

    def compute(self, node) -> Any:
        """A number, a dict of numbers, (number, extra) or None for no value."""
        raise NotImplementedError


class FieldMetric(Metric):
    kinds = (SCALAR,)

    def score(self, actual: Any, expected: Any) -> float:
        raise NotImplementedError

    def table(self, expected: list, actual: list) -> list[list[float]]:
        """The score of each expected value with each actual one; no score is nan."""
        return [[math.nan if (s := self.score(a, e)) is None else s for a in actual] for e in expected]

    def compute(self, node):
        return self.score(node.actual, node.expected)


class ObjectMetric(Metric):
    kinds = (OBJECT,)


class ArrayMetric(Metric):
    kinds = (ARRAY,)


class RootMetric(Metric):
    level = "root"


class AnyNodeMetric(Metric):
    level = "any"


class GenericMetric(Metric):
    """Fits each kind for which it has ``score_<kind>(actual, expected)`` or ``compute_<kind>(node)``."""

    def fits(self, kind, root):
        return hasattr(self, f"compute_{kind}") or hasattr(self, f"score_{kind}")

    def compute(self, node):
        if own := getattr(self, f"compute_{node.kind}", None):
            return own(node)
        return getattr(self, f"score_{node.kind}")(node.actual, node.expected)


def get_metric_class(name: str) -> type[Metric]:
    if name not in REGISTRY:
        raise KeyError(f"no metric is named {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def resolve(metric: str | Metric) -> Metric:
    return get_metric_class(metric)() if isinstance(metric, str) else metric


def invoke(metric: str | Metric, actual: Any, expected: Any = None, source: str | None = None) -> dict[str, float]:
    """The values of one metric for two documents, as at the root of their tree."""
    from fieldloom.config import EvalConfig
    from fieldloom.plans.tree import Builder

    own = resolve(metric)
    builder = Builder(EvalConfig(default_scalar_metrics=[own]) if own.fits(SCALAR, False) and not isinstance(actual if expected is None else expected, (dict, list)) else EvalConfig(metrics=[own]))
    root, _ = builder.evaluate(actual, expected, source)
    return {k: v for k, v in root.values.items() if k != MeanScore.name or own.name == k}


# ---- scalars


def _graded(a: Any, e: Any, rest) -> float:
    if a is None or e is None:
        return float(a is None and e is None)
    return float(rest(a, e))


class ExactMatch(FieldMetric):
    name = "exact_match"

    def score(self, actual, expected):
        return float(actual == expected)


class Presence(FieldMetric):
    name = "presence"

    def score(self, actual, expected=None):
        return float(actual is not None)


def json_type(x: Any) -> str:
    if x is None:
        return "null"
    for name, types in (("boolean", bool), ("number", (int, float)), ("string", str), ("array", list), ("object", dict)):
        if isinstance(x, types):
            return name
    return type(x).__name__


class TypeMatch(FieldMetric):
    name = "type_match"

    def score(self, actual, expected):
        return float(json_type(actual) == json_type(expected))


class RegexMatch(FieldMetric):
    name = "regex_match"

    def __init__(self, pattern=r"\s+", repl=" ", lower=True, strip=True, name=None):
        super().__init__(name)
        self.pattern, self.repl, self.lower, self.strip = pattern, repl, lower, strip
        self.replaced = re.compile(pattern).sub

    def plain(self, x: str) -> str:
        x = x.lower() if self.lower else x
        x = self.replaced(self.repl, x.strip() if self.strip else x)
        return x.strip() if self.strip else x

    def score(self, actual, expected):
        if actual is None or expected is None:
            return float(actual is None and expected is None)
        return float(isinstance(actual, str) and isinstance(expected, str) and self.plain(actual) == self.plain(expected))

    def table(self, expected, actual):
        if type(self).score is not RegexMatch.score:
            return super().table(expected, actual)
        # None equals None and anything else nothing
        a, e = ([(i,) if x is not None and not isinstance(x, str) else x if x is None else self.plain(x) for x in side] for i, side in enumerate((actual, expected)))
        return [[float(y == x) for y in a] for x in e]


def parse_number(x: Any) -> float | None:
    if type(x) is float:
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    if not isinstance(x, str):
        return float(x)
    x = x.strip()
    if x.startswith("(") and x.endswith(")"):
        x = "-" + x[1:-1]
    try:
        return float(re.sub(r"[^0-9eE.+\-]", "", x))
    except ValueError:
        return None


class _NumberMetric(FieldMetric):
    def numbers(self, a: float, e: float) -> float:
        raise NotImplementedError

    def score(self, actual, expected):
        if actual is None or expected is None:
            return float(actual is None and expected is None)
        a, e = parse_number(actual), parse_number(expected)
        return 0.0 if a is None or e is None or a != a or e != e else float(self.numbers(a, e))  # nan equals nothing

    def table(self, expected, actual):
        if type(self).score is not _NumberMetric.score or None in expected or None in actual:
            return super().table(expected, actual)
        numbers, a = self.numbers, [parse_number(x) for x in actual]
        if type(self).numbers is NumericCloseness.numbers:  # the most usual, without a call for each pair
            return [[0.0 if x is None or y is None or x != x or y != y else 1.0 if x == y else max(0.0, 1 - abs(y - x) / max(abs(y), abs(x))) for y in a] for x in map(parse_number, expected)]
        return [[0.0 if x is None or y is None or x != x or y != y else float(numbers(y, x)) for y in a] for x in map(parse_number, expected)]


class Numeric(_NumberMetric):
    name = "numeric"

    def __init__(self, tolerance=0.01, mode="relative", relative_tolerance=None, absolute_tolerance=None, name=None):
        super().__init__(name)
        if mode not in ("relative", "absolute"):
            raise ValueError(f"unknown mode {mode!r}")
        self.tolerance, self.mode, self.relative_tolerance, self.absolute_tolerance = tolerance, str(mode), relative_tolerance, absolute_tolerance

    def numbers(self, a, e):
        gap = abs(a - e)
        if self.relative_tolerance is None and self.absolute_tolerance is None:
            near = (gap / abs(e) if e else math.inf) if self.mode == "relative" else gap
            return float(a == e or self.tolerance is not None and near <= self.tolerance)
        share = gap / abs(e) if e else math.inf
        bands = [(share, self.relative_tolerance), (gap, self.absolute_tolerance)]
        return float(a == e or any(most is not None and d <= most for d, most in bands))


class NumericCloseness(_NumberMetric):
    name = "numeric_closeness"

    def numbers(self, a, e):
        return 1.0 if a == e else max(0.0, 1 - abs(a - e) / max(abs(a), abs(e)))


class ExponentialNumericScore(_NumberMetric):
    name = "exponential_numeric_score"

    def __init__(self, scale=1.0, name=None):
        super().__init__(name)
        if scale <= 0:
            raise ValueError("scale must be above 0")
        self.scale = scale

    def numbers(self, a, e):
        return 1.0 if a == e else math.exp(-abs(a - e) / self.scale)


def to_day(x: Any) -> date | None:
    if isinstance(x, datetime):
        return x.date()
    if isinstance(x, date):
        return x
    if isinstance(x, str):
        if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[T ]00:00(?::00(?:\.0+)?)?Z?)?", x):
            try:
                return date.fromisoformat(m[1])
            except ValueError:
                return None
        x = float(x) if re.fullmatch(r"-?\d+(\.0+)?", x) else None
    if x is None or isinstance(x, bool) or not isinstance(x, (int, float)) or x != x:
        return None
    x = x / 1000 if abs(x) > 2e10 else x
    if x % 86400:
        return None
    try:
        return date(1970, 1, 1) + timedelta(days=x // 86400)
    except OverflowError:
        return None


class DateDistanceScore(FieldMetric):
    name = "date_distance_score"

    def __init__(self, max_days=30, name=None):
        super().__init__(name)
        if max_days <= 0:
            raise ValueError("max_days must be above 0")
        self.max_days = max_days

    def score(self, actual, expected):
        def rest(a, e):
            a, e = to_day(a), to_day(e)
            return max(0.0, 1 - abs((a - e).days) / self.max_days) if a and e else 0.0

        return _graded(actual, expected, rest)


class _Overlap(FieldMetric):
    def items(self, text: str) -> list[str]:
        raise NotImplementedError

    def score(self, actual, expected):
        def rest(a, e):
            if not (isinstance(a, str) and isinstance(e, str)):
                return 0.0
            a, e = self.items(a), self.items(e)
            if not a and not e:
                return 1.0
            return 2 * sum((Counter(a) & Counter(e)).values()) / (len(a) + len(e))

        return _graded(actual, expected, rest)


_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


class TokenF1(_Overlap):
    name = "token_f1"

    def __init__(self, ignore_case=True, ignore_punctuation=True, ignore_articles=True, name=None):
        super().__init__(name)
        self.ignore_case, self.ignore_punctuation, self.ignore_articles = ignore_case, ignore_punctuation, ignore_articles

    def items(self, text):
        text = text.lower() if self.ignore_case else text
        text = text.translate(_NO_PUNCTUATION) if self.ignore_punctuation else text
        return (re.sub(r"\b(a|an|the)\b", " ", text, flags=re.I) if self.ignore_articles else text).split()


class CharacterF1(_Overlap):
    name = "character_f1"

    def __init__(self, ignore_case=True, ignore_whitespace=True, ignore_punctuation=True, name=None):
        super().__init__(name)
        self.ignore_case, self.ignore_whitespace, self.ignore_punctuation = ignore_case, ignore_whitespace, ignore_punctuation

    def items(self, text):
        text = text.lower() if self.ignore_case else text
        text = "".join(text.split()) if self.ignore_whitespace else text
        return list(text.translate(_NO_PUNCTUATION) if self.ignore_punctuation else text)


class Fuzzy(FieldMetric):
    name = "fuzzy"
    usual = "token_sort_ratio"

    def __init__(self, method=None, ignore_case=True, ignore_whitespace=True, name=None):
        super().__init__(name)
        self.method = str(method or self.usual)
        if self.method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        self.ignore_case, self.ignore_whitespace = ignore_case, ignore_whitespace

    def score(self, actual, expected):
        return similarity(actual, expected, self.method, self.ignore_case, self.ignore_whitespace)


class Levenshtein(Fuzzy):
    name = "levenshtein"
    usual = "ratio"


class UrlMatch(FieldMetric):
    name = "url_match"

    def __init__(self, *, ignore_query=False, ignore_fragment=True, ignore_www=True, name=None):
        super().__init__(name)
        self.ignore_query, self.ignore_fragment, self.ignore_www = ignore_query, ignore_fragment, ignore_www

    def normal(self, x: Any) -> tuple | None:
        try:
            parts = urlsplit(x.strip()) if isinstance(x, str) else None
            if parts is None or not parts.scheme or not parts.hostname:
                return None
            host = parts.hostname.lower()
            port = parts.port
        except ValueError:
            return None
        query = () if self.ignore_query else tuple(sorted(parse_qsl(parts.query, keep_blank_values=True)))
        path = unquote(parts.path)
        return parts.scheme.lower(), host.removeprefix("www.") if self.ignore_www else host, port, path.removesuffix("/"), query, "" if self.ignore_fragment else unquote(parts.fragment)

    def score(self, actual, expected):
        def rest(a, e):
            a, e = self.normal(a), self.normal(e)
            return a is not None and a == e

        return _graded(actual, expected, rest)


class FieldFaithfulness(FieldMetric):
    name = "field_faithfulness"

    def compute(self, node):
        if node.actual is None:
            return None
        if node.source is None:
            raise ValueError("field_faithfulness needs a source text")
        return float(str(node.actual).lower() in node.source.lower())


# ---- objects and arrays


def precision_recall_f1(true: float, predicted: float, expected: float) -> tuple[float, float, float]:
    p = true / predicted if predicted else float(not expected)
    r = true / expected if expected else float(not predicted)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


class _ObjectCounts(ObjectMetric):
    graded = "hard"

    def __init__(self, score_policy=None, threshold=None, mode=None, weight_mode="proportional", name=None):
        super().__init__(name)
        self.policy = {k: resolve(m) for k, m in (score_policy or {}).items()}
        self.threshold, self.mode, self.weighted = threshold, str(mode or self.graded), weight_mode == "proportional"
        if self.mode not in ("hard", "soft") or weight_mode not in ("none", "proportional"):
            raise ValueError("unknown mode")

    def counts(self, node) -> tuple[float, float, float]:
        """Weights that count as true, as predicted and as expected."""
        true = predicted = expected = 0.0
        for child in node.children:
            w = child.weight if self.weighted else 1.0
            if child.in_actual and child.in_expected:
                score = child.scored(self.policy[child.key]) if child.key in self.policy else child.representative()
                bar = self.threshold.get(child.key) if isinstance(self.threshold, dict) else self.threshold
                bar = child.threshold if bar is None else bar
                true += w * (score if self.mode == "soft" else score >= bar)
                predicted, expected = predicted + w, expected + w
            elif child.in_expected:
                expected += w
            elif node.penalizes:
                predicted += w
        return true, predicted, expected


class ObjectAccuracy(_ObjectCounts):
    name = "object_accuracy"
    graded = "soft"

    def __init__(self, score_policy=None, weight_mode="proportional", name=None):
        super().__init__(score_policy, weight_mode=weight_mode, name=name)

    def compute(self, node):
        true, _, expected = self.counts(node)
        return true / expected if expected else 1.0


class ObjectPrecision(_ObjectCounts):
    name = "object_precision"
    part = 0

    def compute(self, node):
        return precision_recall_f1(*self.counts(node))[self.part]


class ObjectRecall(ObjectPrecision):
    name = "object_recall"
    part = 1


class ObjectF1(ObjectPrecision):
    name = "object_f1"
    part = 2


class ObjectPRF1(_ObjectCounts):
    name = "object_prf1"

    def compute(self, node):
        return dict(zip(("object_precision", "object_recall", "object_f1"), precision_recall_f1(*self.counts(node))))


class ObjectTypeValidity(ObjectMetric):
    name = "object_type_validity"

    def compute(self, node):
        both = [json_type(c.actual) == json_type(c.expected) for c in node.children if c.in_actual and c.in_expected]
        return sum(both) / len(both) if both else 1.0


def strict(x: Any) -> Any:
    """Equal for values of the same types and contents throughout; keys in any order."""
    if isinstance(x, dict):
        return "object", tuple(sorted((k, strict(v)) for k, v in x.items()))
    if isinstance(x, list):
        return "array", tuple(strict(v) for v in x)
    return type(x).__name__, repr(x)


class ObjectExactMatch(ObjectMetric):
    name = "object_exact_match"

    def compute(self, node):
        return float(strict(node.actual) == strict(node.expected))


class _ArrayCounts(ArrayMetric):
    def __init__(self, threshold=1.0, mode="hard", name=None):
        super().__init__(name)
        if mode not in ("hard", "soft"):
            raise ValueError("unknown mode")
        self.threshold, self.mode = threshold, str(mode)

    def counts(self, node):
        scores = [c.representative() for c in node.children]
        true = sum(scores) if self.mode == "soft" else sum([s >= self.threshold for s in scores])
        return true, len(scores) + len(node.spurious), len(scores) + len(node.missed)


class ArrayAccuracy(ArrayMetric):
    name = "array_accuracy"

    def compute(self, node):
        n = len(node.children) + len(node.missed)
        return sum(c.representative() for c in node.children) / n if n else 1.0


class ArrayPrecision(_ArrayCounts):
    name = "array_precision"
    part = 0

    def compute(self, node):
        return precision_recall_f1(*self.counts(node))[self.part]


class ArrayRecall(ArrayPrecision):
    name = "array_recall"
    part = 1


class ArrayF1(ArrayPrecision):
    name = "array_f1"
    part = 2


class ArrayPRF1(_ArrayCounts):
    name = "array_prf1"

    def compute(self, node):
        return dict(zip(("array_precision", "array_recall", "array_f1"), precision_recall_f1(*self.counts(node))))


class ArrayCardinality(ArrayMetric):
    name = "array_cardinality"

    def compute(self, node):
        a, e = (len(x) if isinstance(x, list) else 0 for x in (node.actual, node.expected))
        return min(a, e) / max(a, e) if a or e else 1.0


class ArrayExactMatch(ArrayMetric):
    name = "array_exact_match"

    def compute(self, node):
        return float(isinstance(node.actual, list) and isinstance(node.expected, list) and strict(node.actual) == strict(node.expected))


class ArrayJaccardSimilarity(ArrayMetric):
    name = "array_jaccard_similarity"

    def compute(self, node):
        def members(x):
            values = [] if x is None else x if isinstance(x, list) else [x]
            return {("json", json.dumps(v, sort_keys=True, default=str)) if isinstance(v, (dict, list)) else v for v in values}

        a, e = members(node.actual), members(node.expected)
        return len(a & e) / len(a | e) if a or e else 1.0


# ---- the whole tree, and any node


class OverallLeafScore(RootMetric):
    name = "overall_leaf_score"

    def compute(self, node):
        leaves = node.leaves()
        total = sum([x.weight for x in leaves])
        return sum([x.weight * x.representative() for x in leaves]) / total if total else 1.0


class CoverageLeafScore(RootMetric):
    name = "coverage_leaf_score"

    def compute(self, node):
        wanted = [x.actual is not None for x in node.leaves() if x.expected is not None]
        return sum(wanted) / len(wanted) if wanted else 1.0


def paths_of(x: Any, at: str = "") -> set[str]:
    """All paths of containers and leaves below the root."""
    items = [(f"{at}.{k}" if at else k, v) for k, v in x.items()] if isinstance(x, dict) else [(f"{at}[{i}]", v) for i, v in enumerate(x)] if isinstance(x, list) else []
    return set().union(*({p} | paths_of(v, p) for p, v in items))


class StructuralSimilarity(RootMetric):
    name = "structural_similarity"

    def compute(self, node):
        a, e = paths_of(node.actual), paths_of(node.expected)
        return len(a & e) / len(a | e) if a or e else 1.0


class SchemaValidity(RootMetric):
    name = "schema_validity"

    def __init__(self, schema, name=None):
        super().__init__(name)
        self.schema = schema

    def compute(self, node):
        from fieldloom.schemas import validate

        found = validate(node.actual, self.schema)
        return float(found["valid"]), {"schema_errors": {k: found[k] for k in ("type_errors", "missing_required", "extra_fields")}}


class RulePassRate(RootMetric):
    name = "rule_pass_rate"

    def __init__(self, rules, name=None):
        super().__init__(name)
        self.rules = list(rules)

    def compute(self, node):
        document = node.actual if isinstance(node.actual, dict) else {}
        results = [r.evaluate(document) for r in self.rules]
        return (sum(r["passed"] for r in results) / len(results) if results else 1.0), {"rule_results": results}


class MeanScore(AnyNodeMetric):
    name = "mean_score"

    def compute(self, node):
        found = node.values
        values = found.values() if self.name not in found else [v for k, v in found.items() if k != self.name]
        return sum(values) / len(values) if values else 0.0


class CompositeScore(AnyNodeMetric):
    name = "composite_score"

    def __init__(self, weights, name=None):
        super().__init__(name)
        if not weights or sum(weights.values()) <= 0:
            raise ValueError("the weights' sum must be above 0")
        total = sum(weights.values())
        self.weights = {k: w / total for k, w in weights.items()}

    def compute(self, node):
        return min(1.0, max(0.0, sum(w * node.values.get(k, 0.0) for k, w in self.weights.items())))
