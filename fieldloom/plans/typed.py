"""Documents of a known type: the whole evaluation as one projection of built-in expressions.

The configuration and the columns' types are resolved on the driver, so a nested pair of columns
becomes nested expressions: a struct's fields are scored side by side, arrays by higher-order
functions.  There is no shuffle and, but for metrics without an expression, no Python.  Rows come
out as in ``plans.tree``, so everything in ``operators.reports`` applies.

A field that is missing from a side's type is absent there; one that is null is present, unless
``null_is_absent``.  The kind of a node is that of the expected type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import functions as S
from fieldloom import metrics as M
from fieldloom import rules, schemas
from fieldloom.config import ArrayFieldConfig, EvalConfig, ObjectFieldConfig
from fieldloom.functions.compare import absent_rule
from fieldloom.functions.numbers import scored
from fieldloom.operators import arrays, assign
from fieldloom.plans._arrow import structs, values
from fieldloom.plans.tree import NODE, Builder

_NODES = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in NODE.split(', ')))}>>"
_MATCHES = "array<struct<path: string, strategy: string, expected_index: int, actual_index: int>>"
_WARNINGS = "array<struct<kind: string, path: string>>"


@dataclass
class Part:
    """A compiled node: its own values, and sums over the leaves below."""

    kind: str
    key: str
    values: dict[str, Column]
    rep: Column
    nodes: Column
    weight: float
    threshold: float
    actual: Column
    expected: Column
    types: tuple[Any, Any]
    in_actual: Column | bool
    in_expected: Column | bool
    leaves: tuple[Column, Column, Column, Column]  # weight, weight * score, expected, expected and there
    matches: Column | None  # none where there can't be any
    warnings: Column | None


def _kind(t: T.DataType | None) -> str | None:
    return None if t is None else M.OBJECT if isinstance(t, T.StructType) else M.ARRAY if isinstance(t, T.ArrayType) else M.SCALAR


def _json_type(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "null"
    return "number" if isinstance(t, T.NumericType) else {T.BooleanType: "boolean", T.StringType: "string", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}.get(type(t), t.simpleString())


def _text(x: Column, t: T.DataType | None) -> Column:
    if t is None:
        return F.lit(None).cast("string")
    return F.to_json(x, {"ignoreNullFields": "false"}) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _total(items: Column, name: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x["leaves"][name])


def _true(x: Column | bool) -> Column:
    return F.lit(x) if isinstance(x, bool) else x


def _comparable(at, et) -> bool:
    return at is not None and et is not None and (_json_type(at) == _json_type(et))


def equal(a: Column, e: Column, at, et) -> Column:
    """Null-safe equality; sides of other types are equal only as nulls."""
    return a.eqNullSafe(e) if _comparable(at, et) else a.isNull() & e.isNull()


def scalar(m: M.Metric, a: Column, e: Column, at, et, source: Column | None) -> Column:
    """The expression of a scalar metric for columns of the given types."""
    kinds = tuple("void" if t is None else t.simpleString() for t in (at, et))
    texts = isinstance(at, T.StringType) and isinstance(et, T.StringType)
    none = absent_rule(a, e, F.lit(0.0))
    if hasattr(m, "column"):
        return m.column(a, e)
    if type(m) is M.ExactMatch:
        return F.when(equal(a, e, at, et), 1.0).otherwise(0.0)
    if type(m) is M.Presence:
        return S.presence(a)
    if type(m) is M.TypeMatch:
        same = _json_type(at) == _json_type(et)
        return F.when(a.isNull() & e.isNull(), 1.0).when(a.isNull() | e.isNull(), 0.0).otherwise(float(same))
    if type(m) is M.RegexMatch:
        return S.regex_match(a, e, m.pattern, m.repl, m.lower, m.strip) if texts else none
    if type(m) is M.Numeric:
        return scored(S.numeric, a, e, kinds, tolerance=m.tolerance, mode=m.mode, relative_tolerance=m.relative_tolerance, absolute_tolerance=m.absolute_tolerance)
    if type(m) is M.NumericCloseness:
        return scored(S.numeric_closeness, a, e, kinds)
    if type(m) is M.ExponentialNumericScore:
        return scored(S.exponential_numeric_score, a, e, kinds, scale=m.scale)
    if type(m) is M.DateDistanceScore:
        return S.date_distance_score(a, e, kinds, m.max_days)
    if type(m) is M.TokenF1:
        return S.token_f1(a, e, m.ignore_case, m.ignore_punctuation, m.ignore_articles) if texts else none
    if type(m) is M.CharacterF1:
        return S.character_f1(a, e, m.ignore_case, m.ignore_whitespace, m.ignore_punctuation) if texts else none
    if type(m) is M.UrlMatch:
        return S.url_match(a, e, m.ignore_query, m.ignore_fragment, m.ignore_www) if texts else none
    if isinstance(m, M.Fuzzy):
        return S.fuzzy(a, e, m.method, m.ignore_case, m.ignore_whitespace) if texts else none
    if type(m) is M.FieldFaithfulness:
        return S.field_faithfulness(a, F.lit(None).cast("string") if source is None else source)

    @F.arrow_udf("double")
    def custom(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [m.score(u, v) for u, v in zip(values(x), values(y))]
        return pa.array([None if s is None else float(s) for s in found], pa.float64())

    return custom(*(F.lit(None).cast("string") if t is None else x for x, t in ((a, at), (e, et))))


def aligned(strategy: str, params: dict, e: Column, a: Column) -> Column:
    """Pairs that no expression gives, from Arrow batches of both arrays."""
    align = assign.ALIGNERS[strategy]
    kind = pa.list_(pa.struct([("e", pa.int32()), ("a", pa.int32())]))

    @F.arrow_udf(arrays.PAIRS)
    def pairs(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [align(u or [], v or [], **params) for u, v in zip(values(x), values(y))]
        return structs([len(p) for p in found], list(zip(*chain.from_iterable(found))) or [(), ()], kind)

    return pairs(e, a)


def paths(x: Column, t: T.DataType | None, at: Column) -> Column:
    """All paths below a value, as an array."""
    none = F.array().cast("array<string>")
    if isinstance(t, T.StructType):
        below = []
        for f in t.fields:
            own = F.concat_ws(".", F.nullif(at, F.lit("")), F.lit(f.name))
            below += [F.array(own), paths(x.getField(f.name), f.dataType, own)]
        return F.when(x.isNotNull(), F.concat(*below)).otherwise(none) if below else none
    if isinstance(t, T.ArrayType):
        each = F.transform(x, lambda v, i: F.concat(F.array(F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))), paths(v, t.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.coalesce(F.flatten(each), none)
    return none


class Compiler:
    def __init__(self, config: EvalConfig, source: Column | None, null_is_absent: bool, bare: bool = False):
        """bare: without the node table, matches and warnings, and with sums over leaves only if a metric of the root asks for them."""
        self.config, self.source, self.null_is_absent, self.bare = config, source, null_is_absent, bare
        self.parts: dict[str, Part] = {}  # nodes outside arrays, by path
        self.detailed = True  # whether nodes show documents and metrics
        self.rules = Builder(config)
        self.inside = 0
        self.stages: list[dict[str, Column]] = []
        asked = [*self.rules.globals, *(getattr(config.top(), "metrics", None) or ()), config.key_metric, getattr(config.top(), "key_metric", None)]
        self.sums = not bare or any((m if isinstance(m, str) else getattr(m, "name", "")) in ("overall_leaf_score", "coverage_leaf_score") for m in asked)

    def any_value(self, m: M.Metric, values: dict[str, Column]) -> Column:
        if type(m) is M.CompositeScore:
            return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _sum([w * F.coalesce(values[k], F.lit(0.0)) for k, w in m.weights.items() if k in values])))
        if type(m) is M.MeanScore:
            own = [v for k, v in values.items() if k != m.name]
            if len(own) < 2:
                return F.coalesce(*own, F.lit(0.0))
            n = _sum([v.isNotNull().cast("double") for v in own])
            return F.coalesce(F.try_divide(_sum([F.coalesce(v, F.lit(0.0)) for v in own]), n), F.lit(0.0))
        raise ValueError(f"{m.name} has no expression; evaluate parsed documents instead")

    def policy(self, m: M.Metric, part: Part) -> Column:
        return scalar(m, part.actual, part.expected, *part.types, self.source)

    def object_value(self, m: M.Metric, children: list[Part], a, e, at, et) -> dict[str, Column]:
        if type(m) is M.ObjectTypeValidity:
            both = [(_true(c.in_actual) & _true(c.in_expected), scalar(M.TypeMatch(), c.actual, c.expected, *c.types, None)) for c in children if c.in_actual is not False and c.in_expected is not False]
            n = _sum([b.cast("double") for b, _ in both])
            return {m.name: F.coalesce(F.try_divide(_sum([F.when(b, v).otherwise(0.0) for b, v in both]), n), F.lit(1.0))}
        if type(m) is M.ObjectExactMatch:
            same = isinstance(at, T.StructType) and isinstance(et, T.StructType) and {f.name: f.dataType for f in at.fields} == {f.name: f.dataType for f in et.fields}
            order = [f.name for f in et.fields] if same else []
            return {m.name: F.when(F.struct(*(a.getField(k).alias(k) for k in order)).eqNullSafe(F.struct(*(e.getField(k).alias(k) for k in order))) & (a.isNull() == e.isNull()), 1.0).otherwise(0.0) if same else F.when(a.isNull() & e.isNull(), 1.0).otherwise(0.0)}
        if not isinstance(m, M._ObjectCounts):
            raise ValueError(f"{m.name} has no expression; evaluate parsed documents instead")
        true, predicted, expected = [], [], []
        for c in children:
            w = c.weight if m.weighted else 1.0
            score = self.policy(m.policy[c.key], c) if c.key in m.policy else c.rep
            bar = m.threshold.get(c.key) if isinstance(m.threshold, dict) else m.threshold
            bar = c.threshold if bar is None else bar
            got = w * score if m.mode == "soft" else F.when(score >= bar, w).otherwise(0.0)
            both, only_e, only_a = _true(c.in_actual) & _true(c.in_expected), ~_true(c.in_actual) & _true(c.in_expected), _true(c.in_actual) & ~_true(c.in_expected)
            true.append(F.when(both, got).otherwise(0.0))
            expected.append(F.when(both | only_e, w).otherwise(0.0))
            predicted.append(F.when(both, w).when(only_a, w if self.config.extra_keys == "penalize" else 0.0).otherwise(0.0))
        t, p, x = _sum(true), _sum(predicted), _sum(expected)
        if type(m) is M.ObjectAccuracy:
            return {m.name: F.coalesce(F.try_divide(t, x), F.lit(1.0))}
        three = dict(zip(("object_precision", "object_recall", "object_f1"), arrays.precision_recall_f1(t, p, x)))
        return three if type(m) is M.ObjectPRF1 else {m.name: list(three.values())[m.part]}

    def array_value(self, m: M.Metric, a, e, at, et, reps: Column, n_a: Column, n_e: Column) -> dict[str, Column]:
        if type(m) is M.ArrayAccuracy:
            return {m.name: F.coalesce(F.try_divide(F.aggregate(reps, F.lit(0.0), lambda s, x: s + x), n_e), F.lit(1.0))}
        if type(m) is M.ArrayCardinality:
            return {m.name: arrays.cardinality(a, e)}
        if type(m) is M.ArrayExactMatch:
            return {m.name: arrays.exact(a, e) if at == et else F.lit(0.0)}
        if type(m) is M.ArrayJaccardSimilarity:
            if isinstance(et, T.ArrayType) and isinstance(et.elementType, (T.StructType, T.ArrayType)):
                a, e = (F.transform(x, lambda v: F.to_json(v)) for x in (a, e))
            return {m.name: arrays.jaccard(a, e)}
        if not isinstance(m, M._ArrayCounts):
            raise ValueError(f"{m.name} has no expression; evaluate parsed documents instead")
        true = F.aggregate(reps, F.lit(0.0), (lambda s, x: s + x) if m.mode == "soft" else (lambda s, x: s + F.when(x >= m.threshold, 1.0).otherwise(0.0)))
        three = dict(zip(("array_precision", "array_recall", "array_f1"), arrays.precision_recall_f1(true, n_a.cast("double"), n_e.cast("double"))))
        return three if type(m) is M.ArrayPRF1 else {m.name: list(three.values())[m.part]}

    def pairs(self, cfg: ArrayFieldConfig, a, e, at, et, then: Callable[[Column], Any]) -> Any:
        item = lambda t: t.elementType if isinstance(t, T.ArrayType) else None
        if item(at) is None or item(et) is None:
            return then(F.array().cast(arrays.PAIRS))
        if cfg.strategy == "by_index":
            return then(arrays.pairs_by_index(e, a))
        if cfg.strategy != "by_key":
            if self.inside:
                raise ValueError(f"{cfg.strategy} pairs of arrays in arrays have no expression; evaluate parsed documents instead")
            return then(aligned(str(cfg.strategy), dict(cfg.params), e, a))
        m = M.resolve(cfg.params.get("key_metric") or "exact_match")
        key = cfg.params.get("key")
        if type(m) is M.ExactMatch and cfg.params.get("threshold", 1.0) == 1.0:
            names = [] if key is None else [key] if isinstance(key, str) else list(key)
            types = [(item(at), item(et))] if key is None else [(item(at)[k].dataType, item(et)[k].dataType) for k in names]
            if all(x == y for x, y in types):
                return then(arrays.pairs_by_equality(*(x if key is None else F.transform(x, lambda v: F.struct(*(v.getField(k).alias(f"k{n}") for n, k in enumerate(names)))) for x in (e, a))))
        if key is None and type(m) is M.RegexMatch and 0 < cfg.params.get("threshold", 1.0) <= 1 and isinstance(item(at), T.StringType) and isinstance(item(et), T.StringType):
            return then(arrays.pairs_by_equality(*(F.transform(x, lambda v: S.plain(v, m.pattern, m.repl, m.lower, m.strip)) for x in (e, a))))
        if key is None:
            score = lambda x, y: scalar(m, x, y, item(at), item(et), None)
        else:
            keys = [key] if isinstance(key, str) else list(key)
            score = lambda x, y: _sum([scalar(m, x.getField(k), y.getField(k), item(at)[k].dataType, item(et)[k].dataType, None) for k in keys]) / float(len(keys))
        return then(arrays.pairs_by_score(e, a, score, cfg.params.get("threshold", 1.0)))

    def bind(self, x: Column, then: Callable[[Column], Any]) -> Any:
        """``then`` of ``x`` computed once: a column of an earlier projection or, inside an array, a lambda's variable."""
        if self.inside:
            return F.get(F.transform(F.array(x), then), F.lit(0))
        name = f"__{len(self.stages)}"
        self.stages.append({name: x})
        return then(F.col(name))

    def bind_all(self, values: dict[str, Column], then: Callable[[dict[str, Column]], Any]) -> Any:
        """The same of several doubles. Outside arrays they are columns of their own: a struct's would be inlined at every use."""
        if self.inside:
            return self.bind(F.struct(*(v.cast("double").alias(k) for k, v in values.items())), lambda s: then({k: s[k] for k in values}))
        names = {k: f"__{len(self.stages)}_{i}" for i, k in enumerate(values)}
        self.stages.append({names[k]: v.cast("double") for k, v in values.items()})
        return then({k: F.col(f"`{n}`") for k, n in names.items()})

    def part(self, a: Column, e: Column, at, et, cfg: Any, path: Column, over: Column, key: str, depth: int, then: Callable[[Part], Any], in_a: Column | bool = True, in_e: Column | bool = True, root: bool = False, where: str = "$") -> Any:
        """What ``then`` makes of the compiled node."""
        kind = _kind(et) or _kind(at) or M.SCALAR
        own = self.rules.metrics(cfg, kind, root)
        key_metric = self.rules.key_of(cfg, kind, root, own)
        bar = getattr(cfg, "threshold", None)
        weight, threshold = float(getattr(cfg, "weight", 1.0)), 1.0 if bar is None else float(bar)

        def finish(make: Callable[[M.Metric, dict[str, Column]], dict[str, Column]], leaves, below: list[Column], matches: list[Column], warned: list[Column]) -> Any:
            """The node from its metrics; those of any node come after those of this kind, the key metric last."""
            order = [*(m for m in own if m.name != key_metric.name), key_metric]
            first, values = 0, {}
            while first < len(order) and order[first].level != "any":
                values |= make(order[first], values)
                first += 1

            def with_values(values: dict[str, Column], first: int) -> Any:
                if first < len(order):
                    m = order[first]
                    more = {m.name: self.any_value(m, values)} if m.level == "any" else make(m, values)
                    return self.bind_all(more, lambda got: with_values(values | got, first + 1))
                if key_metric.name not in values:
                    raise ValueError(f"{key_metric.name} gives no value of its own and can't be a key metric")
                return complete(values)

            def complete(values: dict[str, Column]) -> Any:
                rep, known, own_leaves = values[key_metric.name], e.isNotNull(), leaves
                if kind == M.SCALAR:
                    own_leaves = (F.lit(weight), weight * rep, known.cast("double"), (known & a.isNotNull()).cast("double"))
                if self.bare:
                    bare = Part(kind, key, values, rep, F.lit(None), weight, threshold, a, e, (at, et), in_a, in_e, own_leaves, F.lit(None), F.lit(None))
                    if not self.inside:
                        self.parts[where] = bare
                    return then(bare)
                shown = F.create_map().cast("map<string,double>") if not self.detailed else F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
                node = F.struct(
                    path.alias("path"), over.alias("expected_path"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), (_text(a, at) if self.detailed else F.lit(None).cast("string")).alias("actual"), (_text(e, et) if self.detailed else F.lit(None).cast("string")).alias("expected"), _true(in_a).alias("in_actual"), _true(in_e).alias("in_expected"),
                    shown.alias("metrics"), F.create_map().cast("map<string,string>").alias("extras"), rep.alias("score"), F.lit(threshold).alias("threshold"), F.lit(weight).alias("weight"),
                )
                nodes = F.concat(F.array(node), *below) if below else F.array(node)
                return then(Part(kind, key, values, rep, nodes, weight, threshold, a, e, (at, et), in_a, in_e, own_leaves, F.concat(*matches) if matches else None, F.concat(*warned) if warned else None))

            if not values:
                return with_values({}, first)
            return self.bind_all(values, lambda got: with_values(got, first))

        if kind == M.SCALAR:
            return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, None) if m.level == "root" else scalar(m, a, e, at, et, self.source)}, None, [], [], [])
        if kind == M.OBJECT:
            return self._object(a, e, at, et, cfg, path, over, depth, root, finish, where)
        return self._array(a, e, at, et, cfg, path, over, key, depth, root, finish)

    def _object(self, a, e, at, et, cfg, path, over, depth, root, finish, where) -> Any:
        sides = [(x, t) if isinstance(t, T.StructType) else (None, None) for x, t in ((a, at), (e, et))]
        names = sorted({f.name for _, t in sides if t is not None for f in t.fields})

        def after(children: list[Part]) -> Any:
            if len(children) < len(names):
                k = names[len(children)]
                got = [(x.getField(k), t[k].dataType) if t is not None and k in t.fieldNames() else (F.lit(None), None) for x, t in sides]
                there = [False if vt is None else (v.isNotNull() if self.null_is_absent else x.isNotNull()) for (x, _), (v, vt) in zip(sides, got)]
                down, across = (F.lit(k) if root else F.concat(p, F.lit("." + k)) for p in (path, over))
                own = cfg.child(k) if isinstance(cfg, ObjectFieldConfig) else None
                return self.part(got[0][0], got[1][0], got[0][1], got[1][1], own, down, across, k, depth + 1, lambda c: after([*children, c]), *there, where=k if root else f"{where}.{k}")
            if self.bare:
                there = [_true(c.in_actual) | _true(c.in_expected) for c in children] if self.sums else []
                sums = tuple(_sum([F.when(x, c.leaves[i]).otherwise(0.0) for c, x in zip(children, there)]) for i in range(4))
                return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, sums)} if m.level == "root" else self.object_value(m, children, a, e, at, et), sums, [], [], [])
            below, matches, warned, leaves = [], [], [], []
            for c in children:
                ia, ie = _true(c.in_actual), _true(c.in_expected)
                exists = ia | ie
                below.append(F.when(exists, c.nodes).otherwise(F.array().cast(_NODES)))
                leaves.append(tuple(F.when(exists, v).otherwise(0.0) for v in c.leaves))
                matches += [] if c.matches is None else [c.matches]
                warned += [] if c.warnings is None else [c.warnings]
                kinds = F.when(~ia & ie, "missing_field")
                kinds = kinds if self.config.extra_keys == "penalize" else kinds.when(ia & ~ie, "extra_key")
                at_path = F.lit(c.key) if root else F.concat(path, F.lit("." + c.key))
                warned.append(F.when(kinds.isNotNull(), F.array(F.struct(kinds.alias("kind"), at_path.alias("path")))).otherwise(F.array().cast(_WARNINGS)))
            sums = tuple(_sum([v[i] for v in leaves]) for i in range(4))
            return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, sums)} if m.level == "root" else self.object_value(m, children, a, e, at, et), sums, below, matches, warned)

        return after([])

    def _array(self, a, e, at, et, cfg, path, over, key, depth, root, finish) -> Any:
        own = cfg if isinstance(cfg, ArrayFieldConfig) else ArrayFieldConfig()
        n_a, n_e = (arrays._count(x) if isinstance(t, T.ArrayType) else F.lit(0) for x, t in ((a, at), (e, et)))
        match = lambda i, j: F.struct(path.alias("path"), F.lit(str(own.strategy)).alias("strategy"), i.cast("int").alias("expected_index"), j.cast("int").alias("actual_index"))
        null = F.lit(None).cast("int")
        places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def with_pairs(pairs: Column) -> Any:
            rest_e, rest_a = F.array_except(places(n_e), F.transform(pairs, lambda p: p["e"])), F.array_except(places(n_a), F.transform(pairs, lambda p: p["a"]))
            matched = F.lit(None) if self.bare else F.concat(F.transform(pairs, lambda p: match(p["e"], p["a"])), F.transform(rest_e, lambda i: match(i, null)), F.transform(rest_a, lambda j: match(null, j)))
            if not (isinstance(at, T.ArrayType) and isinstance(et, T.ArrayType)):
                zeros, none = (F.lit(0.0),) * 4, F.array().cast("array<double>")
                return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, zeros)} if m.level == "root" else self.array_value(m, a, e, at, et, none, n_a, n_e), zeros, [], [matched], [])
            stem_a, stem_e = (F.lit("$") if root else p for p in (path, over))

            def item(p: Column) -> Column:
                down, across = (F.concat(s, F.lit("["), i.cast("string"), F.lit("]")) for s, i in ((stem_a, p["a"]), (stem_e, p["e"])))
                if self.bare:
                    pack = lambda c: F.struct(c.rep.alias("rep"), *([F.struct(*(v.cast("double").alias(f"l{i}") for i, v in enumerate(c.leaves))).alias("leaves")] if self.sums else []))
                    return self.part(F.get(a, p["a"]), F.get(e, p["e"]), at.elementType, et.elementType, own.item, down, across, key, depth + 1, pack)

                def pack(c: Part) -> Column:
                    lists = {"matches": c.matches, "warnings": c.warnings}
                    held.extend(k for k, v in lists.items() if v is not None)
                    return F.struct(c.rep.alias("rep"), c.nodes.alias("nodes"), F.struct(*(v.cast("double").alias(f"l{i}") for i, v in enumerate(c.leaves))).alias("leaves"), *(v.alias(k) for k, v in lists.items() if v is not None))

                return self.part(F.get(a, p["a"]), F.get(e, p["e"]), at.elementType, et.elementType, own.item, down, across, key, depth + 1, pack)

            held: list[str] = []  # what items have besides their scores: what they can't have is not gathered, so the array's own pairs need no item
            self.inside += 1
            scored_items = F.transform(pairs, item)
            self.inside -= 1

            def with_items(items: Column) -> Any:
                leaves = tuple(_total(items, f"l{i}") for i in range(4)) if self.sums else (F.lit(0.0),) * 4
                reps = F.transform(items, lambda x: x["rep"])
                if self.bare:
                    return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, leaves)} if m.level == "root" else self.array_value(m, a, e, at, et, reps, n_a, n_e), leaves, [], [], [])
                below = [F.flatten(F.transform(items, lambda x: x["nodes"]))]
                gathered = lambda k: [F.flatten(F.transform(items, lambda x: x[k]))] if k in held else []
                return finish(lambda m, _: {m.name: self.root_value(m, a, e, at, et, leaves)} if m.level == "root" else self.array_value(m, a, e, at, et, reps, n_a, n_e), leaves, below, [matched, *gathered("matches")], gathered("warnings"))

            return self.bind(scored_items, with_items)

        return self.pairs(own, a, e, at, et, lambda p: self.bind(p, with_pairs))

    def root_value(self, m: M.Metric, a, e, at, et, leaves) -> Column:
        if type(m) is M.RulePassRate:
            return rules.pass_rate(m.rules, a)
        if type(m) is M.SchemaValidity and isinstance(m.schema, dict):
            return schemas.column(F.to_variant_object(a), m.schema).cast("double")
        if type(m) is M.StructuralSimilarity:
            p, q = (F.array_distinct(paths(x, t, F.lit(""))) for x, t in ((a, at), (e, et)))
            return arrays.jaccard(p, q)
        if type(m) is M.OverallLeafScore and leaves:
            return F.coalesce(F.try_divide(leaves[1], leaves[0]), F.lit(1.0))
        if type(m) is M.CoverageLeafScore and leaves:
            return F.coalesce(F.try_divide(leaves[3], leaves[2]), F.lit(1.0))
        raise ValueError(f"{m.name} has no expression; evaluate parsed documents instead")


def compiled(df: DataFrame, config: EvalConfig | None = None, actual: str = "actual", expected: str | None = "expected", source: str | None = None, null_is_absent: bool = False, at: str | None = None, detailed: bool = True) -> tuple[DataFrame, Part]:
    """``df`` with the columns of the steps, and the root of the compiled tree over it; with ``at`` the node of that path, without a node table."""
    config = config or EvalConfig()
    compiler = Compiler(config, F.col(source) if source else None, null_is_absent, at is not None)
    compiler.detailed = detailed
    if at is not None and at != "$":
        compiler.sums = False
    where = at
    at, et = df.schema[actual].dataType, df.schema[expected].dataType if expected else None
    root = compiler.part(F.col(actual), F.col(expected) if expected else F.lit(None), at, et, config.top(), F.lit("$"), F.lit("$"), "", 0, lambda p: p, root=True)
    for columns in compiler.stages:
        df = df.withColumns(columns)
    if where is None:
        return df, root
    if where not in compiler.parts:
        raise ValueError(f"there is no {where} outside arrays")
    return df, compiler.parts[where]


def evaluate(df: DataFrame, config: EvalConfig | None = None, actual: str = "actual", expected: str | None = "expected", source: str | None = None, sample_id: str | None = None, null_is_absent: bool = False, detailed: bool = True) -> DataFrame:
    """Report rows as of ``plans.tree.evaluate``, for nested columns. Without ``detailed`` nodes have scores, but neither texts of documents nor metrics."""
    staged, root = compiled(df, config, actual, expected, source, null_is_absent, detailed=detailed)
    name = (F.col(sample_id) if sample_id else F.lit(None)).cast("string")
    builder, top = Builder(config or EvalConfig()), (config or EvalConfig()).top()
    label = builder.key_of(top, root.kind, True, builder.metrics(top, root.kind, True)).name
    return staged.select(
        name.alias("sample_id"), F.lit(False).alias("parse_error"), F.lit(None).cast("string").alias("parse_error_message"), root.rep.alias("score"), F.lit(label).alias("score_label"),
        root.nodes.alias("nodes"), *(F.array().cast(t).alias(k) if x is None else x.alias(k) for k, x, t in (("matches", root.matches, _MATCHES), ("warnings", root.warnings, _WARNINGS))),
    )


def scores(df: DataFrame, config: EvalConfig | None = None, keep: list[str] | None = None, at: str = "$", **columns: Any) -> DataFrame:
    """The metrics of the root, or of the node at another path outside arrays, as columns, without the node table; only what they need is computed."""
    staged, root = compiled(df, config, at=at, **columns)
    return staged.select(*(keep or []), *(v.alias(k) for k, v in root.values.items()), root.rep.alias("score"))
