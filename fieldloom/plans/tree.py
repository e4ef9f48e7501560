"""Documents of any shape: each row's two documents become a tree of scored nodes in one task.

A row needs nothing of other rows, so there is no shuffle (but for a table smaller than one partition
a core, whose rows are dealt out): rows go through in Arrow batches and
come out as one row per document that holds its nodes, array matches and warnings.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from types import MappingProxyType
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import metrics as M
from fieldloom.config import ArrayFieldConfig, EvalConfig, ExtraKeysPolicy, ObjectFieldConfig
from fieldloom.operators.assign import ALIGNERS, by_index
from fieldloom.plans._arrow import maps, structs, values
from fieldloom.sources.documents import ParseError, parse

NODE = (
    "path string, expected_path string, kind string, depth int, actual string, expected string, in_actual boolean, in_expected boolean, "
    "metrics map<string,double>, extras map<string,string>, score double, threshold double, weight double"
)
SCHEMA = (
    f"sample_id string, parse_error boolean, parse_error_message string, score double, score_label string, nodes array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in NODE.split(', ')))}>>, "
    "matches array<struct<path: string, strategy: string, expected_index: int, actual_index: int>>, warnings array<struct<kind: string, path: string>>"
)


SCORES = "sample_id string, parse_error boolean, parse_error_message string, score double, score_label string, metrics map<string,double>"
_BY_PLACE = ArrayFieldConfig()
_NOTHING: Mapping[str, str] = MappingProxyType({})
_json = json.JSONEncoder(ensure_ascii=False, default=str).encode


def _no_child(key: str) -> None:
    return None


def text_of(x: Any) -> str | None:
    """JSON of a value; null for none."""
    return None if x is None else _json(x)


class Node:
    __slots__ = ("path", "expected_path", "key", "kind", "actual", "expected", "in_actual", "in_expected", "weight", "threshold", "metrics", "key_metric", "order", "children", "missed", "spurious", "penalizes", "values", "extras", "source", "label")

    def __init__(self, path: str, expected_path: str, key: str, kind: str, actual: Any, expected: Any, source: str | None, in_actual: bool = True, in_expected: bool = True):
        self.path, self.expected_path, self.key, self.kind, self.actual, self.expected, self.source = path, expected_path, key, kind, actual, expected, source
        self.in_actual, self.in_expected = in_actual, in_expected
        self.children: Sequence[Node] = () if kind == M.SCALAR else []
        self.missed: Sequence[int] = ()
        self.spurious: Sequence[int] = ()
        self.penalizes, self.values, self.extras, self.label = False, {}, _NOTHING, None

    def walk(self) -> list[Node]:
        """This node and those below, in the order of the tree."""
        if not self.children:
            return [self]
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n)
            if n.children:
                stack += n.children[::-1]
        return out

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if n.kind == M.SCALAR]

    def representative(self) -> float:
        try:
            return self.values[self.key_metric.name]
        except KeyError:
            raise ValueError(f"{self.key_metric.name} gave no value at {self.path}") from None

    def scored(self, metric: M.Metric) -> float:
        """The value of another metric here."""
        got = metric.compute(self)
        return float(got[0] if isinstance(got, tuple) else got)


class Builder:
    """A configuration resolved once, then used for every document of a task."""

    def __init__(self, config: EvalConfig):
        self.config = config
        self.top = config.top()  # once: one for each document would be resolved, and kept, for each
        self.known: dict[tuple, tuple] = {}
        self.below: dict[int, tuple] = {}
        self.penalizes = config.extra_keys == ExtraKeysPolicy.PENALIZE
        self.globals = [M.resolve(m) for m in config.metrics]
        usual = {M.SCALAR: M.ExactMatch, M.OBJECT: M.ObjectAccuracy, M.ARRAY: M.ArrayAccuracy}
        given = {M.SCALAR: config.default_scalar_metrics, M.OBJECT: config.default_object_metrics, M.ARRAY: config.default_array_metrics}
        self.defaults = {k: [M.resolve(m) for m in given[k]] if given[k] else [usual[k]()] for k in usual}
        self.key_metric = config.key_metric
        for group in (self.globals, *self.defaults.values()):
            self._distinct(group)

    @staticmethod
    def _distinct(group: list[M.Metric]) -> None:
        names = [m.name for m in group]
        if len(set(names)) < len(names):
            raise ValueError(f"{max(names, key=names.count)} is assigned twice")

    def metrics(self, cfg: Any, kind: str, root: bool) -> list[M.Metric]:
        own = [M.resolve(m) for m in getattr(cfg, "metrics", None) or ()]
        self._distinct(own)
        for m in own:
            if not m.fits(kind, root):
                raise ValueError(f"{m.name} cannot score {kind} nodes")
        out = own + [m for m in self.globals if m.fits(kind, root) and m.name not in {o.name for o in own}]
        if not out:
            for m in self.defaults[kind]:
                if not m.fits(kind, root):
                    raise ValueError(f"{m.name} cannot score {kind} nodes")
            out = list(self.defaults[kind])
        return out

    def key_of(self, cfg: Any, kind: str, root: bool, own: list[M.Metric]) -> M.Metric:
        def made(which):
            if isinstance(which, str):
                return next((m for m in own if m.name == which), None) or M.resolve(which)
            return which

        if (which := getattr(cfg, "key_metric", None)) is not None:
            m = made(which)
            if not m.fits(kind, root):
                raise ValueError(f"{m.name} cannot score {kind} nodes")
            return m
        if (which := self.key_metric) is not None:
            # a name may stand for a metric that needs arguments; its class tells whether it fits
            cls = M.get_metric_class(which) if isinstance(which, str) else type(which)
            if (cls.__new__(cls) if isinstance(which, str) else which).fits(kind, root):
                return made(which)
        return M.MeanScore()

    def resolved(self, cfg: Any, kind: str, root: bool) -> tuple:
        """(metrics, key metric, both in the order of computing, what computes them, threshold, weight), once for each place in the configuration."""
        at = id(cfg), kind, root
        if at not in self.known:
            own = self.metrics(cfg, kind, root)
            key = self.key_of(cfg, kind, root, own)
            bar = getattr(cfg, "threshold", None)
            order = [*(m for m in own if m is not key and m.name != key.name), key]
            steps = [(m.name, m.score, True) if type(m).compute is M.FieldMetric.compute else (m.name, m.compute, False) for m in order]
            self.known[at] = own, key, order, steps, 1.0 if bar is None else bar, getattr(cfg, "weight", 1.0), cfg  # which keeps the id from being used again
        return self.known[at]

    def children(self, cfg: Any) -> Callable[[str], Any]:
        """``cfg.child``, made once for the keys that the configuration names; other keys of documents leave nothing behind."""
        if type(cfg) is not ObjectFieldConfig:
            return cfg.child if isinstance(cfg, ObjectFieldConfig) else _no_child
        if id(cfg) not in self.below:
            heads = {k[:i] for k in cfg.fields for i, c in enumerate(k) if c == "."}
            self.below[id(cfg)] = {k: cfg.child(k) for k in (*cfg.fields, *heads)}.get, cfg
        return self.below[id(cfg)][0]

    def node(self, a: Any, e: Any, cfg: Any, path: str, expected_path: str, key: str, state: dict, in_actual: bool = True, in_expected: bool = True) -> Node:
        """The node of two values with all below it, scored."""
        ref = a if e is None else e
        kind = M.OBJECT if isinstance(ref, dict) else M.ARRAY if isinstance(ref, list) else M.SCALAR
        root = path == "$"
        n = Node(path, expected_path, key, kind, a, e, state["source"], in_actual, in_expected)
        n.metrics, n.key_metric, n.order, steps, n.threshold, n.weight, _ = self.known.get((id(cfg), kind, root)) or self.resolved(cfg, kind, root)
        n.penalizes = self.penalizes
        if kind == M.SCALAR:
            pass
        elif kind == M.OBJECT:
            left, right = a if isinstance(a, dict) else {}, e if isinstance(e, dict) else {}
            stem, across = "" if root else f"{path}.", "" if expected_path == "$" else f"{expected_path}."
            own, node = self.children(cfg), self.node
            for k in sorted(left if left.keys() == right.keys() else left.keys() | right.keys()):
                at, there, wanted = f"{stem}{k}", k in left, k in right
                n.children.append(node(left.get(k), right.get(k), own(k), at, f"{across}{k}", k, state, there, wanted))
                if not there:
                    state["warnings"].append(("missing_field", at))
                elif not wanted and not n.penalizes:
                    state["warnings"].append(("extra_key", at))
        else:
            left, right = a if isinstance(a, list) else [], e if isinstance(e, list) else []
            cfg = cfg if isinstance(cfg, ArrayFieldConfig) else _BY_PLACE
            strategy = str(cfg.strategy)
            pairs = ALIGNERS[strategy](right, left, **cfg.params)
            if len(pairs) < len(right):
                n.missed = sorted(set(range(len(right))) - {i for i, _ in pairs})
            if len(pairs) < len(left):
                n.spurious = sorted(set(range(len(left))) - {j for _, j in pairs})
            for i, j in pairs:
                n.children.append(self.node(left[j], right[i], cfg.item, f"{path}[{j}]", f"{expected_path}[{i}]", key, state))
            state["matches"] += [(path, strategy, i, j) for i, j in pairs] + [(path, strategy, i, None) for i in n.missed] + [(path, strategy, None, j) for j in n.spurious]
        found = n.values
        for name, compute, direct in steps:
            got = compute(a, e) if direct else compute(n)
            if type(got) is float:
                found[name] = got
                continue
            extra = None
            if isinstance(got, tuple):
                got, extra = got
            if isinstance(got, dict):
                found |= {k: float(v) for k, v in got.items()}
            elif got is not None:
                found[name] = float(got)
            if extra:
                n.extras = {**n.extras, name: _json(extra)}
        return n

    def evaluate(self, actual: Any, expected: Any, source: str | None) -> tuple[Node, dict]:
        state: dict[str, Any] = {"source": source, "warnings": [], "matches": []}
        root = self.node(actual, expected, self.top, "$", "$", "", state)
        return root, state


def _judged(builder: Builder, actual: Any, expected: Any, source: str | None) -> tuple[Node | None, dict, str | None]:
    """(root, state, None), or what can't be read of two documents. Texts are parsed; other values are documents as they are."""
    try:
        if isinstance(actual, str):
            actual = parse(actual)
        if isinstance(expected, str):
            expected = parse(expected)
    except ParseError as why:
        return None, {"warnings": [], "matches": []}, str(why)
    return *builder.evaluate(actual, expected, source), None


def _below(root: Node) -> list[tuple[Node, int]]:
    """All nodes with their depths, in the order of the tree."""
    out, stack = [], [(root, 0)]
    while stack:
        n, depth = at = stack.pop()
        out.append(at)
        if n.children:
            stack += [(c, depth + 1) for c in reversed(n.children)]
    return out


_FIELDS: dict[str, Callable[[Node, int], Any]] = {
    "path": lambda n, d: n.path, "expected_path": lambda n, d: n.expected_path, "kind": lambda n, d: n.kind, "depth": lambda n, d: d, "actual": lambda n, d: text_of(n.actual), "expected": lambda n, d: text_of(n.expected),
    "in_actual": lambda n, d: n.in_actual, "in_expected": lambda n, d: n.in_expected, "metrics": lambda n, d: n.values, "extras": lambda n, d: n.extras, "score": lambda n, d: n.representative(), "threshold": lambda n, d: float(n.threshold), "weight": lambda n, d: float(n.weight),
}


def report(builder: Builder, sample_id: str | None, actual: Any, expected: Any, source: str | None) -> dict:
    """One row of ``SCHEMA``."""
    root, state, why = _judged(builder, actual, expected, source)
    nodes = [{k: f(n, depth) for k, f in _FIELDS.items()} for n, depth in _below(root)] if root else []
    for n in nodes:
        n["metrics"], n["extras"] = list(n["metrics"].items()), list(n["extras"].items())
    return {
        "sample_id": sample_id, "parse_error": root is None, "parse_error_message": why, "score": root.representative() if root else None, "score_label": root.key_metric.name if root else None, "nodes": nodes,
        "matches": [dict(zip(("path", "strategy", "expected_index", "actual_index"), m)) for m in state["matches"]],
        "warnings": [{"kind": k, "path": p} for k, p in state["warnings"]],
    }


def _reports(builder: Builder, rows: list[tuple], schema: pa.Schema, fields: frozenset[str], at: str | None) -> pa.RecordBatch:
    """Rows of (sample_id, actual, expected, source) as rows of ``SCHEMA`` whose nodes have only these fields or, with ``at``, of ``SCORES``."""
    ids, failed, why, scores, labels, metrics = [], [], [], [], [], []
    sizes: tuple[list[int], ...] = ([], [], [])
    nodes: list[tuple[Node, int]] = []
    matches: list[tuple] = []
    warnings: list[tuple] = []
    for sample_id, actual, expected, source in rows:
        root, state, error = _judged(builder, actual, expected, source)
        ids.append(sample_id)
        failed.append(root is None)
        why.append(error)
        if root is None:
            scores.append(None)
            labels.append(None)
            metrics.append(None)
        else:
            scores.append(root.representative())
            labels.append(root.key_metric.name)
        if at is None:
            own = _below(root) if root is not None and fields else []
            nodes += own
            matches += state["matches"]
            warnings += state["warnings"]
            for size, n in zip(sizes, (own, state["matches"], state["warnings"])):
                size.append(len(n))
        elif root is not None:
            there = root if at == "$" else next((n for n in root.walk() if n.path == at), None)
            metrics.append(None if there is None else there.values)
    columns = [pa.array(x, f.type) for x, f in zip((ids, failed, why, scores, labels), schema)]
    last = schema.field(5).type
    if at is not None:
        filled = maps([x or {} for x in metrics], last)
        absent = pa.array([x is None for x in metrics], pa.bool_())
        columns.append(pc.if_else(absent, pa.scalar(None, last), filled) if None in metrics else filled)
        return pa.RecordBatch.from_arrays(columns, schema=schema)
    made: list[Any] = []
    for f in last.value_type:
        of = _FIELDS[f.name]
        found = [of(n, d) for n, d in nodes] if f.name in fields else None
        made.append(maps(found or [{}] * len(nodes), f.type) if f.name in ("metrics", "extras") else found)
    columns.append(structs(sizes[0], made, last))
    for k, found in enumerate((matches, warnings), 1):
        t = schema.field(5 + k).type
        columns.append(structs(sizes[k], list(zip(*found)) if found else [()] * t.value_type.num_fields, t))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it is so small that files would give fewer; a larger one as it is."""
    spark = df.sparkSession
    cores, most = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) >= cores * most:
        return df
    while plan.nodeName() in ("Project", "Filter", "Aggregate", "Window"):
        plan = plan.children().head()
    if plan.nodeName() == "RepartitionByExpression" and plan.optNumPartitions().isDefined() and plan.numPartitions() >= cores:
        return df  # dealt out before
    return df.repartition(cores)


def evaluate(df: DataFrame, config: EvalConfig | None = None, actual: str = "actual", expected: str | None = "expected", source: str | None = None, sample_id: str | None = None, node_fields: Collection[str] | None = None) -> DataFrame:
    """One report row for each row of ``df``: see ``SCHEMA``. Columns may be texts (JSON, else YAML) or nested. With ``node_fields`` only these fields of the nodes are written: the others are null, maps empty."""
    fields = frozenset(_FIELDS if node_fields is None else node_fields)
    if unknown := fields - _FIELDS.keys():
        raise ValueError(f"nodes have no {', '.join(sorted(unknown))}")
    return _evaluated(df, config, actual, expected, source, sample_id, SCHEMA, fields, None)


def scores(df: DataFrame, config: EvalConfig | None = None, actual: str = "actual", expected: str | None = "expected", source: str | None = None, sample_id: str | None = None, at: str = "$") -> DataFrame:
    """The same without the nodes, matches and warnings, but with the metrics of the root, or of the (first) node at another path, null where there is none: see ``SCORES``."""
    return _evaluated(df, config, actual, expected, source, sample_id, SCORES, frozenset(), at)


def _packed(named: dict[str, Any]) -> dict[str, bytes]:
    from pyspark import cloudpickle

    return {k: cloudpickle.dumps(v) for k, v in named.items()}


def _unpacked(packed: dict[str, bytes]) -> dict[str, Any]:
    """Without what is in modules that only the driver has: a configuration that uses such a name fails by that name, others don't."""
    out = {}
    for k, v in packed.items():
        try:
            out[k] = pickle.loads(v)
        except (ImportError, AttributeError):
            pass
    return out


def _evaluated(df: DataFrame, config: EvalConfig | None, actual: str, expected: str | None, source: str | None, sample_id: str | None, ddl: str, fields: frozenset[str], at: str | None) -> DataFrame:
    config = config or EvalConfig()
    Builder(config)  # what is wrong with it regardless of documents fails here
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    # what was declared on the driver goes along, so that its names mean the same there
    own = _packed({k: v for k, v in M.REGISTRY.items() if v.__module__ != M.__name__})
    aligners = _packed({k: v for k, v in ALIGNERS.items() if v.__module__ != by_index.__module__})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        M.REGISTRY.update(_unpacked(own))
        ALIGNERS.update(_unpacked(aligners))
        builder = Builder(config)
        for batch in batches:
            for first in range(0, len(batch), 1000):
                yield _reports(builder, list(zip(*map(values, batch.slice(first, 1000).columns))), schema, fields, at)

    null = F.lit(None).cast("string")
    name = F.col(sample_id).cast("string") if sample_id else null
    narrow = df.select(name.alias("sample_id"), F.col(actual).alias("a"), (F.col(expected) if expected else null).alias("e"), (F.col(source) if source else null).alias("s"))
    return _dealt(narrow).mapInArrow(run, ddl)
