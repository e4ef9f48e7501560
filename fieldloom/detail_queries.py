"""More queries: operators that ``queries`` reaches only through others, or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom import functions as S
from fieldloom import metrics as M
from fieldloom import rules
from fieldloom.api import Evaluator, evaluate
from fieldloom.config import ArrayFieldConfig, EvalConfig, FieldConfig, ObjectFieldConfig
from fieldloom.functions.numbers import parse_number
from fieldloom.operators import diff
from fieldloom.operators import reports as R
from fieldloom.plans import tree, typed
from fieldloom.queries import _CHILDREN, _DROPPED, _ITEMS, _PAIRS, _PRF_CONFIG, _PRF_SQL, _both, _changed, _keyed, _nested, _order_reports, _round, _table, order_pairs, query, tree_items
from fieldloom.sources.documents import json_of, samples_from_text

_SCORE = "round((a + 2 * b + c) / 4, 6)"


def _id():
    return F.col("sample_id").cast("bigint").alias("o_orderkey")


def _texts(spark, sf, absent: bool = False):
    """JSON texts of the pairs; with ``absent`` those of documents with missing and extra keys."""
    df = _keyed(spark, sf) if absent else order_pairs(spark, sf)
    text = (lambda c: F.to_json(c)) if absent else json_of
    return df.select("o_orderkey", *(text(F.col(c)).alias(c) for c in ("actual", "expected")))


# ---- calls and documents


@query(f"SELECT o_orderkey, {_SCORE} AS score, CAST((a < 1) AS INT) + CAST((b < 1) AS INT) + CAST((c < 1) AS INT) + CAST((a + b + c < 3) AS INT) AS failed FROM ({_CHILDREN})")
def orders_single_reports(spark, sf):
    """One call of ``evaluate`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evaluate(a, e, _PRF_CONFIG) for a, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(r.score, 6) for r in found]), pa.array([len(r.failed_fields()) for r in found], pa.int32())], names=["o_orderkey", "score", "failed"])

    return tree._dealt(_texts(spark, sf)).mapInArrow(run, "o_orderkey bigint, score double, failed int")


@query(f"SELECT count(*) AS samples, round(avg((a + 2 * b + c) / 4), 6) AS score FROM ({_CHILDREN})")
def orders_evaluator_batch(spark, sf):
    return Evaluator(_PRF_CONFIG).batch(order_pairs(spark, sf)).select("samples", F.round("score", 6).alias("score"))


@query(f"""
SELECT path, change, count(*) AS n FROM (
  SELECT 'status' AS path, 'changed' AS change FROM ({_PAIRS}) WHERE s <> es UNION ALL
  SELECT 'price', 'changed' FROM ({_PAIRS}) WHERE o_orderkey % 13 <> 0 AND p <> ep UNION ALL
  SELECT 'price', 'removed' FROM ({_PAIRS}) WHERE o_orderkey % 13 = 0 UNION ALL
  SELECT 'note', 'added' FROM ({_PAIRS}) WHERE o_orderkey % 13 = 0) GROUP BY path, change""")
def orders_document_diff(spark, sf):
    entries = tree._dealt(_texts(spark, sf, True)).select(F.explode(diff.structured_diff(F.col("actual"), F.col("expected"))).alias("d"))
    return entries.groupBy("d.path", "d.change").agg(F.count(F.lit(1)).alias("n"))


def _document():
    inner = F.struct(F.col("o_orderstatus").alias("b"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("c"))
    return F.struct(F.col("o_orderkey").alias("key"), inner.alias("a"), F.create_map().cast("map<string,string>").alias("e"), F.array().cast("array<int>").alias("l"))


@query("SELECT unnest(['key', 'a.b', 'a.c[0]', 'a.c[1]', 'e', 'l']) AS path, count(*) AS n FROM orders GROUP BY 1")
def orders_flattened(spark, sf):
    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        return pd.Series([list(diff.flatten(json.loads(t))) for t in texts])

    return _table(spark, sf, "orders").select(F.explode(leaves(json_of(_document()))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey + 1 AS last, o_orderstatus AS status, TRUE AS missing FROM orders")
def orders_navigated(spark, sf):
    @F.pandas_udf("last bigint, status string, missing boolean")
    def at(texts: pd.Series) -> pd.DataFrame:
        found = [json.loads(t) for t in texts]
        return pd.DataFrame({"last": [rules.navigate(x, "a.c[-1]") for x in found], "status": [rules.navigate(x, "$.a.b") for x in found], "missing": [rules.navigate(x, "a.x[0]") is rules.MISSING for x in found]})

    return _table(spark, sf, "orders").select("o_orderkey", at(json_of(_document())).alias("f")).select("o_orderkey", "f.*")


@query("""SELECT v.place, v.path, v.kind, v.depth, count(*) AS n FROM orders, (VALUES (0, '$', 'object', 0), (1, 'price', 'scalar', 1), (2, 'priority', 'scalar', 1), (3, 'status', 'scalar', 1)) AS v(place, path, kind, depth) GROUP BY ALL""")
def orders_tree_walk(spark, sf):
    return R.nodes(tree.evaluate(_texts(spark, sf), _PRF_CONFIG, sample_id="o_orderkey", node_fields=["path", "kind", "depth"])).groupBy("place", "path", "kind", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, n, total, n AS last FROM (SELECT user_id, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id)")
def events_json_lines(spark, sf):
    """Texts of JSON lines with blank lines between."""
    texts = _table(spark, sf, "events").groupBy("user_id").agg(F.concat_ws("\n \n", F.collect_list("props")).alias("text"))
    found = samples_from_text(texts, "text").groupBy("user_id").agg(F.count("document").alias("n"), F.sum(F.try_variant_get("document", "$.k", "bigint")).alias("total"), F.max("line_number").alias("lines"))
    return found.select("user_id", "n", "total", ((F.col("lines") + 1) / 2).cast("bigint").alias("last"))


# ---- alignment


def _named(spark, sf, name):
    """Items with a named key that differs in case only, and a rank that differs by a little."""
    expected_name, expected_rank = lambda p: F.concat(F.lit("Part "), p.cast("string")), lambda p, place: place * 1000.0
    actual_name, actual_rank = lambda p: F.upper(F.concat(F.lit("part "), p.cast("string"))), lambda p, place: place * 1000.0 + p % 4
    made = {"struct": lambda n, r: F.struct(n.alias("name"), r.alias("rank")), "rank": lambda n, r: r, "name": lambda n, r: n}[name]
    return _both(spark, sf, lambda p, _, place: made(expected_name(p), expected_rank(p, place)), lambda p, _, place: made(actual_name(p), actual_rank(p, place)))


_KEPT = f"SELECT l_orderkey, count(*) AS e, count(*) FILTER (WHERE {_DROPPED}) AS a, count(*) FILTER (WHERE {_DROPPED} AND l_partkey % 4 = 0) AS same FROM ({_ITEMS}) GROUP BY l_orderkey"


def _items_config(metrics, **more):
    return EvalConfig(fields={"items": ArrayFieldConfig(metrics=metrics, **more)})


@query(f"SELECT l_orderkey, round(same / e, 6) AS array_recall, round(CASE WHEN a > 0 THEN same / a ELSE 0 END, 6) AS array_precision FROM ({_KEPT})")
def lineitem_soft_key(spark, sf):
    """Items pair by a graded key, the mean of two scores; what is scored then is the whole item."""
    config = EvalConfig(fields={"items": ArrayFieldConfig(strategy="by_key", params={"key": "rank", "key_metric": "numeric_closeness", "threshold": 0.95}, metrics=["array_precision", "array_recall"], item=ObjectFieldConfig(fields={"name": FieldConfig(metrics=["regex_match"])}))})
    return typed.scores(_named(spark, sf, "struct"), config, keep=["l_orderkey"], at="items").select("l_orderkey", *_round("array_precision", "array_recall"))


@query(f"SELECT l_orderkey, round(a / e, 6) AS array_recall, CAST(a > 0 AS DOUBLE) AS array_precision FROM ({_KEPT})")
def lineitem_folded_key(spark, sf):
    """A key whose metric ignores case."""
    config = EvalConfig(fields={"items": ArrayFieldConfig(strategy="by_key", params={"key_metric": "regex_match"}, metrics=["array_precision", "array_recall"], item=FieldConfig(metrics=["regex_match"]))})
    return typed.scores(_named(spark, sf, "name"), config, keep=["l_orderkey"], at="items").select("l_orderkey", *_round("array_precision", "array_recall"))


@query(f"SELECT l_orderkey, round(2.0 * same / (a + e), 6) AS array_f1 FROM ({_KEPT})")
def lineitem_hungarian_places(spark, sf):
    """Optimal pairs by the usual score of numbers: each rank is near its own and far from the others."""
    return tree_items(_named(spark, sf, "rank"), _items_config(["array_f1"], strategy="hungarian", params={"threshold": 0.9}), "array_f1")


@query(f"SELECT l_orderkey, round(2.0 * same / (a + e), 6) AS array_f1 FROM ({_KEPT})")
def lineitem_hungarian_fields(spark, sf):
    """Optimal pairs by a scorer for each field: one named, one a metric, and a key of two parts."""
    config = _items_config(["array_f1"], strategy="hungarian", params={"threshold": 0.9, "key": ["name", "rank"], "scorer": {"name": "regex_match", "rank": M.NumericCloseness()}}, item=ObjectFieldConfig(fields={"name": FieldConfig(metrics=["regex_match"])}))
    return tree_items(_named(spark, sf, "struct"), config, "array_f1")


@query(f"SELECT l_orderkey, round(2.0 * a / (a + e), 6) AS array_f1 FROM ({_KEPT})")
def lineitem_hungarian_callable(spark, sf):
    """Optimal pairs by a function of the two items."""

    def close(actual, expected):
        return 1.0 if abs(actual - expected) < 10 else 0.0

    return tree_items(_named(spark, sf, "rank"), _items_config(["array_f1"], strategy="hungarian", params={"scorer": close}, item=FieldConfig(metrics=[M.Numeric(tolerance=10, mode="absolute")])), "array_f1")


_BY_PLACE = f"""WITH i AS ({_ITEMS}), a AS (SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN quantity + 1 ELSE quantity END AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY place DESC) AS nth FROM i WHERE {_DROPPED}),
j AS (SELECT i.l_orderkey, CASE WHEN a.quantity = i.quantity THEN 1 ELSE 0 END AS t, CASE WHEN a.nth IS NULL THEN 0 ELSE 1 END AS p, 1 AS x FROM i LEFT JOIN a ON a.l_orderkey = i.l_orderkey AND a.nth = i.place)"""


def _quantities(spark, sf):
    return _both(spark, sf, lambda _, quantity, place: quantity, lambda part, quantity, place: _changed(part, quantity))


@query(f"{_BY_PLACE} SELECT l_orderkey, precision AS array_precision, recall AS array_recall, f1 AS array_f1 FROM ({_PRF_SQL})")
def lineitem_place_metrics(spark, sf):
    found = typed.scores(_quantities(spark, sf), _items_config(["array_precision", "array_recall", "array_f1"], key_metric="array_f1"), keep=["l_orderkey"], at="items")
    return found.select("l_orderkey", *_round("array_precision", "array_recall", "array_f1"))


@query(f"{_BY_PLACE} SELECT l_orderkey, precision AS array_precision, recall AS array_recall, f1 AS array_f1 FROM ({_PRF_SQL})")
def lineitem_place_prf1(spark, sf):
    """The three at once, in the tree plan."""
    return tree_items(_quantities(spark, sf), _items_config(["array_prf1"]), "array_precision", "array_recall", "array_f1")


@query(f"SELECT l_orderkey, round(2.0 * same / (a + e), 6) AS array_f1 FROM ({_KEPT})")
def lineitem_optimal_compiled(spark, sf):
    """Optimal pairs in the compiled plan: only the pairing goes through Python, in Arrow batches."""
    config = _items_config(["array_f1"], strategy="hungarian", params={"threshold": 0.9})
    return typed.scores(_named(spark, sf, "rank"), config, keep=["l_orderkey"], at="items").select("l_orderkey", *_round("array_f1"))


# ---- metrics


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE round(2.0 * length(p_name) / (2 * length(p_name) + 4), 6) END AS fuzzy,
  round(2.0 * length(p_name) / (2 * length(p_name) + 4), 6) AS edit, round(2.0 * (length(p_name) - 2) / (2 * length(p_name) - 2), 6) AS cut FROM part""")
def part_edit_scores(spark, sf):
    """Words in another order, a word more, and a text without its first characters: what both have in common is known."""
    e = F.lower("p_name")
    backwards = F.array_join(F.reverse(F.split(e, " ")), " ")
    more = F.concat(e, F.lit(" zzz"))
    a = F.when(F.col("p_partkey") % 2 == 0, backwards).otherwise(more)
    return _table(spark, sf, "part").select("p_partkey", F.round(S.fuzzy(a, e), 6).alias("fuzzy"), F.round(S.levenshtein(more, e), 6).alias("edit"), F.round(S.levenshtein(F.substring(e, 3, 1 << 20), e), 6).alias("cut"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -CAST(event_id AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS number, event_id % 5 = 0 AND event_id % 3 = 0 AS neither FROM events""")
def events_parsed_numbers(spark, sf):
    k, text = F.col("event_id"), F.col("event_id").cast("string")
    written = F.when(k % 5 == 0, F.when(k % 3 != 0, "none")).when(k % 5 == 1, F.concat(F.lit("($"), text, F.lit(")"))).when(k % 5 == 2, F.concat(F.lit(" CAD "), text, F.lit(".00 "))).when(k % 5 == 3, F.concat(text, F.lit("%"))).otherwise(F.concat(text, F.lit("e0")))
    other = F.when(k % 3 != 0, text)
    both = S.exact_match(F.when(written.isNull(), written), F.when(other.isNull(), other)) == 1.0
    return _table(spark, sf, "events").select("event_id", parse_number(written, "string").alias("number"), (both & written.isNull() & other.isNull()).alias("neither"))


def _checked(spark, sf):
    """The price is a text in some documents."""
    df = order_pairs(spark, sf)
    k = F.col("o_orderkey")
    text = lambda price: F.concat(F.lit('{"status": "'), F.col("expected.status"), F.lit('", "price": '), price, F.when(k % 11 == 0, ', "priority": null}').otherwise(F.concat(F.lit(', "priority": "'), F.col("expected.priority"), F.lit('"}'))))
    whole = F.floor("expected.price").cast("string")
    actual = text(F.when(k % 7 == 0, F.concat(F.lit('"'), whole, F.lit('"'))).otherwise(whole))
    expected = F.concat(F.lit('{"priority": "'), F.col("expected.priority"), F.lit('", "price": '), whole, F.lit(', "status": "'), F.col("expected.status"), F.lit('"}'))
    return df.select("o_orderkey", actual.alias("actual"), expected.alias("expected"))


@query("""SELECT o_orderkey, round((1 + CAST(o_orderkey % 7 <> 0 AS INT) + CAST(o_orderkey % 11 <> 0 AS INT)) / 3, 6) AS object_type_validity, CAST(o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS DOUBLE) AS object_exact_match FROM orders""")
def orders_object_checks(spark, sf):
    found = tree.scores(_checked(spark, sf), EvalConfig(metrics=["object_type_validity", "object_exact_match"]), sample_id="o_orderkey")
    return found.select(_id(), *(F.round(F.col("metrics")[m], 6).alias(m) for m in ("object_type_validity", "object_exact_match")))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 13 = 0 THEN 1 / 3 ELSE 1 END, 6) AS structural_similarity FROM orders")
def orders_structural_similarity(spark, sf):
    found = tree.scores(_texts(spark, sf, True), EvalConfig(metrics=["structural_similarity"]), sample_id="o_orderkey")
    return found.select(_id(), F.round(F.col("metrics")["structural_similarity"], 6).alias("structural_similarity"))


_PAYLOADS = ("path", "metrics", "extras")
_SCHEMA = {
    "definitions": {"text": {"type": "string"}}, "type": "object", "required": ["status", "price"], "additionalProperties": False, "properties": {"status": {"$ref": "#/definitions/text"}, "price": {"type": "number", "minimum": 0}, "priority": {"$ref": "#/definitions/text"}}
}


@query("""SELECT v.kind, v.item, count(*) AS n FROM orders JOIN (VALUES ('type_errors', 'price', 7), ('type_errors', 'priority', 11)) AS v(kind, item, every) ON o_orderkey % v.every = 0 GROUP BY v.kind, v.item""")
def orders_schema_errors(spark, sf):
    """The lists of what is wrong with documents, and their items."""
    reports = tree.evaluate(_checked(spark, sf), EvalConfig(metrics=[M.SchemaValidity(_SCHEMA)]), sample_id="o_orderkey", node_fields=_PAYLOADS)
    found = R.extras(reports, "schema_validity", [f"schema_errors.{kind}" for kind in ("type_errors", "missing_required", "extra_fields")])
    return found.groupBy(F.substring_index("key", ".", -1).alias("kind"), "item").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT kind, name, count(*) AS n FROM (
  SELECT 'missing_required' AS kind, 'price' AS name FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'extra_fields', 'note' FROM orders WHERE o_orderkey % 13 = 0) GROUP BY kind, name""")
def orders_model_errors(spark, sf):
    """Validity against a class that is declared in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pydantic import BaseModel, ConfigDict

        from fieldloom.schemas import validate

        class Order(BaseModel):
            model_config = ConfigDict(extra="forbid")
            status: str
            price: float

        for batch in batches:
            found = [(kind, name) for t in batch.column(0).to_pylist() for kind, names in validate(json.loads(t), Order).items() if isinstance(names, list) for name in names]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], names=["kind", "name"])

    return _texts(spark, sf, True).select("actual").mapInArrow(run, "kind string, name string").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT v.name, v.passed, count(*) AS n FROM (SELECT o_orderkey % 13 <> 0 AND o_totalprice * (CASE WHEN o_orderkey % 7 = 0 THEN 1.02 ELSE 1 END) > 1000 AS big, o_orderkey % 13 <> 0 AS priced FROM orders), LATERAL (SELECT unnest(['$.price gt 1000', 'priced']) AS name, unnest([big, priced]) AS passed) AS v GROUP BY v.name, v.passed")
def orders_rule_results(spark, sf):
    """Each rule's name and verdict; one is a function, which fails documents by raising."""

    def priced(document):
        return document["price"] > 0

    config = EvalConfig(metrics=[M.RulePassRate([rules.Rule("$.price").gt(1000), rules.Rule.custom(priced)])])
    reports = tree.evaluate(_texts(spark, sf, True), config, sample_id="o_orderkey", node_fields=_PAYLOADS)
    found = R.extras(reports, "rule_pass_rate", "rule_results").select(F.from_json("item", "name string, passed boolean").alias("r"))
    return found.groupBy("r.name", "r.passed").agg(F.count(F.lit(1)).alias("n"))


# ---- metrics of one's own


def _own_metrics() -> EvalConfig:
    """Classes of each kind; declaring them names them."""

    class FirstLetter(M.FieldMetric):
        name = "first_letter"

        def score(self, actual, expected):
            return None if actual is None else float(str(actual)[:1] == str(expected)[:1])

    class Fields(M.ObjectMetric):
        name = "half_of_fields"

        def compute(self, node):
            return {"good": sum(c.representative() for c in node.children), "all": len(node.children)}

    class Depth(M.RootMetric):
        name = "nodes_in_all"

        def compute(self, node):
            return len(list(node.walk())), {"kinds": sorted({n.kind for n in node.walk()})}

    class Known(M.AnyNodeMetric):
        name = "is_known"

        def compute(self, node):
            return float(node.actual is not None)

    class Either(M.GenericMetric):
        name = "either"

        def score_scalar(self, actual, expected):
            return float(actual == expected)

        def compute_object(self, node):
            return 1.0

    assert M.get_metric_class("first_letter") is FirstLetter and isinstance(M.resolve("is_known"), Known)
    status = FieldConfig(metrics=["first_letter", FirstLetter(name="again")])
    return EvalConfig(metrics=[Fields(), "nodes_in_all", "is_known", Either()], fields={"status": status}, key_metric="is_known")


@query("""SELECT o_orderkey, 1.0 AS first_letter, 1.0 AS again, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 1.0 END AS known, CASE WHEN o_orderkey % 11 = 0 THEN 2.0 ELSE 3.0 END AS good, 3.0 AS fields, 4.0 AS nodes, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 1.0 END AS either, '["object", "scalar"]' AS kinds FROM orders""")
def orders_own_metrics(spark, sf):
    """Metrics of fields, objects, the root, any node and several kinds, with sub-scores, extras, no value and names of their own."""
    df = order_pairs(spark, sf).select("o_orderkey", json_of(F.col("actual")).alias("actual"), json_of(F.col("expected").withField("status", F.col("actual.status"))).alias("expected"))
    reports = tree.evaluate(df, _own_metrics(), sample_id="o_orderkey", node_fields=[*_PAYLOADS, "score"])
    node = lambda path: F.get(F.filter("nodes", lambda n: n["path"] == path), F.lit(0))
    root, status, priority = node("$"), node("status"), node("priority")
    return reports.select(
        _id(), status["metrics"]["first_letter"].alias("first_letter"), status["metrics"]["again"].alias("again"), priority["score"].alias("known"), root["metrics"]["good"].alias("good"), root["metrics"]["all"].alias("fields"),
        root["metrics"]["nodes_in_all"].alias("nodes"), priority["metrics"]["either"].alias("either"), F.get_json_object(root["extras"]["nodes_in_all"], "$.kinds").alias("kinds"),
    ).withColumn("kinds", F.replace("kinds", F.lit(","), F.lit(", ")))


# ---- what is asked of reports


@query(f"""SELECT o_orderkey, metric, round(mean, 6) AS mean, least, most, root, round(coalesce(root, mean), 6) AS representative FROM (
  SELECT o_orderkey, 'exact_match' AS metric, (a + c) / 2 AS mean, least(a, c) AS least, greatest(a, c) AS most, CAST(NULL AS DOUBLE) AS root FROM ({_CHILDREN}) UNION ALL
  SELECT o_orderkey, 'numeric', b, b, b, NULL FROM ({_CHILDREN}) UNION ALL
  SELECT o_orderkey, 'object_accuracy', {_SCORE}, {_SCORE}, {_SCORE}, {_SCORE} FROM ({_CHILDREN}))""")
def orders_metric_collections(spark, sf):
    found = R.collections(_order_reports(spark, sf, detailed=True)).filter("metric <> 'mean_score'")
    return found.select(_id(), "metric", F.round("mean", 6).alias("mean"), F.round("min", 6).alias("least"), F.round("max", 6).alias("most"), F.round("root", 6).alias("root"), F.round("representative", 6).alias("representative"))


def _broken(spark, sf):
    k = F.col("o_orderkey")
    return _texts(spark, sf).withColumn("actual", F.when(k % 17 == 0, '{"status": "cut').otherwise(F.col("actual")))


@query(f"""SELECT count(*) AS samples, round(avg(CASE WHEN o_orderkey % 17 <> 0 THEN (a + 2 * b + c) / 4 END), 6) AS score, round(avg(CASE WHEN o_orderkey % 17 <> 0 AND a + b + c = 3 THEN 1.0 ELSE 0.0 END), 6) AS perfect_response_rate,
  round(avg(CASE WHEN o_orderkey % 17 = 0 THEN 1.0 ELSE 0.0 END), 6) AS parse_error_rate FROM ({_CHILDREN})""")
def orders_batch_with_errors(spark, sf):
    return R.batch(tree.evaluate(_broken(spark, sf), _PRF_CONFIG, sample_id="o_orderkey", node_fields=R.BATCH_FIELDS)).select("samples", *_round("score", "perfect_response_rate", "parse_error_rate"))


@query(f"""SELECT unnest(['exact_match', 'numeric', 'object_accuracy']) AS metric, unnest([round(x, 6), round(y, 6), round(z, 6)]) AS value FROM (
  SELECT avg((a + c) / 2) AS x, avg(b) AS y, avg((a + 2 * b + c) / 4) AS z FROM ({_CHILDREN}) WHERE o_orderkey % 17 <> 0)""")
def orders_batch_metrics(spark, sf):
    config = EvalConfig(metrics=["object_accuracy"], fields={"price": FieldConfig(metrics=["numeric"], weight=2.0)}, key_metric="object_accuracy")
    found = R.batch_metrics(tree.evaluate(_broken(spark, sf), config, sample_id="o_orderkey", node_fields=_PAYLOADS))
    return found.filter(F.col("metric").isin("exact_match", "numeric", "object_accuracy")).select("metric", F.round("value", 6).alias("value"))


@query(f"SELECT o_custkey, count(*) AS runs, round(avg((a + 2 * b + c) / 4), 6) AS mean_score, round(var_pop((a + 2 * b + c) / 4), 6) AS score_variance FROM ({_CHILDREN}) GROUP BY o_custkey")
def customer_run_scores(spark, sf):
    config = EvalConfig(metrics=["object_accuracy"], fields={"price": FieldConfig(metrics=["numeric"], weight=2.0)}, key_metric="object_accuracy")
    found = R.consistency(typed.evaluate(order_pairs(spark, sf), config, sample_id="o_custkey", detailed=False), "sample_id")
    return found.select(F.col("sample_id").cast("bigint").alias("o_custkey"), "runs", *_round("mean_score", "score_variance"))


@query(f"""SELECT o_orderkey, o_orderkey % 17 <> 0 AND a + b + c = 3 AS success, CASE WHEN o_orderkey % 17 = 0 THEN 'parse error' WHEN a + b + c = 3 THEN 'all fields pass' ELSE 'failed: ' || concat_ws(', ', '$=' || printf('%.2f', (a + 2 * b + c) / 4),
  CASE WHEN b < 1 THEN 'price=0.00' END, CASE WHEN c < 1 THEN 'priority=0.00' END, CASE WHEN a < 1 THEN 'status=0.00' END) END AS reason FROM ({_CHILDREN})""")
def orders_verdicts(spark, sf):
    found = R.verdicts(tree.evaluate(_broken(spark, sf), _PRF_CONFIG, sample_id="o_orderkey", node_fields=["path", "score", "threshold"]))
    return found.select(_id(), "success", F.regexp_replace("reason", "^parse error.*", "parse error").alias("reason"))


@query("SELECT * FROM (VALUES ('field', FALSE), ('metric', FALSE), ('parse', TRUE), ('parse broken', FALSE), ('score', TRUE), ('score 1', FALSE)) AS v(assertion, holds)")
def orders_assertions(spark, sf):
    """Assertions on reports raise or do nothing."""
    reports, broken = _order_reports(spark, sf, detailed=True), tree.evaluate(_broken(spark, sf), _PRF_CONFIG, sample_id="o_orderkey")

    def holds(check, *args) -> bool:
        try:
            check(*args)
        except AssertionError:
            return False
        return True

    rows = [
        ("parse", holds(R.assert_no_parse_errors, reports)), ("parse broken", holds(R.assert_no_parse_errors, broken)), ("score", holds(R.assert_score, reports, 0.0)), ("score 1", holds(R.assert_score, reports, 1.0)),
        ("field", holds(R.assert_field, reports, "price")), ("metric", holds(R.assert_metric, reports, "object_accuracy", 1.0)),
    ]
    return spark.createDataFrame(rows, "assertion string, holds boolean")


@query(f"SELECT metric, round(avg(d), 6) AS delta FROM (SELECT unnest(['numeric', 'object_accuracy']) AS metric, unnest([CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0 END, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0 END]) AS d FROM ({_CHILDREN})) GROUP BY metric")
def orders_metric_deltas(spark, sf):
    found = R.diff_metrics(_order_reports(spark, sf, 0.05, True), _order_reports(spark, sf, detailed=True), ["numeric", "object_accuracy"])
    return found.groupBy("metric").agg(F.round(F.avg("delta"), 6).alias("delta"))


@query(f"SELECT l_orderkey, round(avg((n + 1) / 2), 6) AS middle, CAST(max(n) AS BIGINT) AS items FROM ({_ITEMS}) GROUP BY l_orderkey")
def lineitem_places(spark, sf):
    """Pairs by place as the report's matches list them."""
    found = R.matches(typed.evaluate(_nested(spark, sf), EvalConfig(), sample_id="l_orderkey")).filter("expected_index IS NOT NULL")
    return found.groupBy(F.col("sample_id").cast("bigint").alias("l_orderkey")).agg(F.round(F.avg(F.col("expected_index") + 1), 6).alias("middle"), F.count(F.lit(1)).alias("items"))
