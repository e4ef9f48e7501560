"""What a task holds does not grow with its documents."""

import pytest

from fieldloom import ArrayFieldConfig, EvalConfig, FieldConfig, ObjectFieldConfig, detail_queries, queries
from fieldloom.plans.tree import Builder

ITEMS = {"items": [1.0, 2.0, 3.0]}
ORDER = {"status": "O", "price": 2.0, "priority": None}
CONFIGS = {
    "lineitem_place_prf1": (detail_queries._items_config(["array_prf1"]), ITEMS),
    "lineitem_hungarian_callable": (detail_queries._items_config(["array_f1"], strategy="hungarian"), ITEMS),
    "orders_parsed_documents": (queries._PRF_CONFIG, ORDER),
    "orders_own_metrics": (EvalConfig(metrics=["object_accuracy"], fields={"status": FieldConfig(metrics=["exact_match"])}), ORDER),
    "dotted": (EvalConfig(fields={"a.b": FieldConfig(metrics=["presence"]), "a.c.d": FieldConfig(metrics=["presence"])}), {"a": {"b": 1, "c": {"d": 2}}}),
    "nested": (EvalConfig(root=ObjectFieldConfig(fields={"xs": ArrayFieldConfig(item=ObjectFieldConfig(fields={"p.q": FieldConfig()}))})), {"xs": [{"p": {"q": 1}}]}),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_a_builder_keeps_nothing_of_its_documents(name):
    config, document = CONFIGS[name]
    builder = Builder(config)
    builder.evaluate(document, document, None)
    held = len(builder.known), len(builder.below)
    for k in range(5):
        builder.evaluate({**document, f"more{k}": {"x": k}}, document, None)
    more = len(builder.known), len(builder.below)
    for k in range(50):
        builder.evaluate({**document, f"other{k}": {"x": k}}, document, None)
    assert (len(builder.known), len(builder.below)) == more and more[0] <= held[0] + 2


def test_metrics_of_modules_that_workers_lack(spark, monkeypatch):
    import sys
    import types

    from fieldloom import metrics
    from fieldloom.plans import tree

    module = types.ModuleType("only_on_the_driver")
    monkeypatch.setitem(sys.modules, module.__name__, module)
    monkeypatch.setattr(metrics, "REGISTRY", dict(metrics.REGISTRY))
    exec("from fieldloom.metrics import FieldMetric\nclass Here(FieldMetric):\n    name = 'only_here'\n    def score(self, actual, expected):\n        return 1.0", module.__dict__)
    df = spark.createDataFrame([("1", '{"a": 1}', '{"a": 1}')], "id string, actual string, expected string")
    assert tree.scores(df, sample_id="id").first().score == 1.0
    with pytest.raises(Exception, match="only_here"):
        tree.scores(df, EvalConfig(metrics=["only_here"]), sample_id="id").collect()


def test_only_the_fields_asked_for(spark):
    from fieldloom.plans import tree

    df = spark.createDataFrame([("1", '{"a": [1, 2], "n": null}', '{"a": [1, 3]}'), ("2", "{", "{}"), ("3", "{}", "{}")], "id string, actual string, expected string")
    whole, some = ({r.sample_id: r.asDict(True) for r in tree.evaluate(df, sample_id="id", node_fields=f).collect()} for f in (None, ["path", "score", "metrics"]))
    for k, row in whole.items():
        assert [(n["path"], n["score"], n["metrics"]) for n in row["nodes"]] == [(n["path"], n["score"], n["metrics"]) for n in some[k]["nodes"]]
        assert all(n["actual"] is None and n["extras"] == {} for n in some[k]["nodes"])
        assert {f: row[f] for f in row if f != "nodes"} == {f: some[k][f] for f in row if f != "nodes"}
    assert [n["actual"] for n in whole["1"]["nodes"]] == ['{"a": [1, 2], "n": null}', "[1, 2]", "1", "2", None]
    at = {r.sample_id: r.metrics for r in tree.scores(df, sample_id="id", at="a").collect()}
    assert at == {"1": {"array_accuracy": 0.5, "mean_score": 0.5}, "2": None, "3": None}
    with pytest.raises(ValueError, match="no place"):
        tree.evaluate(df, node_fields=["place"])


def test_tables_are_aligned_in_parts_that_do_not_grow_with_them(spark, monkeypatch):
    from fieldloom.operators import arrays

    items = queries._items(spark, "/root/testdata/sf0.001")
    few = arrays.parts(items)
    monkeypatch.setattr(arrays, "PART_BYTES", 10_000)
    assert arrays.parts(items) > few == 4
    found = arrays.align_by_index(items, items.filter("l_partkey % 3 = 0"), ["l_orderkey"], "place")
    assert found.rdd.getNumPartitions() == arrays.parts(items, items) and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("in_expected").count() == items.count() and found.filter("in_actual").count() == items.filter("l_partkey % 3 = 0").count()
    assert found.filter("in_expected AND in_actual AND e_place > a_place").count() == 0


def test_pairs_need_no_item_in_the_compiled_plan(spark):
    from fieldloom.operators import reports as R
    from fieldloom.plans import typed

    found = R.matches(typed.evaluate(queries._nested(spark, "/root/testdata/sf0.001"), EvalConfig(), sample_id="l_orderkey"))
    assert "expected_path" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_errors_come_of_one_evaluation(spark):
    plan = detail_queries.orders_schema_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_texts_with_a_normal_form_pair_by_equality(spark):
    plan = detail_queries.lineitem_folded_key(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan and "exists(" not in plan
    assert arrays_of_texts(spark) == [[(0, 1), (1, 0), (3, 2)]]


def arrays_of_texts(spark):
    from fieldloom.plans import typed

    df = spark.sql("SELECT named_struct('xs', array('A', 'b ', 'c', NULL)) AS expected, named_struct('xs', array('B', 'a', NULL, 'a')) AS actual")
    config = EvalConfig(fields={"xs": ArrayFieldConfig(strategy="by_key", params={"key_metric": "regex_match"})})
    return [sorted((m.expected_index, m.actual_index) for m in r.matches if None not in (m.expected_index, m.actual_index)) for r in typed.evaluate(df, config).collect()]


def test_the_usual_normal_form_takes_one_replacement(spark):
    from fieldloom import functions as S
    from fieldloom.metrics import RegexMatch

    texts = ["", " ", " A \tb \n", "a\u0085B", "x", "  　İ  y​ ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(S.plain(df.t).alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r[0] for r in df.select(S.plain(df.t)).collect()] == [None if t is None else RegexMatch().plain(t) for t in texts]
    general = S.strip(S.plain(S.strip(df.t), r"\s+", " ", strip_ends=False))
    assert [tuple(r) for r in df.select(S.plain(df.t), general).collect() if r[0] != r[1]] == []
