import warnings

import pytest

import fieldloom as f
from fieldloom import metrics, rules, schemas
from fieldloom.operators import assign
from fieldloom.plans import tree


def test_reports_answer_to_names_and_go_through_files(tmp_path):
    config = f.EvalConfig(metrics=["object_f1"], fields={"b": f.FieldConfig(metrics=["numeric"])})
    r = f.evaluate({"a": 1, "b": 100.5}, '{"a": 2, "b": 100}', config)
    assert r.score == r["score"] == 0.5 and r.metrics["object_f1"].root == 0.5 and r.metrics["exact_match"].mean == 0.0 and r.metrics["numeric"].representative == 1.0
    assert [n["path"] for n in r.failed_fields()] == ["$", "a"] and r.fields["b"] == 1.0
    r.to_json(str(tmp_path / "r.json"))
    again = f.EvalReport.from_json(str(tmp_path / "r.json"))
    assert again == f.EvalReport.from_dict(r.to_dict()) and again.diff(r) == {"$": 0.0, "a": 0.0, "b": 0.0} and again.metrics["object_f1"].values == [0.5]
    with pytest.raises(AttributeError):
        r.nothing
    assert f.evaluate("{", "{}").parse_error


def test_lists_of_samples():
    samples = [f.Sample({"a": 1}, {"a": 1}), f.Sample({"a": 1}, {"a": 2}), f.Sample('{"a', {"a": 1})]
    got = f.evaluate_batch(samples, f.EvalConfig(metrics=["object_f1"]))
    assert (got.score, got.perfect_response_rate, got.parse_error_rate) == (0.5, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got.metrics["object_f1"] == 0.5 and got.field_breakdown["a"] == {"n": 2, "mean": 0.5, "min": 0.0, "max": 1.0, "p95": 0.95, "fail_rate": 0.5} and len(list(got)) == 3
    runs = f.Evaluator().consistency(samples)
    assert runs.mean_score == 0.5 and runs.score_variance == 0.25 and runs.unstable_fields == ["a"] and f.evaluate_consistency([]).mean_score is None
    assert f.Evaluator().batch([]).score is None and f.evaluate_batch(samples[2:]).score is None


def test_lists_and_tables_agree(spark):
    samples = [f.Sample({"a": k % 2, "b": [k, 1]}, {"a": 0, "b": [k, k]}) for k in range(8)]
    df = spark.createDataFrame([(str(k), s.actual["a"], s.actual["b"], s.expected["b"]) for k, s in enumerate(samples)], "id string, x int, y array<int>, z array<int>")
    df = df.selectExpr("struct(x AS a, y AS b) AS actual", "struct(0 AS a, z AS b) AS expected")
    row, own = f.Evaluator().batch(df).first(), f.evaluate_batch(samples)
    assert row["score"] == pytest.approx(own.score) and row["perfect_response_rate"] == pytest.approx(own.perfect_response_rate)


def test_paths():
    x = {"a": {"b": [1, {"c.d": 2}]}, "n": None}
    assert rules.navigate(x, "a.b[0]") == 1 and rules.navigate(x, "$.a.b[-1]['c.d']") == 2 and rules.navigate(x, "n") is None and rules.navigate(x, "$") is x and rules.navigate(x, "") is x
    assert rules.navigate(x, "a.x") is rules.MISSING and rules.navigate(x, "a.b[5]") is rules.MISSING and rules.navigate([3], "[0]") == 3


def test_own_alignment():
    class Backwards(assign.Aligner):
        name = "backwards"
        params = ("skip",)

        def align(self, expected, actual, skip=0):
            n = min(len(expected), len(actual))
            return [(i, n - 1 - i) for i in range(skip, n)]

    r = f.evaluate([1, 2, 3], [3, 2, 1], f.EvalConfig(root=f.ArrayFieldConfig(strategy="backwards")))
    assert r.score == 1.0
    r = f.evaluate([1, 2, 3], [3, 2, 1], f.EvalConfig(root=f.ArrayFieldConfig(strategy="backwards", params={"skip": 1})))
    assert r.score == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        f.ArrayFieldConfig(strategy="none")
    with pytest.raises(TypeError):
        f.ArrayFieldConfig(strategy="backwards", params={"key": "a"})


def test_large_optimal_alignments_warn():
    with pytest.warns(UserWarning, match="101 x 100"):
        assign.hungarian(list(range(101)), list(range(100)))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assign.hungarian(list(range(5)), list(range(5)))


def test_one_metric_on_two_values():
    assert metrics.invoke("exact_match", 1, 1) == {"exact_match": 1.0}
    assert metrics.invoke("object_prf1", {"a": 1}, {"a": 1, "b": 2})["object_recall"] == 0.5
    assert metrics.invoke("array_cardinality", [1], [1, 2]) == {"array_cardinality": 0.5}


def test_references_in_schemas():
    item = {"definitions": {"item": {"type": "object", "required": ["k"], "properties": {"k": {"$ref": "#/definitions/key"}, "next": {"$ref": "#/definitions/item"}}}, "key": {"type": "integer"}}, "$ref": "#/definitions/item"}
    assert schemas.validate({"k": 1, "next": {"k": 2}}, item)["valid"]
    found = schemas.validate({"k": "x", "next": {"next": {"k": 1.5}}}, item)
    assert not found["valid"] and found["type_errors"] == ["k", "next.next.k"] and found["missing_required"] == ["k"]
    assert schemas.validate([1], {"items": {"$ref": "#foo"}, "$defs": {"a": {"$id": "#foo", "type": "integer"}}})["valid"]
    assert schemas.validate({"a/b": 1}, {"properties": {"a/b": {"$ref": "#/$defs/x~1y"}}, "$defs": {"x/y": {"maximum": 0}}})["type_errors"] == ["a/b"]
    for bad in ({"$ref": "other.json"}, {"$ref": "#/nowhere"}, {"$ref": "#"}, {"typ": "object"}):
        with pytest.raises(ValueError):
            schemas.validate({}, bad)


def test_host_functions_take_the_documents():
    from types import SimpleNamespace as N

    from fieldloom.integrations import StructuredEvaluator

    own = StructuredEvaluator(extract_actual=lambda run: run.said, extract_expected=lambda example: example.wanted)
    assert own(N(said={"a": 1}), N(wanted={"a": 1}))["score"] == 1.0
    assert StructuredEvaluator()(N(outputs={"output": {"a": 1}}), N(outputs={"output": {"a": 2}}))["score"] == 0.0


def test_scores_are_those_of_the_reports(spark):
    df = spark.createDataFrame([("1", '{"a": 1, "b": 2}', '{"a": 1, "b": 3}'), ("2", "{", "{}")], "id string, actual string, expected string")
    a, b = (x.orderBy("sample_id").collect() for x in (tree.scores(df, sample_id="id"), tree.evaluate(df, sample_id="id")))
    assert [(r.score, r.parse_error) for r in a] == [(r.score, r.parse_error) for r in b] == [(0.5, False), (None, True)] and a[0].metrics["object_accuracy"] == 0.5


def test_both_plans_pair_alike(spark):
    from fieldloom.plans import typed

    rows = [([3.0, 1.0, 2.0], [1.0, 2.05, 9.0]), ([], [1.0]), ([5.0], []), ([1.0, 1.0], [1.0, 1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame([(str(k), a, e) for k, (a, e) in enumerate(rows)], "id string, a array<double>, e array<double>").selectExpr("id", "struct(a AS xs) AS actual", "struct(e AS xs) AS expected")
    for strategy, params in (("hungarian", {"threshold": 0.5}), ("by_key", {}), ("by_key", {"key_metric": "numeric_closeness", "threshold": 0.9}), ("by_index", {})):
        config = f.EvalConfig(fields={"xs": f.ArrayFieldConfig(strategy=strategy, params=params, metrics=["array_accuracy"], item=f.FieldConfig(metrics=["numeric_closeness"]))})
        one, other = (plan.evaluate(df, config, sample_id="id").selectExpr("sample_id", "score", "sort_array(matches) AS m").orderBy("sample_id").collect() for plan in (typed, tree))
        assert [(r.sample_id, pytest.approx(r.score), r.m) for r in one] == [(r.sample_id, r.score, r.m) for r in other], strategy


def test_a_metric_without_an_expression_in_the_compiled_plan(spark):
    from fieldloom.plans import typed

    class Halves(metrics.FieldMetric):
        def score(self, actual, expected):
            return None if actual is None else 0.5

    df = spark.createDataFrame([(1, "x"), (None, "y")], "a int, e string").selectExpr("struct(a AS v) AS actual", "struct(e AS v) AS expected")
    config = f.EvalConfig(fields={"v": f.FieldConfig(metrics=[Halves(name="halves")])})
    assert sorted(r.halves or -1 for r in typed.scores(df, config, at="v").collect()) == [-1, 0.5]
