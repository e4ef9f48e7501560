import json

import pytest

from fieldloom import ArrayFieldConfig, EvalConfig, Evaluator, FieldConfig, ObjectFieldConfig, Rule, Sample, evaluate, structured_diff
from fieldloom import integrations, reporting
from fieldloom import metrics as M
from fieldloom.operators import reports as R
from fieldloom.plans import tree, typed
from fieldloom.schemas import validate
from fieldloom.sources import ParseError, parse, read_jsonl, read_reports, samples_from_text, write_reports
from fieldloom.sources.documents import lines

INVOICE = {"id": "INV", "vendor": "Acme", "total": 100.0, "status": "paid"}


def nodes(report):
    return {n["path"]: n for n in report["nodes"]}


def value(report, metric, path="$"):
    return dict(nodes(report)[path]["metrics"])[metric]


def test_golden_invoices():
    f1 = EvalConfig(metrics=["object_f1"])
    assert evaluate(INVOICE, INVOICE, f1)["score"] == 1
    assert evaluate({**INVOICE, "total": 90}, INVOICE, f1)["score"] == 0.75
    assert evaluate({k: v for k, v in INVOICE.items() if k != "status"}, INVOICE, f1)["score"] == pytest.approx(6 / 7)


def test_reordered_entities_by_key():
    e = [{"text": t, "label": "X"} for t in ("a", "b", "c")]
    a = [e[1], e[0], {"text": "d", "label": "X"}]
    r = evaluate({"entities": a}, {"entities": e}, EvalConfig(fields={"entities": ArrayFieldConfig(strategy="by_key", params={"key": "text"}, metrics=["array_f1"])}))
    assert value(r, "array_f1", "entities") == pytest.approx(2 / 3)
    assert sum(m["actual_index"] is None for m in r["matches"]) == 1 == sum(m["expected_index"] is None for m in r["matches"])


def test_deep_nest_and_tool_call():
    leaf = EvalConfig(metrics=["overall_leaf_score"])
    assert evaluate({"a": {"b": {"c": {"d": 1, "e": 2}}}}, {"a": {"b": {"c": {"d": 1, "e": 3}}}}, leaf)["score"] == 0.5
    r = evaluate({"name": "w", "arguments": {"city": "R", "unit": "c"}}, {"name": "w", "arguments": {"city": "R", "unit": "f"}}, leaf)
    assert r["score"] == pytest.approx(2 / 3) and nodes(r)["arguments.unit"]["score"] == 0


def test_extra_and_missing_keys():
    a, e = {"a": 1, "x": 2}, {"a": 1, "m": 3}
    r = evaluate(a, e, EvalConfig(metrics=["object_prf1"]))
    assert {(w["kind"], w["path"]) for w in r["warnings"]} == {("extra_key", "x"), ("missing_field", "m")}
    assert value(r, "object_precision") == 1 and value(r, "object_recall") == 0.5
    assert value(evaluate(a, e, EvalConfig(metrics=["object_prf1"], extra_keys="penalize")), "object_precision") == 0.5
    assert "x" in nodes(r)  # still a leaf


def test_documents_without_expectation():
    r = evaluate({"a": [1, 2]}, None, EvalConfig(metrics=["object_f1"]))
    assert r["score"] == 1 and "a[0]" not in nodes(r)


def test_root_arrays_and_empty_ones():
    r = evaluate([1, 2, 4], [1, 2, 3])
    assert r["score"] == pytest.approx(2 / 3) and nodes(r)["$[2]"]["score"] == 0
    assert evaluate([], [])["score"] == 1


def test_cascade_and_errors():
    own = EvalConfig(metrics=["object_f1", "exact_match"], fields={"total": FieldConfig(metrics=["numeric"], weight=3)})
    r = evaluate({**INVOICE, "total": 100.5}, INVOICE, own)
    assert set(dict(nodes(r)["total"]["metrics"])) == {"numeric", "exact_match", "mean_score"}
    for bad in (EvalConfig(fields={"total": FieldConfig(metrics=["object_f1"])}), EvalConfig(fields={"total": FieldConfig(key_metric="array_f1")})):
        with pytest.raises(ValueError, match="cannot score"):
            evaluate(INVOICE, INVOICE, bad)
    with pytest.raises(ValueError, match="twice"):
        evaluate(INVOICE, INVOICE, EvalConfig(metrics=["object_f1", "object_f1"]))
    with pytest.raises(ValueError):
        EvalConfig(default_scalar_metrics=[])
    with pytest.raises(TypeError):
        ArrayFieldConfig(params={"key": "x"})
    dotted = EvalConfig(fields={"a.b": FieldConfig(metrics=["presence"])})
    assert "presence" in dict(nodes(evaluate({"a": {"b": 1}}, {"a": {"b": 2}}, dotted))["a.b"]["metrics"])


def test_policies_modes_and_composites():
    fuzzy = M.ObjectF1(score_policy={"vendor": "regex_match"}, threshold={"total": 0.5}, name="f")
    config = EvalConfig(metrics=[fuzzy], fields={"total": FieldConfig(metrics=["numeric_closeness"])}, key_metric="f")
    config = EvalConfig(metrics=[fuzzy], fields=config.fields, root=ObjectFieldConfig(fields=config.fields, key_metric=fuzzy))
    assert evaluate({**INVOICE, "vendor": "ACME ", "total": 60}, INVOICE, config)["score"] == 1
    mix = FieldConfig(metrics=["exact_match", "presence"], key_metric=M.CompositeScore({"exact_match": 3, "presence": 1}))
    assert nodes(evaluate({"a": 1}, {"a": 2}, EvalConfig(fields={"a": mix})))["a"]["score"] == 0.25
    with pytest.raises(ValueError):
        M.CompositeScore({})


class Same(M.GenericMetric):
    name = "same_length_for_tests"

    def score_scalar(self, a, e):
        return float(len(str(a)) == len(str(e)))

    def compute_array(self, node):
        return 0.5, {"note": [1, 2]}


def test_custom_metrics(spark):
    r = evaluate({"a": "xy", "b": [1]}, {"a": "zz", "b": [2]}, EvalConfig(metrics=[Same()]))
    assert value(r, "same_length_for_tests", "a") == 1 and json.loads(dict(nodes(r)["b"]["extras"])["same_length_for_tests"]) == {"note": [1, 2]}


def test_parsing():
    assert parse('{"a": 1}') == {"a": 1} and parse("a: 1\nb: [x]") == {"a": 1, "b": ["x"]} and parse("3") == 3
    assert parse("2: x\ntrue: y") == {"2": "x", "true": "y"}
    for bad in ("just text", '{"a": "cut', "a: 2026-13-45"):
        with pytest.raises(ParseError, match="Invalid JSON"):
            parse(bad)
    assert lines('{"a":1}\n\n [2] \n') == [{"a": 1}, [2]]
    with pytest.raises(ParseError, match="line 2"):
        lines("1\n{\n")
    r = evaluate("{oops", INVOICE)
    assert r["parse_error"] and "Invalid JSON" in r["parse_error_message"] and r["nodes"] == []
    with pytest.raises(TypeError):
        Sample(3.5)


def test_rules_and_schema():
    rules = [Rule("$.total").eq("$.net + $.tax"), Rule("$.items[*].q").gt(0), Rule("$.none").eq(1), Rule("$.total").in_([3, 5]), Rule("$.total").lt("$.a.b"), Rule("$.total").gt("x"), Rule.custom(lambda d: d["net"] > 1, name="net")]
    document = {"total": 5, "net": 3, "tax": 2, "items": [{"q": 1}]}
    assert [r.evaluate(document)["passed"] for r in rules] == [True, True, False, True, False, False, True]
    assert rules[0].name == "$.total eq $.net + $.tax"
    with pytest.raises(ValueError):
        Rule("$.a").evaluate({})
    with pytest.raises(ValueError):
        Rule("no path")
    schema = {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"enum": ["x"]}}}
    found = validate({"a": "1", "c": 2}, schema)
    assert found["type_errors"] == ["a"] and found["missing_required"] == ["b"] and found["extra_fields"] == ["$"] and found["type_error_rate"] == 0.5
    assert validate({"a": 1, "b": "x"}, schema)["valid"]
    import pydantic

    class Model(pydantic.BaseModel, extra="forbid"):
        a: int
        b: str

    found = validate({"a": "q", "c": 1}, Model)
    assert found["type_errors"] == ["a"] and found["missing_required"] == ["b"] and found["extra_fields"] == ["c"]
    with pytest.raises(TypeError):
        validate({}, 3)


def test_differences():
    d = structured_diff({"a": [1, 2], "n": {"x": 1}, "t": 1}, {"a": [1, 3, 4], "m": {"y": [1]}, "t": "1", "n": {"x": 1}})
    assert [(x["path"], x["change"]) for x in d] == [("a[1]", "changed"), ("a[2]", "removed"), ("m", "removed"), ("t", "changed")]
    assert structured_diff('{"a": 1}', "a: 1") == []


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("s1", INVOICE, INVOICE), ("s2", {**INVOICE, "total": 50.0}, INVOICE), ("s3", "{bad", INVOICE)]
    return spark.createDataFrame([(i, a if isinstance(a, str) else json.dumps(a), json.dumps(e), "acme invoice INV paid 100") for i, a, e in rows], "id string, actual string, expected string, source string")


def test_tables_of_samples(spark, samples, tmp_path):
    reports = Evaluator(EvalConfig(metrics=["object_f1"])).reports(samples, sample_id="id").cache()
    total = R.batch(reports).first()
    assert (total.samples, total.score, total.perfect_response_rate, total.parse_error_rate) == (3, pytest.approx(0.875), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert {(r.sample_id, r.path) for r in R.failed_fields(reports).collect()} == {("s2", "$"), ("s2", "total")}
    spread = {r.path: r for r in R.field_breakdown(reports).collect()}
    assert spread["total"].mean == 0.5 and spread["total"].fail_rate == 0.5 and spread["total"].p95 == pytest.approx(0.95)
    by = {r.path: r for r in R.consistency_fields(reports).collect()}
    assert by["total"].variance == 0.25 and not by["total"].stable and by["id"].stable
    other = Evaluator(EvalConfig(metrics=["object_f1"], fields={"total": FieldConfig(metrics=["presence"])})).reports(samples, sample_id="id")
    assert {(r.sample_id, r.path): r.delta for r in R.diff_fields(other, reports).collect() if r.delta} == {("s2", "$"): pytest.approx(0.25), ("s2", "total"): 1.0}
    assert {(r.sample_id, r.metric): r.delta for r in R.diff_metrics(other, reports, ["object_f1"]).collect()}["s2", "object_f1"] == pytest.approx(0.25)
    assert {r.sample_id: r.success for r in R.verdicts(reports).collect()} == {"s1": True, "s2": False, "s3": False}
    with pytest.raises(AssertionError):
        R.assert_no_parse_errors(reports)
    with pytest.raises(AssertionError):
        R.assert_score(reports, 0.9)
    with pytest.raises(AssertionError):
        R.assert_field(reports.filter("NOT parse_error"), "total")
    good = reports.filter("sample_id = 's1'")
    R.assert_no_parse_errors(good), R.assert_score(good, 1.0), R.assert_field(good, "total"), R.assert_metric(good, "object_f1", 1.0)
    for kind in ("parquet", "json"):
        write_reports(reports, str(tmp_path / kind), kind)
        assert sorted(map(str, read_reports(spark, str(tmp_path / kind), kind).select("sample_id", "score", "nodes.path").collect())) == sorted(map(str, reports.select("sample_id", "score", "nodes.path").collect()))
    assert "PASS" in reporting.report(evaluate(INVOICE, INVOICE)) and "total" in reporting.batch(reports) and "unstable: total" in reporting.consistency(reports)


def test_source_and_extras(samples):
    config = EvalConfig(metrics=["field_faithfulness", M.RulePassRate([Rule("$.total").gte(100)]), M.SchemaValidity({"required": ["id"], "properties": {"total": {"maximum": 60}}})], key_metric="rule_pass_rate")
    reports = tree.evaluate(samples.filter("id <> 's3'"), config, expected=None, source="source", sample_id="id")
    rows = {r.sample_id: r for r in reports.collect()}
    assert rows["s1"].score == 1 and rows["s2"].score == 0
    assert {r.sample_id for r in R.extras(reports, "rule_pass_rate", "rule_results").collect()} == {"s1", "s2"}
    R.assert_schema_valid(reports.filter("sample_id = 's2'"))
    with pytest.raises(AssertionError):
        R.assert_schema_valid(reports)
    with pytest.raises(ValueError, match="source"):
        evaluate(INVOICE, None, EvalConfig(metrics=["field_faithfulness"]))


def test_compiled_and_tree_plans_agree(spark):
    kind = "struct<id: string, total: double, tags: array<string>, items: array<struct<sku: string, n: double>>, at: struct<city: string>>"
    pairs = [
        ({"id": "a", "total": 1.0, "tags": ["x", "y"], "items": [{"sku": "p", "n": 1.0}, {"sku": "q", "n": 2.0}], "at": {"city": "R"}}, {"id": "A", "total": 1.005, "tags": ["y"], "items": [{"sku": "q", "n": 4.0}, {"sku": "r", "n": 1.0}], "at": {"city": "R"}}),
        ({"id": None, "total": None, "tags": [], "items": [], "at": {"city": None}}, {"id": "b", "total": 0.0, "tags": [], "items": [{"sku": "q", "n": 4.0}], "at": {"city": "S"}}),
    ]
    text = spark.createDataFrame([(str(i), json.dumps(a), json.dumps(e)) for i, (a, e) in enumerate(pairs)], "id string, ta string, te string")
    df = text.selectExpr("id", f"from_json(ta, '{kind}') actual", f"from_json(te, '{kind}') expected", "ta", "te")
    config = EvalConfig(metrics=["overall_leaf_score"], fields={"total": FieldConfig(metrics=["numeric"], weight=2.0), "id": FieldConfig(metrics=["regex_match"]), "items": ArrayFieldConfig(strategy="by_key", params={"key": "sku"}, metrics=["array_f1"]), "tags": ArrayFieldConfig(metrics=["array_jaccard_similarity"])})

    def flat(reports):
        return {(r.sample_id, r.path): (r.kind, round(r.score, 9), {k: round(v, 9) for k, v in r.metrics.items()}) for r in R.nodes(reports).collect()}

    assert flat(typed.evaluate(df, config, sample_id="id")) == flat(tree.evaluate(df, config, "ta", "te", sample_id="id"))


def test_hosts():
    class Case:
        actual_output, expected_output = '{"a": 1}', '{"a": 2}'

    m = integrations.StructuredMetric()
    assert m.measure(Case()) == 0 and not m.is_successful() and "a=0.00" in m.reason

    class Run:
        outputs = {"output": {"a": 1}}

    assert integrations.StructuredEvaluator()(Run(), Run())["score"] == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n')
    rows = read_jsonl(spark, str(tmp_path / "x.jsonl")).selectExpr("line", "document IS NULL AS bad", "document_error IS NOT NULL AS error").collect()
    assert sorted(map(tuple, rows)) == [("bad", True, True), ('{"a": 1}', False, False)]
    df = spark.createDataFrame([(1, '{"a": 1}\n\n[2]')], "id int, text string")
    assert [r.line_number for r in samples_from_text(df, "text").orderBy("line_number").collect()] == [1, 3]
