"""What is asked of report rows (``fieldloom.plans.tree.SCHEMA``): plain aggregations and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The fields of nodes that ``batch`` reads.
BATCH_FIELDS = ("score", "threshold")


def nodes(reports: DataFrame) -> DataFrame:
    """One row for each node, in the order of the tree."""
    # outer, since Spark would else compute the array a second time to filter out empty ones
    return reports.select("sample_id", F.posexplode_outer("nodes").alias("place", "node")).filter("place IS NOT NULL").select("sample_id", "place", "node.*")


def values(reports: DataFrame) -> DataFrame:
    """(sample_id, metric, path, value, extra): the metrics of all nodes in long form."""
    return nodes(reports).select("sample_id", "path", "extras", F.explode("metrics").alias("metric", "value")).select("sample_id", "metric", "path", "value", F.try_element_at("extras", F.col("metric")).alias("extra"))


def collections(reports: DataFrame) -> DataFrame:
    """For each sample and metric: mean, least and highest value, the root's value and the representative one."""
    at_root = F.max(F.when(F.col("path") == "$", F.col("value")))
    return values(reports).groupBy("sample_id", "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), at_root.alias("root"), F.coalesce(at_root, F.avg("value")).alias("representative"))


def extras(reports: DataFrame, metric: str, key: str | Sequence[str] | None = None) -> DataFrame:
    """The extra payloads of a metric; with a key, one row for each item of the list there; with several, each item's key too."""
    own = F.filter("nodes", lambda n: F.map_contains_key(n["metrics"], F.lit(metric)) & F.try_element_at(n["extras"], F.lit(metric)).isNotNull())
    found = reports.select("sample_id", F.explode_outer(own).alias("node")).filter("node IS NOT NULL").select("sample_id", "node.path", F.element_at("node.extras", F.lit(metric)).alias("extra"))
    if key is None:
        return found
    keys = [key] if isinstance(key, str) else list(key)
    none = F.array().cast("array<struct<key: string, item: string>>")
    items = lambda k: F.transform(F.from_json(F.get_json_object("extra", f"$.{k}"), "array<string>"), lambda x: F.struct(F.lit(k).alias("key"), x.alias("item")))
    every = found.select("sample_id", "path", F.explode_outer(F.concat(none, *(F.coalesce(items(k), none) for k in keys))).alias("x")).filter("x IS NOT NULL")
    return every.select("sample_id", "path", *([] if isinstance(key, str) else ["x.key"]), "x.item")


def _bar(threshold: float | None) -> Column:
    return F.lit(threshold) if threshold is not None else F.coalesce("threshold", F.lit(1.0))


def failed_fields(reports: DataFrame, threshold: float | None = None) -> DataFrame:
    """Nodes whose score is below the threshold, else below their own."""
    return nodes(reports).filter(F.col("score") < _bar(threshold))


def warnings(reports: DataFrame) -> DataFrame:
    return _listed(reports, "warnings").select("sample_id", "x.kind", "x.path")


def matches(reports: DataFrame) -> DataFrame:
    return _listed(reports, "matches").select("sample_id", "x.*")


def _listed(reports: DataFrame, name: str) -> DataFrame:
    return reports.select("sample_id", F.explode_outer(name).alias("x")).filter("x IS NOT NULL")  # outer as in nodes


def batch(reports: DataFrame) -> DataFrame:
    """One row: samples, mean score, label, share of perfect responses (of all samples) and of parse errors."""
    perfect = ~F.col("parse_error") & ~F.exists("nodes", lambda n: F.coalesce(n["score"] < F.coalesce(n["threshold"], F.lit(1.0)), F.lit(False)))
    share = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return reports.agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.when(~F.col("parse_error"), F.col("score"))).alias("score"), F.min("score_label").alias("score_label"),
        share(perfect).alias("perfect_response_rate"), share(F.col("parse_error")).alias("parse_error_rate"),
    )


def batch_metrics(reports: DataFrame) -> DataFrame:
    """(metric, value): the mean over the samples that have it of each sample's representative value."""
    return collections(reports.filter("NOT parse_error")).groupBy("metric").agg(F.avg("representative").alias("value"))


def field_breakdown(reports: DataFrame, threshold: float | None = None) -> DataFrame:
    """For each path: mean, least, highest, 95th percentile and share of failures."""
    return nodes(reports).filter("score IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.percentile("score", F.lit(0.95)).alias("p95"), F.avg((F.col("score") < _bar(threshold)).cast("double")).alias("fail_rate"))


def consistency_fields(reports: DataFrame, group: str | None = None, variance_threshold: float = 0.05) -> DataFrame:
    """For each scalar path (of each group of runs): the variance of its score over the runs that have it."""
    keys = [group] if group else []
    flat = reports.filter("NOT parse_error").select(*keys, F.explode_outer("nodes").alias("n")).filter("n.kind = 'scalar' AND n.score IS NOT NULL")
    out = flat.groupBy(*keys, F.col("n.path").alias("path")).agg(F.count(F.lit(1)).alias("runs"), F.var_pop("n.score").alias("variance"))
    return out.withColumn("stable", F.col("variance") <= variance_threshold)


def consistency(reports: DataFrame, group: str | None = None) -> DataFrame:
    """For each group of runs (or all): mean and variance of the root scores."""
    # covar_pop takes the steps of DuckDB's var_pop and ends with the same bits where rows come in the same order; Spark's var_pop takes others
    return reports.filter("NOT parse_error").groupBy(*([group] if group else [])).agg(F.count("score").alias("runs"), F.avg("score").alias("mean_score"), F.covar_pop("score", "score").alias("score_variance"))


def diff_metrics(reports: DataFrame, other: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(sample_id, metric, delta): representative values less those of ``other``, for metrics in both."""
    a, b = (collections(x).select("sample_id", "metric", F.col("representative").alias(n)) for x, n in ((reports, "a"), (other, "b")))
    out = a.join(b, ["sample_id", "metric"]).select("sample_id", "metric", (F.col("a") - F.col("b")).alias("delta"))
    return out.filter(F.col("metric").isin(metrics)) if metrics else out


def diff_fields(reports: DataFrame, other: DataFrame) -> DataFrame:
    """(sample_id, path, delta): scores less those of ``other``, for paths in both."""
    a, b = (nodes(x).select("sample_id", "path", F.col("score").alias(n)) for x, n in ((reports, "a"), (other, "b")))
    return a.join(b, ["sample_id", "path"]).select("sample_id", "path", (F.col("a") - F.col("b")).alias("delta"))


def diff_values(reports: DataFrame, other: DataFrame) -> DataFrame:
    """(sample_id, path, metric, delta) for the metrics of nodes in both."""
    a, b = (values(x).select("sample_id", "path", "metric", F.col("value").alias(n)) for x, n in ((reports, "a"), (other, "b")))
    return a.join(b, ["sample_id", "path", "metric"]).select("sample_id", "path", "metric", (F.col("a") - F.col("b")).alias("delta"))


def verdicts(reports: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(sample_id, score, success, reason): the reason names at most five failed fields."""
    bad = F.filter("nodes", lambda n: n["score"] < F.coalesce(n["threshold"], F.lit(1.0)))
    named = F.array_join(F.transform(F.slice(bad, 1, 5), lambda n: F.concat(n["path"], F.lit("="), F.format_number(n["score"], 2))), ", ")
    reason = F.when(F.col("parse_error"), F.concat(F.lit("parse error: "), F.coalesce("parse_error_message", F.lit("")))).when(F.size(bad) == 0, "all fields pass").otherwise(F.concat(F.lit("failed: "), named))
    score = F.coalesce("score", F.lit(0.0))
    return reports.select("sample_id", score.alias("score"), (~F.col("parse_error") & (score >= threshold)).alias("success"), reason.alias("reason"))


def _none(found: DataFrame, what: str) -> None:
    if rows := found.limit(5).collect():
        raise AssertionError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def assert_no_parse_errors(reports: DataFrame) -> None:
    _none(reports.filter("parse_error").select("sample_id", "parse_error_message"), "texts that can't be parsed")


def assert_score(reports: DataFrame, least: float) -> None:
    _none(reports.filter(F.coalesce("score", F.lit(-1.0)) < least).select("sample_id", "score"), f"scores below {least}")


def assert_field(reports: DataFrame, path: str, least: float = 1.0) -> None:
    own = F.filter("nodes", lambda n: n["path"] == path)
    _none(reports.filter((F.size(own) == 0) | F.exists(own, lambda n: n["score"] < least)).select("sample_id"), f"{path} is absent or below {least}")


def assert_metric(reports: DataFrame, metric: str, least: float) -> None:
    found = reports.select("sample_id").join(collections(reports).filter(F.col("metric") == metric), "sample_id", "left")
    _none(found.filter(F.coalesce("representative", F.lit(-1.0)) < least).select("sample_id", "representative"), f"{metric} is absent or below {least}")


def assert_schema_valid(reports: DataFrame, metric: str = "schema_validity") -> None:
    _none(values(reports).filter((F.col("metric") == metric) & (F.col("value") < 1)).select("sample_id", "extra"), "documents that break their schema")
