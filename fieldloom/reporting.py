"""Reports as text. What is shown is collected, so its size is that of a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import reports as R

WIDE = 60


def number(x: float | None) -> str:
    return "—" if x is None else f"{x:.4f}"


def table(names: list[str], rows: list[list]) -> str:
    cells = [names] + [[number(v) if isinstance(v, float) or v is None else str(v) for v in r] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def grid(values: dict[str, float | None]) -> str:
    """Two to a line."""
    items = [f"{k}: {number(v)}".ljust(WIDE // 2) for k, v in values.items()]
    return "\n".join("".join(items[i : i + 2]).rstrip() for i in range(0, len(items), 2))


def _page(title: str, *parts: str) -> str:
    return "\n".join(["=" * WIDE, title.center(WIDE).rstrip(), "=" * WIDE, *(p for p in parts if p)])


def report(row: dict) -> str:
    """One report, as of ``fieldloom.evaluate``."""
    if row["parse_error"]:
        return _page("EVALUATION", f"parse error: {row['parse_error_message']}")
    nodes = row["nodes"]
    verdict = "PASS" if row["score"] >= 1 else "FAIL"
    top = dict(nodes[0]["metrics"])
    return _page("EVALUATION", f"score: {number(row['score'])}  {verdict}", grid(top), table(["path", "kind", "score", "threshold"], [[n["path"], n["kind"], n["score"], n["threshold"]] for n in nodes]))


def batch(reports: DataFrame) -> str:
    """Rates, metrics, and fields by share of failures."""
    total = R.batch(reports).first().asDict()
    metrics = {r["metric"]: r["value"] for r in R.batch_metrics(reports).orderBy("metric").collect()}
    fields = R.field_breakdown(reports).orderBy(F.desc("fail_rate"), "path").collect()
    rates = {k: total[k] for k in ("score", "perfect_response_rate", "parse_error_rate")}
    return _page("BATCH", f"samples: {total['samples']}", grid(rates), grid(metrics), table(["path", "mean", "min", "max", "p95", "fail_rate"], [[f[k] for k in ("path", "mean", "min", "max", "p95", "fail_rate")] for f in fields]))


def consistency(reports: DataFrame, variance_threshold: float = 0.05) -> str:
    fields = R.consistency_fields(reports, None, variance_threshold).orderBy(F.desc("variance"), "path").collect()
    total = R.consistency(reports).first().asDict()
    kinds = {True: [f.path for f in fields if f.stable], False: [f.path for f in fields if not f.stable]}
    return _page("CONSISTENCY", grid({"mean_score": total["mean_score"], "score_variance": total["score_variance"]}), f"stable: {', '.join(kinds[True]) or '—'}", f"unstable: {', '.join(kinds[False]) or '—'}", table(["path", "variance"], [[f.path, f.variance] for f in fields]))
