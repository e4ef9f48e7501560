"""Structured-output evaluation on Spark DataFrames."""

from fieldloom.api import EvalReport, Evaluator, Sample, evaluate, evaluate_batch, evaluate_consistency, structured_diff
from fieldloom.config import ArrayFieldConfig, ArrayStrategy, EvalConfig, ExtraKeysPolicy, FieldConfig, GradingMode, ObjectFieldConfig, WeightMode
from fieldloom.rules import Rule

__all__ = [
    "ArrayFieldConfig", "ArrayStrategy", "EvalConfig", "EvalReport", "Evaluator", "ExtraKeysPolicy", "FieldConfig", "GradingMode", "ObjectFieldConfig", "Rule", "Sample",
    "WeightMode", "evaluate", "evaluate_batch", "evaluate_consistency", "structured_diff",
]
