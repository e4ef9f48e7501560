"""Texts to documents: JSON first, YAML where that fails."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ParseError(ValueError):
    pass


class Parser(Protocol):
    """Anything that makes a document of a text or raises ParseError."""

    def parse(self, text: str) -> Any: ...


_scan = json.JSONDecoder().scan_once


def from_json(text: str) -> Any:
    try:
        found, end = _scan(text, 0)
        if end == len(text):
            return found
    except (StopIteration, ValueError, RecursionError):
        pass  # what surrounds a document, and what is wrong with it, is for the whole decoder
    try:
        return json.loads(text)
    except ValueError as why:
        raise ParseError(f"Invalid JSON: {why}") from None


def from_yaml(text: str) -> Any:
    import yaml

    def named(x: Any) -> Any:
        """Keys as texts, as in JSON."""
        if isinstance(x, dict):
            return {k if isinstance(k, str) else "null" if k is None else str(k).lower() if isinstance(k, bool) else str(k): named(v) for k, v in x.items()}
        return [named(v) for v in x] if isinstance(x, list) else x

    try:
        return named(yaml.safe_load(text))
    except (yaml.YAMLError, ValueError, RecursionError) as why:
        raise ParseError(f"Invalid YAML: {why}") from None


_more: list[Callable[[str], Any]] = []


def register_parser(parser: Parser) -> None:
    """Tried after JSON and YAML, in this Python process."""
    _more.append(parser.parse)


def parse(text: str) -> Any:
    """The document in a text. Of YAML only objects and arrays count; the error reported is JSON's."""
    try:
        return from_json(text)
    except ParseError as why:
        first = why
    try:
        found = from_yaml(text)
        if isinstance(found, (dict, list)):
            return found
    except ParseError:
        pass
    for more in _more:
        try:
            return more(text)
        except ParseError:
            pass
    raise first


def lines(text: str) -> list[Any]:
    """The documents of JSON lines; blank ones are skipped and a bad one is named by its number."""
    out = []
    for k, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                out.append(from_json(line.strip()))
            except ParseError as why:
                raise ParseError(f"line {k}: {why}") from None
    return out


def parsed(df: DataFrame, text: str, out: str = "document") -> DataFrame:
    """``df`` with the text as a variant in ``out`` and, where it is none, the reason in ``<out>_error``.

    Spark parses the JSON; only texts it can't read go to Python, where they may be YAML.
    """

    @F.pandas_udf("json string, error string")
    def rest(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple[str | None, str | None]] = []
        for t in texts:
            try:
                rows.append((None, None) if t is None else (json.dumps(parse(t), default=str), None))
            except ParseError as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["json", "error"])

    first = F.try_parse_json(F.col(text))
    tried = df.withColumn("__first", first)
    tried = tried.withColumn("__rest", F.when(F.col("__first").isNull() & F.col(text).isNotNull(), rest(F.when(F.col("__first").isNull(), F.col(text)))))
    return tried.withColumns({out: F.coalesce("__first", F.try_parse_json(F.col("__rest.json"))), f"{out}_error": F.col("__rest.error")}).drop("__first", "__rest")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, document, document_error) of the non-blank lines of a file or folder."""
    text = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "line")
    document = F.try_parse_json(F.trim("line"))
    return text.select("line", document.alias("document"), F.when(document.isNull(), F.concat(F.lit("Invalid JSON: "), F.substring("line", 1, 80))).alias("document_error"))


def samples_from_text(df: DataFrame, text: str) -> DataFrame:
    """One row for each non-blank line of a column of JSON lines, with its number from 1."""
    split = df.select("*", F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("__at", "line")).filter(F.trim("line") != "")
    return split.withColumn("line_number", F.col("__at") + 1).withColumn("document", F.try_parse_json(F.trim("line"))).drop("__at")


def json_of(x: Column) -> Column:
    """JSON in which nulls stay."""
    return F.to_json(x, {"ignoreNullFields": "false"})

