"""Documents in, reports out."""

from fieldloom.sources.documents import ParseError, parse, parsed, read_jsonl, register_parser, samples_from_text
from fieldloom.sources.reports import read_reports, write_reports

__all__ = ["ParseError", "parse", "parsed", "read_jsonl", "read_reports", "register_parser", "samples_from_text", "write_reports"]
