"""Equality of web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.compare import absent_rule, flag
from fieldloom.functions.strings import strip


def _decoded(x: Column, plus: bool = False) -> Column:
    """Percent signs decoded; a plus means a space only in queries."""
    return F.coalesce(F.try_url_decode(x if plus else F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def normal_url(x: Column, ignore_query: bool = False, ignore_fragment: bool = True, ignore_www: bool = True) -> Column:
    """A canonical form; null for what has no scheme and host or a port that isn't one."""
    x = strip(x)

    whole = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
    scheme, authority, path, query, fragment = (F.regexp_extract(x, whole, k) for k in range(1, 6))
    server = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    host = F.regexp_replace(host, r"^www\.", "") if ignore_www else host
    number = port.try_cast("int")
    valid = (scheme != "") & (host != "") & ((port == "") | (port.rlike(r"^\d+$") & (number <= 65535)))
    path = F.regexp_replace(_decoded(path), "/$", "")
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.concat(_decoded(F.regexp_extract(p, r"^([^=]*)", 1), True), F.lit("="), _decoded(F.regexp_extract(p, r"^[^=]*=?([\s\S]*)$", 1), True)))
    parts = [F.lower(scheme), F.concat(host, F.when(number.isNotNull(), F.concat(F.lit(":"), number.cast("string"))).otherwise("")), path]
    parts.append(F.lit("") if ignore_query else F.array_join(F.array_sort(pairs), "&"))
    parts.append(F.lit("") if ignore_fragment else _decoded(F.substring(fragment, 2, 1 << 30)))
    return F.when(valid, F.concat_ws("\u0000", *parts))


def url_match(a: Column, e: Column, ignore_query: bool = False, ignore_fragment: bool = True, ignore_www: bool = True) -> Column:
    options = {"ignore_query": ignore_query, "ignore_fragment": ignore_fragment, "ignore_www": ignore_www}
    return absent_rule(a, e, flag(normal_url(a, **options) == normal_url(e, **options)))
