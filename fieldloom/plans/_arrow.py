"""Arrow columns to Python values and back, a column at a time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain
from typing import Any

import pyarrow as pa
import pyarrow.types as kinds


def values(x: pa.Array) -> list:
    """``x.to_pylist()`` of nested columns too, without a scalar for each value."""
    t = x.type
    if kinds.is_struct(t) and t.num_fields and len({f.name for f in t}) == t.num_fields:
        names = [f.name for f in t]
        rows = [dict(zip(names, row)) for row in zip(*map(values, x.flatten()))]
    elif kinds.is_list(t) or kinds.is_large_list(t):
        at = x.offsets.to_numpy().tolist()
        items = values(x.values.slice(at[0], at[-1] - at[0]))
        rows = [items[i - at[0] : j - at[0]] for i, j in zip(at, at[1:])]
    elif kinds.is_string(t) or kinds.is_large_string(t) or not x.null_count and (kinds.is_integer(t) or kinds.is_float32(t) or kinds.is_float64(t) or kinds.is_boolean(t)):
        return x.to_numpy(zero_copy_only=False).tolist()
    else:
        return x.to_pylist()
    if x.null_count:
        rows = [row if there else None for row, there in zip(rows, x.is_valid().to_numpy(zero_copy_only=False).tolist())]
    return rows


def ends(sizes: Sequence[int]) -> pa.Array:
    """The offsets of lists of these sizes."""
    out, total = [0], 0
    for n in sizes:
        total += n
        out.append(total)
    return pa.array(out, pa.int32())


def maps(found: Sequence[dict], t: pa.MapType) -> pa.Array:
    """Dicts as a map column."""
    keys = pa.array(list(chain.from_iterable(found)), t.key_type)
    return pa.MapArray.from_arrays(ends([len(x) for x in found]), keys, pa.array([v for x in found for v in x.values()], t.item_type)).cast(t)


def structs(sizes: Sequence[int], columns: Sequence[Any], t: pa.ListType) -> pa.Array:
    """Lists of structs from the structs' columns, each a list of values, an array, or None for nulls."""
    own = t.value_type
    n = sum(sizes)
    filled = [x if isinstance(x, pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for x, f in zip(columns, own)]
    return pa.ListArray.from_arrays(ends(sizes), pa.StructArray.from_arrays(filled, fields=list(own)), type=t)
