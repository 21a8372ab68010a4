"""Nested values as JSON: deep overlays of settings, and keys that don't hang on the order in which fields were written."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaid(base, over):
    """`over` on top of `base`: objects are merged field by field at any depth, a null field goes, anything else replaces."""
    if not isinstance(over, dict):
        return over
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in over.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = overlaid(out.get(k), v)
    return out


def canonical(value) -> str:
    """JSON with fields in order at every depth and nothing between; numbers as they were read."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read(text: str | None):
    """The value of a JSON text; None for null or broken ones."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def _merged(base: pa.Array, over: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(base.to_pylist(), over.to_pylist(), strict=True):
        a, b = read(a), read(b)
        found = a if b is None else overlaid(a, b)
        out.append(None if found is None else canonical(found))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _ordered(texts: pa.Array) -> pa.Array:
    found = [read(t) for t in texts.to_pylist()]
    return pa.array([None if v is None else canonical(v) for v in found], pa.string())


@F.arrow_udf(T.StringType())
def _key(texts: pa.Array) -> pa.Array:
    found = [read(t) for t in texts.to_pylist()]
    return pa.array([None if v is None else hashlib.sha256(canonical(v).encode()).hexdigest() for v in found], pa.string())


def merged_json(base: Column, over: Column) -> Column:
    """`over` deep on top of `base`, both JSON, as canonical JSON. Null or broken ones count as nothing; null if both are. Not for use within a lambda."""
    return _merged(base, over)


def canonical_json(text: Column) -> Column:
    """JSON with its fields in order at every depth; null for null or broken ones."""
    return _ordered(text)


def canonical_key(text: Column) -> Column:
    """SHA-256 of `canonical_json`, so equal values have equal keys whatever the order of their fields."""
    return _key(text)
