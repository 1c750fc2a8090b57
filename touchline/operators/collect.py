"""Ordered lists and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(value: Column, keys: list[tuple[Column, bool]], where: Column | None = None) -> Column:
    """Aggregate: the values of a group in the order of (key, descending) pairs, nulls kept.

    Keys become parts of a struct that sorts upwards; descending ones must be numbers, which are
    negated. Nulls sort last going up and first going down.
    """
    parts = []
    for i, (key, down) in enumerate(keys):
        if down:
            parts += [key.isNotNull().alias(f"n{i}"), (-key).alias(f"k{i}")]
        else:
            parts += [key.isNull().alias(f"n{i}"), key.alias(f"k{i}")]
    item = F.struct(*parts, value.alias("v"))
    listed = F.collect_list(F.when(where, item) if where is not None else item)
    # the value takes no part in the order: structs of equal keys may compare by it, which only settles ties
    return F.transform(F.sort_array(listed), lambda x: x.v)


def payload(**fields: Column) -> Column:
    """A struct with named fields in the order given; JSON only at the sink, by ``as_json``."""
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def as_json(value: Column) -> Column:
    """Compact JSON text with null fields written; null of null."""
    return F.to_json(value, {"ignoreNullFields": "false"})
