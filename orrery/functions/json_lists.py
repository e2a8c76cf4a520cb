"""Picking, filtering and mapping of lists, and JSONPath over JSON texts, in built-in expressions.

Callers give predicates and mappers as functions from Column to Column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(values: Column, n: int) -> Column:
    """Element n from 0; null beyond the end."""
    return F.get(values, F.lit(n))


def kept(values: Column, predicate: Callable[[Column], Column]) -> Column:
    """Elements for which the predicate holds; an unknown outcome drops."""
    return F.filter(values, lambda x: F.coalesce(predicate(x), F.lit(False)))


def mapped(values: Column, mapper: Callable[[Column], Column]) -> Column:
    """What a mapper makes of the elements, nulls dropped."""
    return F.filter(F.transform(values, mapper), lambda x: x.isNotNull())


def matching(values: Column, fields: dict) -> Column:
    """Structs whose fields all equal the given scalars; a missing field equals null."""
    holds = lambda x: [x[name].eqNullSafe(F.lit(value)) for name, value in fields.items()]

    def every(x: Column) -> Column:
        out = F.lit(True)
        for h in holds(x):
            out = out & h
        return out

    return F.filter(values, every)


def json_path(body: Column, path: str) -> Column:
    """What ``$.a.b[0]`` or ``$.a[*].b`` finds, always as a list in JSON text; an unreadable body comes back unchanged.

    Wildcards over lists may stand anywhere and nest. Deep search is ``json_walk.json_get`` with ``..name``.
    """

    def at(step: str) -> Callable[[Column], Column]:
        return lambda v: F.try_variant_get(v, "$" + step, "variant")

    document = F.try_parse_json(body)
    found = F.array(document)
    steps = path.removeprefix("$").split("[*]")
    for i, step in enumerate(steps):
        if step:
            found = mapped(found, at(step))
        if i + 1 < len(steps):
            found = F.flatten(mapped(found, lambda v: F.try_variant_get(v, "$", "array<variant>")))
    text = F.concat(F.lit("["), F.array_join(F.transform(found, lambda v: F.to_json(v)), ","), F.lit("]"))
    return F.when(document.isNull(), body).otherwise(text)
