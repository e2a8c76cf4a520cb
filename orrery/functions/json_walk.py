"""Walks over JSON texts of unknown shape, as vectorized functions: parse once, apply all.

Spark has no recursive descent over JSON; everything else in the library is built-in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = re.compile(r"(\.\.|\.|^)([^.\[\]]+)|\[(\d+)\]")


def parse(text: str | None):
    """(ok, value): unreadable text and null are no document."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def compile_path(path: str) -> list[tuple]:
    """Steps (kind, argument): ``a.b`` navigates, ``..a`` searches at any depth, ``[n]`` picks."""
    return [("pick", int(n)) if n else ("deep" if dots == ".." else "get", name) for dots, name, n in STEP.findall(path)]


def _flat(values: Iterator) -> list:
    out = []
    for v in values:
        if isinstance(v, list):
            out += _flat(v)
        elif v is not None:
            out.append(v)
    return out


def _search(node, name: str) -> list:
    """All values of a key at any depth in document order, an object's own first; found values are not searched."""
    if isinstance(node, list):
        return [x for v in node for x in _search(v, name)]
    if not isinstance(node, dict):
        return []
    own = [node[name]] if name in node else []
    return own + [x for k, v in node.items() if k != name for x in _search(v, name)]


def walk(value, steps: list[tuple]):
    """The value that a path leads to; lists met on the way are mapped over and flattened, nothing found is None."""
    for kind, arg in steps:
        if value is None:
            return None
        if kind == "pick":
            value = value[arg] if isinstance(value, list) and arg < len(value) else None
        elif kind == "deep":
            value = _flat(_search(value, arg)) or None
        elif isinstance(value, list):
            value = _flat(v.get(arg) if isinstance(v, dict) else None for v in _dicts(value)) or None
        else:
            value = value.get(arg) if isinstance(value, dict) else None
            value = (_flat(value) or None) if isinstance(value, list) else value
    return value


def _dicts(values: list) -> Iterator:
    for v in values:
        if isinstance(v, list):
            yield from _dicts(v)
        else:
            yield v


def text_of(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_get(body: Column, path: str) -> Column:
    """JSON text of what ``path`` leads to in a JSON body, null if nothing."""
    steps = compile_path(path)

    @F.pandas_udf("string")
    def get(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: text_of(walk(parse(b)[1], steps)))

    return get(body)


def json_get_each(body: Column, paths: Column) -> Column:
    """Array of JSON texts, one for each of an array of paths; each body is parsed once, each path compiled once a batch."""

    @F.pandas_udf("array<string>")
    def get(bodies: pd.Series, wanted: pd.Series) -> pd.Series:
        known: dict[str, list] = {}
        out = []
        for b, ps in zip(bodies, wanted, strict=True):
            value = parse(b)[1]
            for p in ps:
                if p not in known:
                    known[p] = compile_path(p)
            out.append([text_of(walk(value, known[p])) for p in ps])
        return pd.Series(out)

    return get(body, paths)


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def flattened(body: Column) -> Column:
    """Map of leaf paths (``a.b[0].c``) to values as text; null stays null, text is unquoted."""

    @F.pandas_udf("map<string,string>")
    def run(bodies: pd.Series) -> pd.Series:
        def one(b):
            ok, value = parse(b)
            return {p: v if isinstance(v, str) else text_of(v) for p, v in leaves(value)} if ok else None

        return bodies.map(one)

    return run(body)


def key_paths(value, prefix: str = "") -> Iterator[str]:
    """Every key path, arrays probed at their first element."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{prefix}.{k}" if prefix else k
            yield path
            yield from key_paths(v, path)
    elif isinstance(value, list) and value:
        yield from key_paths(value[0], f"{prefix}[]")


def field(body: Column, name: str) -> Column:
    """JSON text of one field of bodies that are objects, as ``json_get`` gives it, without leaving the JVM."""
    # several fields of a body share its map; a path that isn't there would cost an exception a row
    found = F.try_variant_get(F.try_parse_json(body), "$", "map<string, variant>")
    return F.nullif(F.to_json(found[name]), F.lit("null"))


def overridden(environments: DataFrame, key: str) -> DataFrame:
    """(key, name, value): leaf paths of ``base`` and of ``sub`` (JSON texts of each row), those of ``sub`` win."""
    both = environments.select(key, F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("base").alias("j")), F.struct(F.lit(1).alias("p"), F.col("sub").alias("j")))).alias("e"))
    leaves = both.select(key, "e.p", flattened(F.col("e.j")).alias("m")).select(key, "p", F.explode("m").alias("name", "value"))
    return leaves.groupBy(key, "name").agg(F.max_by("value", "p").alias("value"))


def structure_keys(body: Column) -> Column:
    """Key paths of a JSON body, null if it is unreadable."""

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(parse).map(lambda p: list(key_paths(p[1])) if p[0] else None)

    return run(body)
