"""Nested documents as path/value relations.

Two ways to the same relation, both one narrow pass: documents with a known schema are
unrolled by one expression, documents without one are walked on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_parts

_NODE_FIELDS = ("path", "value", "is_key", "is_text", "addressable")
_NODE_COLUMNS = "path string, value string, is_key boolean, is_text boolean, addressable boolean"
NODE_TYPE = f"array<struct<{_NODE_COLUMNS.replace(' string', ':string').replace(' boolean', ':boolean')}>>"

# A key that a path string cannot address: empty, all digits, with a dot or an index.
ODD_KEY = re.compile(r"^$|^\d+$|\.|\[\d+\]")


def clean_names(dtype: T.DataType) -> bool:
    """True when every key is a fixed, addressable name, so that paths are unique."""
    if isinstance(dtype, T.StructType):
        return all(not ODD_KEY.search(f.name) and clean_names(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return clean_names(dtype.elementType)
    return not isinstance(dtype, T.MapType)


@dataclass(frozen=True)
class _Place:
    """Where a value sits.

    ``parts`` are the pieces of its path as SQL expressions, literals merged;
    ``checks`` are conditions under which the path leads back to the value.
    """

    parts: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    is_key: bool = False

    @property
    def path(self) -> str:
        return f"concat({', '.join(self.parts)})" if len(self.parts) > 1 else "".join(self.parts) or "''"

    @property
    def addressable(self) -> str:
        return " and ".join(self.checks) or "true"

    def _under(self) -> tuple[str, ...]:
        """Pieces in front of a key; without a dot as long as the path is empty."""
        if not self.parts:
            return ()
        if any(p.startswith("'") and p != "''" for p in self.parts):
            return _joined(self.parts, "'.'")
        return (f"case when {self.path} = '' then '' else concat({self.path}, '.') end",)

    def field(self, name: str) -> _Place:
        checks = self.checks + (("false",) if ODD_KEY.search(name) else ())
        return _Place(_joined(self._under(), _text(name)), checks, is_key=True)

    def entry(self, key: str) -> _Place:
        odd = f"not rlike({key}, {_text(ODD_KEY.pattern)})"
        return _Place((*self._under(), key), (*self.checks, odd), is_key=True)

    def item(self, index: str) -> _Place:
        return _Place((*_joined(self.parts, "'['"), index, "']'"), self.checks)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _joined(parts: tuple[str, ...], literal: str) -> tuple[str, ...]:
    if parts and parts[-1].startswith("'"):
        return (*parts[:-1], parts[-1][:-1] + literal[1:])
    return (*parts, literal)


_NOTHING = f"cast(array() as {NODE_TYPE})"


def _node(e: str, dtype: T.DataType, at: _Place) -> str:
    text = isinstance(dtype, T.StringType)
    return (
        f"named_struct('path', {at.path}, 'value', {e if text else 'cast(null as string)'}, 'is_key', {str(at.is_key).lower()},"
        f" 'is_text', {f'{e} is not null' if text else 'false'}, 'addressable', {at.addressable})"
    )


def _collected(items: list[tuple[bool, str]]) -> str:
    """One array of ``(is it a single node?, expression)`` items, in order."""
    arrays: list[str] = []
    for single, group in groupby(items, key=lambda item: item[0]):
        found = [expression for _, expression in group]
        arrays += [f"array({', '.join(found)})"] if single else found
    return f"concat({', '.join(arrays)})" if len(arrays) != 1 else arrays[0]


def _walk(e: str, dtype: T.DataType, at: _Place, depth: int = 0) -> list[tuple[bool, str]]:
    """The nodes of a value and of everything below it, as SQL."""
    items: list[tuple[bool, str]] = []
    if at.is_key:
        items.append((True, _node(e, dtype, at)))
    elif isinstance(dtype, T.StringType):
        items.append((False, f"case when {e} is null then {_NOTHING} else array({_node(e, dtype, at)}) end"))
    below = None
    if isinstance(dtype, T.StructType):
        below = [i for f in dtype.fields for i in _walk(f"{e}.`{f.name}`", f.dataType, at.field(f.name), depth)]
    elif isinstance(dtype, T.ArrayType):
        x, i = f"x{depth}", f"i{depth}"
        inner = _walk(x, dtype.elementType, at.item(i), depth + 1)
        below = [(False, f"flatten(transform({e}, ({x}, {i}) -> {_collected(inner)}))")] if inner else None
    elif isinstance(dtype, T.MapType):
        x = f"x{depth}"
        inner = _walk(f"{x}.value", dtype.valueType, at.entry(f"{x}.key"), depth + 1)
        below = [(False, f"flatten(transform(map_entries({e}), {x} -> {_collected(inner)}))")]
    if below:
        items.append((False, f"case when {e} is null then {_NOTHING} else {_collected(below)} end"))
    return items


def node_array(column: str, dtype: T.DataType) -> Column:
    """All nodes of a typed document as one array column.

    A null field keeps its key path, as a JSON null does, and has no leaf.
    """
    items = _walk(f"`{column}`", dtype, _Place())
    return F.expr(_collected(items) if items else _NOTHING)


def _typed_nodes(docs: DataFrame, key: str, column: str, only: str | None) -> DataFrame:
    nodes = node_array(column, docs.schema[column].dataType)
    return docs.select(F.col(key), F.inline(nodes if only is None else F.filter(nodes, lambda node: node[only])))


def _steps(value: Any, path: str, good: bool) -> Iterator[tuple[str, Any, bool, bool]]:
    """Keys and strings below a parsed document as ``(path, value, is_key, addressable)``."""
    if isinstance(value, dict):
        for name, child in value.items():
            at, fine = f"{path}.{name}" if path else name, good and not ODD_KEY.search(name)
            yield at, child, True, fine
            if isinstance(child, (dict, list)):
                yield from _steps(child, at, fine)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            if isinstance(child, str):
                yield f"{path}[{i}]", child, False, good
            else:
                yield from _steps(child, f"{path}[{i}]", good)
    elif isinstance(value, str):
        yield path, value, False, good


def _from(value: Any, path: str, good: bool, is_key: bool) -> Iterator[tuple[str, Any, bool, bool]]:
    """The same for a value that sits at ``path``, by a key or not."""
    if is_key:
        yield path, value, True, good
    if not is_key or isinstance(value, (dict, list)):
        yield from _steps(value, path, good)


_CHUNK = 50_000


def _walk_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of JSON texts, and for each text one row without a path that tells whether it could be read."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", *_NODE_FIELDS, "malformed"])

    rows: list[tuple] = []
    for batch in batches:
        for key, text, at, fine, named in zip(*(batch[c] for c in ("key", "doc", "at", "fine", "named")), strict=True):
            try:
                doc = json.loads(text) if text is not None else None
                nodes = [] if text is None else list(_from(doc, at, fine, named))
            except (ValueError, RecursionError):
                nodes, text = [], None
            rows.append((key, None, None, False, False, True, text is None))
            for path, value, is_key, good in nodes:
                is_text = isinstance(value, str)
                rows.append((key, path, value if is_text else None, is_key, is_text, good, False))
                if len(rows) >= _CHUNK:
                    yield frame(rows)
                    rows = []
    if rows:
        yield frame(rows)


def text_nodes(docs: DataFrame, key: str, column: str, within: tuple[str, str, str] | None = None) -> DataFrame:
    """Nodes of documents without a schema, plus a row with no path per document.

    ``within`` names columns for texts that are parts of documents: the path of the part, whether it is
    addressable, and whether it sits at a key.

    One pass without a shuffle, on Arrow batches.  A recursive query could do the same,
    but it keeps every level of every document.  JSON is read as Python reads it: the
    last of several equal keys wins.
    """
    place = [F.lit(""), F.lit(True), F.lit(False)] if within is None else [F.col(c) for c in within]
    named = (c.alias(n) for c, n in zip(place, ("at", "fine", "named"), strict=True))
    keyed = docs.select(F.col(key).alias("key"), F.col(f"`{column}`").cast("string").alias("doc"), *named)
    kind = keyed.schema["key"].dataType.simpleString()
    walked = keyed.mapInPandas(_walk_texts, f"key {kind}, {_NODE_COLUMNS}, malformed boolean")
    return walked.withColumnRenamed("key", key)


def has_schema(docs: DataFrame, column: str) -> bool:
    return not isinstance(docs.schema[column].dataType, (T.StringType, T.VariantType))


def json_nodes(docs: DataFrame, key: str, column: str, only: str | None = None) -> DataFrame:
    """``(key, path, value, is_key, is_text, addressable)``: every key and every string of each document.

    One walk yields both relations.  ``column`` may be a struct, map or array (unrolled
    by its schema), a variant, or JSON text.  ``only`` keeps the nodes with that flag.
    """
    if not has_schema(docs, column):
        nodes = text_nodes(docs, key, column).filter("path is not null").drop("malformed")
        return nodes if only is None else nodes.filter(only)
    return _typed_nodes(docs, key, column, only)


def json_leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """String leaves ``(key, path, value, addressable)``; other scalars are left out."""
    return json_nodes(docs, key, column, "is_text").select(key, "path", "value", "addressable")


def json_key_paths(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct paths of object keys at every depth ``(key, path)``."""
    paths = json_nodes(docs, key, column, "is_key").select(key, "path")
    return paths if has_schema(docs, column) and clean_names(docs.schema[column].dataType) else paths.distinct()


def lookup_path(path: Column, addressable: Column) -> Column:
    """The place a path string leads to: itself, unless an odd key makes it read differently."""
    joined = F.array_join(path_parts(path), ".")
    indexed = F.regexp_replace(F.regexp_replace(joined, r"(?<=^|\.)(\d+)(?=\.|$)", "[$1]"), r"\.\[", "[")
    return F.when(addressable, path).otherwise(indexed)


def _step(part: Column) -> Column:
    """One step of a path in the form that variants take; NULL for a name no form can hold."""
    return (
        F.when(part.rlike(r"^\d{1,9}$"), F.concat(F.lit("["), part, F.lit("]")))
        .when(part.rlike(r"^\d+$"), F.lit(None))
        .when(~part.rlike(r"^\s|\["), F.concat(F.lit("."), part))
        .when(~part.rlike("['?]"), F.concat(F.lit("['"), part, F.lit("']")))
        .when(~part.rlike('["?]'), F.concat(F.lit('["'), part, F.lit('"]')))
    )


def get_by_path(doc: Column, path: Column) -> Column:
    """String at ``path`` in a variant document, NULL when absent or not a string.

    Dots and ``[n]`` part the steps, empty steps don't count, and a step of digits is a position
    in a list, never a name.  The empty path is the document itself.
    """
    steps = F.transform(path_parts(path), _step)
    place = F.when(~F.exists(steps, lambda step: step.isNull()), F.concat(F.lit("$"), F.array_join(steps, "")))
    found = F.try_variant_get(doc, place, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", found.cast("string"))


def explode_records(docs: DataFrame, array_path: str, alias: str, *keep: str, outer: bool = False) -> DataFrame:
    """One row per array element with its position."""
    generate = F.posexplode_outer if outer else F.posexplode
    return docs.select(*keep, generate(F.col(array_path)).alias(f"{alias}_no", alias))
