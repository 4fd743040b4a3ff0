"""Flat tables from deeply nested JSON documents, with links from child to parent.

Every object gets a Dewey label, the ordinals of its ancestors and itself. Beside it stands the path of keys and indexes that the
label spells out. Elements of lists, the document itself and the named single objects are rows; any other single object is part of the
row around it, its members under dotted keys. Rows are grouped into tables by the schema path they were found on (the path without
the indexes, a list within a list of the same name standing for all depths); a row's parent is its label cut back to the row around it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys of a sequence entry under which lists are expected, in the spelling of the output paths; a bare object there is element 0.
ENTRY_LISTS = ("references", "dbReference", "property", "features", "sub_locations")
#: Single objects that are rows themselves, as others point to them.
ENTRY_ROWS = ("meta", "location")
#: Single objects whose spelling is settled but which are part of the row around them.
ENTRY_PARTS = ("citation", "locus", "tags")
#: The table of the documents themselves.
ROOT = "$"


def fold_key(key: str) -> str:
    return key.replace("_", "").lower()


def _holds_object(values: list) -> bool:
    """Whether an object stands in a list or in the lists inside it."""
    stack = list(values)
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            return True
        if isinstance(x, list):
            stack += x
    return False


def _without_objects(values: list) -> list:
    return [None if isinstance(x, dict) else _without_objects(x) if isinstance(x, list) else x for x in values]


def _holds_value(values: list) -> bool:
    stack = list(values)
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += x
        elif x is not None and not isinstance(x, dict):
            return True
    return False


class Walker:
    """Walks one document at a time and yields its rows."""

    def __init__(self, lists: tuple[str, ...], rows: tuple[str, ...], parts: tuple[str, ...]):
        self.spelling = {fold_key(k): k for k in (*lists, *rows, *parts)}
        self.lists, self.rows_too = frozenset(lists), frozenset(rows)
        self.spelled: dict[str, str] = {}

    def said(self, key: str) -> str:
        """The key in its settled spelling, or as it is written."""
        if key not in self.spelled:
            if len(self.spelled) > 100_000:
                self.spelled.clear()
            self.spelled[key] = self.spelling.get(fold_key(key), key)
        return self.spelled[key]

    def rows(self, document) -> Iterator[tuple]:
        """table, Dewey label, how much of it is the parent's, path, how much of it is the parent's, own members."""
        stack: list[tuple] = [(document, "", (), 0, "", 0)]
        while stack:
            node, schema, label, up, path, outer = stack.pop()
            if isinstance(node, list):  # no row of its own: the objects in it are
                step = schema + "[]"
                for i, x in enumerate(node):
                    if isinstance(x, (dict, list)):
                        stack.append((x, step, (*label, i), up, f"{path}.{i}" if path else str(i), outer))
                continue
            own: dict = {}
            inner = [(node, "", schema, label, path)]
            while inner:
                part, prefix, at, where, along = inner.pop()
                for i, (key, child) in enumerate(part.items()):
                    if not isinstance(child, (dict, list)):
                        own[prefix + key] = child
                        continue
                    said = self.said(key)
                    if isinstance(child, dict):
                        if said in self.lists:
                            child = [child]
                        elif said not in self.rows_too:
                            inner.append((child, f"{prefix}{said}.", f"{at}.{said}" if at else said, (*where, i), f"{along}.{said}" if along else said))
                            continue
                    elif not _holds_object(child):
                        if said not in self.lists or child:
                            own[prefix + key] = child
                        continue
                    elif _holds_value(child):
                        own[prefix + key] = _without_objects(child)
                    deeper = f"{at}.{said}" if at else said
                    if isinstance(child, list) and (at == f"{said}[]" or at.endswith(f".{said}[]")):
                        deeper = at.removesuffix("[]")  # the same table at another depth
                    stack.append((child, deeper, (*where, i), len(label), f"{along}.{said}" if along else said, len(path)))
            yield schema or ROOT, label, up, path, outer, own


NODE_SCHEMA = "table string, dewey array<int>, up int, node_path string, outer int, payload string, reason string"


def _walk(df: DataFrame, id_col: str, body_col: str, tables, payload: bool, lists, rows, parts) -> DataFrame:
    schema = f"__id {df.schema[id_col].dataType.simpleString()}, {NODE_SCHEMA}"
    wanted = None if tables is None else frozenset(tables)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(lists, rows, parts)
        for b in batches:
            take: list[int] = []
            name, up, path, outer, own, why = ([] for _ in range(6))
            labels, ends = [], [0]

            def flush():
                ids = b.column(0).take(pa.array(take, pa.int64()))
                dewey = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(labels, pa.int32()))
                cols = [pa.array(name, pa.string()), dewey, pa.array(up, pa.int32()), pa.array(path, pa.string()), pa.array(outer, pa.int32()), pa.array(own, pa.string()), pa.array(why, pa.string())]
                return pa.RecordBatch.from_arrays([ids, *cols], names=["__id", "table", "dewey", "up", "node_path", "outer", "payload", "reason"])

            def add(i, t, label, u, p, o, members, reason):
                take.append(i)
                name.append(t)
                labels.extend(label)
                ends.append(len(labels))
                up.append(u)
                path.append(p)
                outer.append(o)
                own.append(members)
                why.append(reason)

            for i, body in enumerate(b.column(1).to_pylist()):
                try:
                    document = json.loads(body) if body else None
                    fault = "no body" if not body else None if isinstance(document, (dict, list)) else "neither object nor list"
                except ValueError as e:
                    fault = f"not JSON: {e}"
                except RecursionError:
                    fault = "nested too deep"
                if fault:
                    add(i, None, (), None, None, None, None, fault)
                    continue
                for t, label, u, p, o, members in walker.rows(document):
                    if wanted is None or t in wanted:
                        add(i, t, label, u, p, o, json.dumps(members, ensure_ascii=False) if payload else None, None)
                if len(take) > 20_000:
                    yield flush()
                    take, labels, ends = [], [], [0]
                    name, up, path, outer, own, why = ([] for _ in range(6))
            yield flush()

    return df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{body_col}`").cast("string").alias("__body")).mapInArrow(kernel, schema)


def dewey_nodes(
    df: DataFrame, id_col: str, body_col: str, *, tables: tuple[str, ...] | None = None, payload: bool = True,
    lists: tuple[str, ...] = ENTRY_LISTS, rows: tuple[str, ...] = ENTRY_ROWS, parts: tuple[str, ...] = ENTRY_PARTS,
) -> DataFrame:
    """The rows of all tables: ``id_col``, table, dewey, node_path, parent_dewey, parent_path, payload.

    A table is the schema path of its rows, such as ``meta.references[]``; the document's own is ``$``, with the empty path. Keys match
    ``lists``, ``rows`` and ``parts`` regardless of letter case and underscores and are written in that spelling, others as they
    are. A bare object under a list key is element 0; null elements give no row but keep their index; an object among whose
    members two keys fold to the same spelling yields the rows of both. The payload holds a row's scalar members, those of
    single objects inside it under dotted keys, and lists of scalars, as JSON: no member of a document is lost. A null, empty or
    unparsable body, or one that is a scalar, gives no rows here but one of unparsed(). A body delivered twice under two ids gives
    the rows of each. Only the two named columns are read. tables: only these are wanted. payload: False leaves it null.
    """
    nodes = _walk(df, id_col, body_col, tables, payload, lists, rows, parts).where("reason is null")
    return nodes.select(
        F.col("__id").alias(id_col), "table", "dewey", "node_path", F.slice("dewey", F.lit(1), F.col("up")).alias("parent_dewey"),
        F.expr("left(node_path, outer)").alias("parent_path"), "payload",
    )


def unparsed(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``id_col``, ``reason`` of the documents that give no rows: no body, not JSON, nested deeper than the parser goes, or a scalar."""
    found = _walk(df, id_col, body_col, (), False, (), (), ()).where("reason is not null")
    return found.select(F.col("__id").alias(id_col), "reason")


def flat_tables(nodes: DataFrame, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each table, child rows linked by (id, parent_path) to (id, node_path) of another, ``members`` a map of text.

    tables: their schema paths; by default all that are found, one name a path being collected.
    """
    names = [r.table for r in nodes.select("table").distinct().collect()] if tables is None else tables
    return {
        name: nodes.where(F.col("table") == name).select(nodes.columns[0], "node_path", "parent_path", F.from_json("payload", "map<string,string>").alias("members"))
        for name in sorted(names)
    }
