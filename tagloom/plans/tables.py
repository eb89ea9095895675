"""Rows and JSON to documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import schema as S
from tagloom.functions.text import escape
from tagloom.schema import WriterOptions


def element(name: str, content: Column, attributes: dict[str, Column] | None = None, options: WriterOptions = WriterOptions()) -> Column:
    """An element of a row: content is written as it is, null attributes are left out."""
    attrs = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape(v.cast("string"), options.entities, options.encode_entities), F.lit('"'))).otherwise("") for k, v in (attributes or {}).items()]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), F.coalesce(content, F.lit("")), F.lit(f"</{name}>"))


def text(x: Column, options: WriterOptions = WriterOptions()) -> Column:
    return escape(x.cast("string"), options.entities, options.encode_entities)


def rows_to_xml(rows: DataFrame, record: str, attributes: list[str], children: list[str], options: WriterOptions = WriterOptions()) -> Column:
    """A row as an element: some columns as attributes, others as child elements (null: no element)."""
    parts = [F.when(F.col(c).isNotNull(), element(c, text(F.col(c), options))).otherwise("") for c in children]
    return element(record, F.concat(F.lit(""), *parts), {c: F.col(c) for c in attributes}, options)


def table_to_xml(rows: DataFrame, key: str, root: str, record: str, attributes: list[str], children: list[str], order: str, options: WriterOptions = WriterOptions()) -> DataFrame:
    """(key, xml): one document for each value of key, a record for each of its rows, by order."""
    pieces = rows.select(key, F.struct(F.col(order), rows_to_xml(rows, record, attributes, children, options).alias("x")).alias("p")).groupBy(key).agg(F.collect_list("p").alias("p"))
    return pieces.select(key, element(root, F.array_join(F.transform(F.array_sort("p"), lambda p: p["x"]), "")).alias("xml"))


def props_to_xml(props: Column, root: str) -> Column:
    """A flat JSON object as an element with a child for each key, by key; all in the JVM."""
    pairs = F.array_sort(F.map_entries(F.from_json(props, "map<string,string>")))
    return element(root, F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), escape(e["value"]), F.lit("</"), e["key"], F.lit(">"))), ""))


def _walk(name: str, value: Any, form: str) -> Iterator[tuple[str, str | None, str | None, list[dict[str, Any]] | None]]:
    """Events (type, name, value, attrs) of a JSON value; depth is kept on a list, not on the call stack."""
    todo: list[Any] = [("node", name, value)]
    while todo:
        kind, name, value = todo.pop()
        if kind == "end":
            yield S.END_ELEMENT, name, None, None
        elif kind == "text":
            yield S.CHARACTERS, None, value, None
        elif isinstance(value, list) and form == "attributes":
            todo += [("node", name, v) for v in reversed(value)]
        else:
            attrs, inner = [], []
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, dict):
                    for k, v in item.items():
                        if form == "ordered" and k == "#text" or form == "attributes" and k == "__text":
                            inner.append(("text", None, _plain(v)))
                        elif form == "attributes" and k.startswith("_"):
                            attrs.append({"name": k[1:], "value": _plain(v), "prefix": None})
                        else:
                            inner.append(("node", k, v))
                elif item is not None:
                    inner.append(("text", None, _plain(item)))
            yield S.START_ELEMENT, name, None, attrs
            todo += [("end", name, None), *reversed(inner)]


def _plain(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def json_to_events(rows: DataFrame, form: str, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Events to write of JSON objects of any depth. form `ordered`: lists of one-key objects and `#text`; `attributes`: `_name` and `__text`.

    Each key of the outermost object is a root. Text that is no JSON object gives no events. JSON of any depth has no built-in way to rows, so this is Arrow.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[Any]] = {k: [] for k in ("doc_id", "seq", "type", "name", "value", "attrs")}
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    top = json.loads(raw) if raw else None
                except ValueError:
                    top = None
                items = top if isinstance(top, list) and form == "ordered" else [top]
                seq = 0
                for item in items:
                    for name, value in item.items() if isinstance(item, dict) else ():
                        for e in _walk(name, value, form):
                            for k, x in zip(out, (i, seq, *e), strict=True):
                                out[k].append(x)
                            seq += 1
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.string()) for x in ("name", "value", "prefix")]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return rows.select(id_col, json_col).mapInArrow(run, f"doc_id {kind}, seq long, type string, name string, value string, attrs array<struct<name:string,value:string,prefix:string>>")
