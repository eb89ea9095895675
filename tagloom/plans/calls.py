"""Writer calls, one after the other, as rows of events: what plans.write takes.

    Calls().start_document().start_element("a", attributes={"k": "v"}).characters("t").end_document().frame(spark, doc_id=1)

A call only notes what it was given; whether it was allowed is found when the document is written.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tagloom import schema as S
from tagloom.plans.write import ATTRS

SCHEMA = f"doc_id long, seq long, type string, name string, prefix string, uri string, value string, target string, attrs {ATTRS}, self_closing boolean"
#: An attribute's value, or its value and prefix.
Value = str | tuple[str, str | None]


class Calls:
    """Every method returns the object, so that calls can be chained."""

    def __init__(self) -> None:
        self.events: list[dict[str, Any]] = []

    def _add(self, kind: str, **fields: Any) -> Calls:
        self.events.append({"type": kind, **fields})
        return self

    def start_document(self, version: str = "1.0", encoding: str | None = None) -> Calls:
        return self._add(S.START_DOCUMENT, value=version, target=encoding)

    def end_document(self) -> Calls:
        return self._add(S.END_DOCUMENT)

    def start_element(self, name: str, prefix: str | None = None, uri: str | None = None, attributes: Mapping[str, Value] | None = None, self_closing: bool = False) -> Calls:
        attrs = [(k, *(v if isinstance(v, tuple) else (v, None))) for k, v in (attributes or {}).items()]
        return self._add(S.START_ELEMENT, name=name, prefix=prefix, uri=uri, attrs=attrs, self_closing=self_closing)

    def attribute(self, name: str, value: str, prefix: str | None = None) -> Calls:
        return self._add(S.ATTRIBUTE, name=name, value=value, prefix=prefix)

    def namespace(self, prefix: str, uri: str) -> Calls:
        return self._add(S.NAMESPACE, prefix=prefix, uri=uri)

    def characters(self, text: str) -> Calls:
        return self._add(S.CHARACTERS, value=text)

    def cdata(self, text: str) -> Calls:
        return self._add(S.CDATA, value=text)

    def comment(self, text: str) -> Calls:
        return self._add(S.COMMENT, value=text)

    def processing_instruction(self, target: str, data: str | None = None) -> Calls:
        return self._add(S.PROCESSING_INSTRUCTION, target=target, value=data)

    def end_element(self) -> Calls:
        """The innermost open element; its name is known from the calls before."""
        open_names: list[dict[str, Any]] = []
        for e in self.events:
            if e["type"] == S.START_ELEMENT and not e["self_closing"]:
                open_names.append(e)
            elif e["type"] == S.END_ELEMENT and open_names:
                open_names.pop()
        last = open_names[-1] if open_names else {}
        return self._add(S.END_ELEMENT, name=last.get("name"), prefix=last.get("prefix"))

    def rows(self, doc_id: int = 1) -> list[tuple[Any, ...]]:
        return [(doc_id, i, e["type"], *(e.get(k) for k in ("name", "prefix", "uri", "value", "target", "attrs")), e.get("self_closing", False)) for i, e in enumerate(self.events)]

    def frame(self, spark: SparkSession, doc_id: int = 1) -> DataFrame:
        return spark.createDataFrame(self.rows(doc_id), SCHEMA)
