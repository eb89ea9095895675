"""For SQL users: SELECT e.* FROM docs, LATERAL xml_events(docs.xml) e. Slower than the plan, and nothing is pruned in it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tagloom.schema import EVENTS
from tagloom.streaming.incremental import parse

_SCHEMA = EVENTS.removeprefix("doc_id bigint, ")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


class XmlEvents:
    """Events of the stream dialect."""

    def eval(self, xml: str) -> Iterator[tuple[Any, ...]]:
        for e in parse(xml):
            yield tuple(e.get(c) for c in _NAMES)


def register(spark: SparkSession) -> None:
    spark.udtf.register("xml_events", udtf(XmlEvents, returnType=_SCHEMA))
