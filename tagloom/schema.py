"""Event types, columns and options of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

Dialect = Literal["sync", "stream"]

START_DOCUMENT, END_DOCUMENT = "START_DOCUMENT", "END_DOCUMENT"
START_ELEMENT, END_ELEMENT = "START_ELEMENT", "END_ELEMENT"
CHARACTERS, CDATA, ERROR = "CHARACTERS", "CDATA", "ERROR"
#: Only the writer takes these.
ATTRIBUTE, NAMESPACE, COMMENT, PROCESSING_INSTRUCTION = "ATTRIBUTE", "NAMESPACE", "COMMENT", "PROCESSING_INSTRUCTION"
EVENT_TYPES = (START_DOCUMENT, END_DOCUMENT, START_ELEMENT, END_ELEMENT, CHARACTERS, CDATA, ERROR)

ATTRIBUTE_INFO = "struct<value:string,local_name:string,prefix:string,uri:string>"
EVENTS = (
    "doc_id bigint, seq bigint, type string, name string, local_name string, prefix string, uri string, "
    f"attributes map<string,string>, attributes_with_prefix map<string,{ATTRIBUTE_INFO}>, value string, error string, "
    "depth int, node_id bigint, parent_id bigint, element string"
)


@dataclass(frozen=True)
class ParserOptions:
    """dialect: which of the two sets of rules holds; they differ on purpose (README). entities: literal text to its replacement.

    strict (sync dialect): an element that is still open at the end is an error, and any white space ends a tag's name.
    buffer_size and compact_buffer are accepted and do nothing: there is no buffer here.
    """

    dialect: Dialect = "sync"
    encoding: str = "utf-8"
    decode_entities: bool = True
    entities: tuple[tuple[str, str], ...] = ()
    namespaces: bool = True
    strict: bool = False
    buffer_size: int | None = None
    compact_buffer: bool | None = None


@dataclass(frozen=True)
class WriterOptions:
    """entities: literal text to what it is written as. The settings hold for whole documents."""

    encoding: str = "utf-8"
    pretty: bool = False
    indent: str = "  "
    encode_entities: bool = True
    entities: tuple[tuple[str, str], ...] = field(default=())
