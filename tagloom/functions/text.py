"""Text functions of XML, as expressions: white space, entities, qualified names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in browsers have it.
SPACE = r"\t\n\x0B\f\r    -     　﻿"
#: The entities that every document may use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
NAME = "[a-zA-Z0-9_:.-]"


_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(_SPACES))


def is_blank(x: Column) -> Column:
    return F.ltrim(x, F.lit(_SPACES)) == ""


def _one_pass(x: Column, table: dict[str, str]) -> Column:
    """Replace each key, the first in order that fits, from left to right; what was put in is not looked at again."""
    keys = "|".join(re.escape(k) for k in table)
    found = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    parts = F.regexp_extract_all(x, F.lit(rf"{keys}|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(found, p), p)), "")


def _chain(x: Column, table: list[tuple[str, str]]) -> Column:
    for k, v in table:
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def unescape(x: Column, entities: tuple[tuple[str, str], ...] = (), enabled: bool = True) -> Column:
    """Entities decoded once. `&amp;` comes last and cannot be redefined; pairs with an empty side are left out."""
    if not enabled:
        return x
    own = {k: v for k, v in entities if k and v}
    if own:
        table = ENTITIES | own
        table.pop("&amp;", None)
        return F.coalesce(_one_pass(x, table | {"&amp;": "&"}), F.lit(""))
    plain = _chain(x, [*ENTITIES.items(), ("&amp;", "&")])
    return F.coalesce(F.when(F.contains(x, F.lit("&")), plain).otherwise(x), F.lit(""))


def escape(x: Column, entities: tuple[tuple[str, str], ...] = (), enabled: bool = True) -> Column:
    """Text as it is written, the same in content and attributes. `&` is always taken first."""
    if not enabled:
        return F.coalesce(x, F.lit(""))
    table = {"&": "&amp;"} | {v: k for k, v in ENTITIES.items()} | {k: v for k, v in entities if k and v}
    if any(k and v for k, v in entities):
        return F.coalesce(_one_pass(x, table), F.lit(""))
    return F.coalesce(_chain(x, list(table.items())), F.lit(""))


def prefix_of(name: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1))


def local_of(name: Column) -> Column:
    at = F.locate(":", name)
    return F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(name)


def last_wins(entries: Column) -> Column:
    """Entries (name, ...) without those whose name comes again later."""
    names = F.transform(entries, lambda e: e["name"])
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]))
    return F.when((F.size(entries) < 2) | (F.size(F.array_distinct(names)) == F.size(entries)), entries).otherwise(kept)
