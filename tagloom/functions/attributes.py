"""Attributes of a start tag's text, as an array of (name, value, declares): declares is the prefix of a namespace declaration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import NAME, SPACE, trim, unescape
from tagloom.schema import ParserOptions

_DECLARED = r'(?:xmlns(?::[a-zA-Z0-9_.-]+)?)="[^"]*"'
_STREAM = rf'{NAME}+="[^"]*"'
_SYNC = rf'{NAME}+(?:[{SPACE}]*=[{SPACE}]*"[^"]*")?'


def _entry(name: Column, value: Column, declares: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), declares.alias("declares"))


def _quoted(x: Column) -> Column:
    """Between the first and the last quotation mark."""
    at = F.locate('"', x)
    return F.when(at > 0, F.substring(x, at + 1, F.length(x) - at - 1))


def _name(x: Column) -> Column:
    """What stands before the equals sign: of an attribute that a pattern has found, a name."""
    return trim(F.substring_index(x, "=", 1))


def _declares(name: Column) -> Column:
    return F.when(name == "xmlns", F.lit("")).when(F.startswith(name, F.lit("xmlns:")), F.substring(name, F.lit(7), F.length(name)))


def attributes(text: Column, options: ParserOptions) -> Column:
    """In the order in which their prefixes are resolved: sync takes the declarations first, stream goes from left to right."""

    def decoded(x: Column) -> Column:
        return unescape(x, options.entities, options.decode_entities)

    none = F.array().cast("array<struct<name:string,value:string,declares:string>>")
    if options.dialect == "stream":
        found = F.transform(F.regexp_extract_all(text, F.lit(_STREAM), F.lit(0)), lambda m: _entry(_name(m), decoded(_quoted(m)), _declares(_name(m))))
        return F.when(text == "", none).otherwise(found)
    declared = F.transform(F.regexp_extract_all(text, F.lit(_DECLARED), F.lit(0)), lambda m: _entry(_name(m), _quoted(m), _declares(_name(m))))
    declared = F.when(F.contains(text, F.lit("xmlns")), declared).otherwise(none)
    found = F.filter(F.regexp_extract_all(text, F.lit(_SYNC), F.lit(0)), lambda m: ~F.startswith(m, F.lit("xmlns")))
    plain = F.transform(found, lambda m: _entry(_name(m), F.when(F.coalesce(_quoted(m), F.lit("")) == "", F.lit("true")).otherwise(decoded(_quoted(m))), F.lit(None).cast("string")))
    return F.when(text == "", none).otherwise(F.concat(declared, plain))
