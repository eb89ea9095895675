"""Documents to tokens: one pattern splits the text, one expression tells what each piece is. No shuffle but the one that brings documents to their partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import NAME, SPACE, trim
from tagloom.schema import Dialect, ParserOptions

_COMMON = r"<!\[CDATA\[[\s\S]*?\]\]>|<!--(?:-?>|[\s\S]*?-->)|<\?(?:>|[\s\S]*?\?>)|"
PATTERNS: dict[Dialect, str] = {
    "sync": _COMMON + r"""</[^>]*>|<!DOCTYPE[^>]*>|<(?![!?/])(?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]+|<""",
    "stream": _COMMON + r"<(?!!--|!\[CDATA\[|\?)[^>]*>|[^<]+|<",
}
#: An element that has nothing but text, and no attributes: one token, so that fewer rows are sorted.
LEAVES: dict[Dialect, str] = {"sync": rf"""<([^<>/!?'"{SPACE}]++)>[^<]*+</\1>|""", "stream": rf"<({NAME}++)>[^<]*+</\1>|"}
TEXT, START, END, RAW, SKIP, OPEN = "text", "start", "end", "cdata", "skip", "open"
#: Rows that every document has, before and after its pieces.
FIRST, LAST = "first", "last"


def lex(xml: Column, dialect: Dialect) -> Column:
    """Array of pieces; together they are the whole text."""
    return F.regexp_extract_all(xml, F.lit(PATTERNS[dialect]), F.lit(0))


def kind(piece: Column, dialect: Dialect) -> Column:
    """What a piece is; OPEN is a `<` whose markup does not end."""
    skip = F.startswith(piece, F.lit("<!--")) | F.startswith(piece, F.lit("<?")) | (F.startswith(piece, F.lit("<!DOCTYPE")) if dialect == "sync" else F.lit(False))
    return (
        F.when(~F.startswith(piece, F.lit("<")), TEXT).when(piece == "<", OPEN).when(F.startswith(piece, F.lit("<![CDATA[")), RAW)
        .when(skip, SKIP).when(F.startswith(piece, F.lit("</")), END).otherwise(START)
    )


def _sync_tag(piece: Column, strict: bool) -> tuple[Column, Column, Column]:
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    closed = F.endswith(inner, F.lit("/"))
    inner = F.when(closed, trim(F.substring(inner, F.lit(1), F.length(inner) - 1))).otherwise(inner)
    if strict:
        name = F.regexp_extract(inner, rf"^[^{SPACE}]*", 0)
    else:
        name = F.substring_index(inner, " ", 1)
    return name, F.substring(inner, F.length(name) + 2, F.length(inner)), closed


_STREAM_START = rf"^<({NAME}+)([{SPACE}]+[^>]*?)?[{SPACE}]*(/?)>\z"
_STREAM_END = rf"^</({NAME}+)[{SPACE}]*>\z"


def tokens(docs: DataFrame, options: ParserOptions, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, declares, at, piece, kind, name, attrs, closed, inner, fault): inner is the text of an element that is one token (which is closed,
    then), fault the error that the token is by itself, declares whether the document may have declarations of namespaces."""
    d = options.dialect
    # documents move, not their tokens: what follows keeps this partitioning
    xml = F.coalesce(F.col(f"`{xml_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), xml.alias("xml"), F.contains(xml, F.lit("xmlns")).alias("declares")).repartition("doc_id")
    found = F.regexp_extract_all(F.col("xml"), F.lit(LEAVES[d] + PATTERNS[d]), F.lit(0))
    pieces = F.concat(F.array(F.lit(None).cast("string")), found, F.array(F.lit(None).cast("string")))
    rows = rows.select("doc_id", "declares", F.posexplode(pieces).alias("at", "piece"))
    rows = rows.withColumn("kind", F.when(F.col("piece").isNotNull(), kind(F.col("piece"), d)).when(F.col("at") == 0, FIRST).otherwise(LAST)).where(F.col("kind") != SKIP)
    piece, k = F.col("piece"), F.col("kind")
    # no other start tag has a `>` before its end but in quotes
    head = F.substring_index(piece, ">", 1)
    leaf = (k == START) & (F.octet_length(head) + 1 < F.octet_length(piece)) & ~F.contains(head, F.lit('"')) & ~F.contains(head, F.lit("'"))
    own = F.substring(head, F.lit(2), F.length(head))
    inner = F.substring(piece, F.length(head) + 2, F.length(piece) - 2 * F.length(head) - 3)
    if d == "sync":
        name, attrs, closed = _sync_tag(piece, options.strict)
        end_name, fault = trim(F.substring(piece, F.lit(3), F.length(piece) - 3)), F.lit(None).cast("string")
    else:
        name, attrs, closed = F.regexp_extract(piece, _STREAM_START, 1), F.regexp_extract(piece, _STREAM_START, 2), F.regexp_extract(piece, _STREAM_START, 3) == "/"
        end_name = F.regexp_extract(piece, _STREAM_END, 1)
        fault = F.when((k == START) & ~leaf & ~piece.rlike(_STREAM_START), "Malformed start tag").when((k == END) & ~piece.rlike(_STREAM_END), "Malformed closing tag")
    return rows.select(
        "doc_id", "declares", F.col("at").cast("long").alias("at"), "piece", "kind", F.when(leaf, own).when(k == START, name).when(k == END, end_name).alias("name"),
        F.when(leaf, "").when(k == START, attrs).alias("attrs"), F.coalesce(leaf | (k == START) & closed, F.lit(False)).alias("closed"), F.when(leaf, inner).alias("inner"), fault.alias("fault"))
