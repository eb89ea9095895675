"""The plan from documents to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom import schema as S
from tagloom.functions.attributes import attributes
from tagloom.functions.text import is_blank, last_wins, local_of, prefix_of, trim, unescape
from tagloom.operators import structure
from tagloom.operators.lexer import END, FIRST, LAST, RAW, START, TEXT, tokens
from tagloom.operators.namespaces import innermost
from tagloom.schema import ParserOptions
from tagloom.sources.documents import decoded

_LATER = 1 << 30
_FAILED = "failed"


def _resolved(rows: DataFrame, options: ParserOptions) -> DataFrame:
    """Tags with uri, and their attributes with local name, prefix and uri."""
    tags = rows.where(F.col("kind").isin(START, END))
    peers = Window.partitionBy("doc_id", "level").orderBy("at")
    ends = F.lead(F.when(F.col("kind") == END, F.col("at"))).over(peers)  # the tag behind an open start tag on its level ends it
    tags = tags.withColumn("until", F.when(F.col("closed"), F.col("at")).otherwise(F.coalesce(ends, F.lit(1 << 60))))
    sub = (lambda i: i) if options.dialect == "stream" else (lambda i: F.lit(-1))
    each = tags.where(F.size("attrs") > 0).select("doc_id", "at", "until", F.posexplode("attrs").alias("i", "a"))
    declared = each.where("a.declares is not null").select("doc_id", F.col("a.declares").alias("prefix"), F.col("a.value").alias("uri"), "at", sub(F.col("i")).cast("int").alias("sub"), "until")
    own = F.col("kind") == START
    elements = tags.select("doc_id", F.coalesce(prefix_of(F.col("name")), F.lit("")).alias("prefix"), "at", F.when(own, _LATER - 1).otherwise(0).cast("int").alias("sub"), F.lit(-1).alias("i"))
    # an attribute without prefix has no namespace; a declaration is not resolved in the sync dialect, and opens after its own look-up in the other
    named = each.where(F.contains("a.name", F.lit(":")) & (F.lit(options.dialect == "stream") | F.col("a.declares").isNull()))
    asked = named.select("doc_id", prefix_of(F.col("a.name")).alias("prefix"), "at", (F.col("i") - (1 if options.dialect == "stream" else 0)).cast("int").alias("sub"), "i")
    found = innermost(declared, elements.unionByName(asked)).where("declared").groupBy("doc_id", "at").agg(
        F.max(F.when(F.col("i") < 0, F.col("uri"))).alias("uri"), F.map_from_entries(F.collect_list(F.struct("i", "uri"))).alias("uris"))
    return rows.join(found, ["doc_id", "at"], "left")


def _infos(options: ParserOptions) -> Column:
    """Entries of attributes_with_prefix."""
    uri = lambda i: F.element_at("uris", i)
    stream = options.dialect == "stream"

    def info(a: Column, i: Column) -> Column:
        prefix, local = prefix_of(a["name"]), local_of(a["name"])
        if stream:
            key, value = local, F.struct(a["value"].alias("value"), F.lit(None).cast("string").alias("local_name"), prefix.alias("prefix"), F.when(prefix.isNotNull(), uri(i)).alias("uri"))
        else:
            declares = a["declares"].isNotNull()
            key, value = a["name"], F.struct(a["value"].alias("value"), local.alias("local_name"), prefix.alias("prefix"), F.when(prefix.isNotNull() & ~declares, uri(i)).alias("uri"))
        return F.struct(key.alias("name"), value.alias("value"))

    return F.map_from_entries(last_wins(F.transform("attrs", info)))


def parse_xml(docs: DataFrame, options: ParserOptions = ParserOptions(), id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """Events of every document, one row each; `seq` is their order.

    A document that is not well-formed has the events before its first error, then an ERROR row, and no END_DOCUMENT.
    depth counts the elements around an event (its own included, for tags); node_id is the seq of the element's start tag, for text of the
    element around it, element that one's name; parent_id is that of the element one level up, null for roots. A null document is an empty one. A binary column is decoded by options.encoding.
    """
    if docs.schema[xml_col].dataType.typeName() == "binary":
        docs = docs.withColumn(xml_col, decoded(F.col(f"`{xml_col}`"), options.encoding))
    stream = options.dialect == "stream"
    is_text, raw = F.col("kind") == TEXT, F.coalesce("inner", "piece")
    value = unescape(raw if stream else trim(raw), options.entities, options.decode_entities)
    blank = F.when(is_text | F.col("inner").isNotNull(), is_blank(value if stream else raw)).alias("blank")

    def structured(rows: DataFrame, runs: bool) -> DataFrame:
        """Tokens up to the first fault, with their places. runs: a text may consist of several pieces."""
        if runs:
            order = ["run", "class", "at"]
            rows = structure.text_runs(structure.levels(rows)).select("*", blank)
            rows = rows.withColumn("seq", structure.events_before(*order))
        else:
            order = ["at"]
            rows = structure.levels(rows.select("*", blank), structure.events_before(*order).alias("seq"))
        rows = structure.cut(structure.faults(structure.placed(rows, *order), options)).drop("run", "class")
        failed = F.col("fault").isNotNull()
        rows = rows.withColumn("kind", F.when(failed & (F.col("fault") == ""), LAST).when(failed, _FAILED).otherwise(F.col("kind")))
        rows = rows.where(~(is_text & F.col("blank")))
        # what costs more than a look at the text comes last: no sort carries it, and nothing is computed that is not asked for
        return rows.withColumn("attrs", F.when(F.col("kind") == START, attributes(F.col("attrs"), options)))

    # resolving looks at tags twice, so documents without declarations go another way: there, no prefix has a uri. `declares` is among
    # the keys of all windows, so that this condition is the first thing that each way looks at
    nothing = (F.lit(None).cast("string").alias("uri"), F.lit(None).cast("map<int,string>").alias("uris"))
    if stream:
        # a text has one piece, and the order of the pieces is that of the events, where no comment, CDATA or instruction stands but at the very beginning
        behind = F.substring(F.col(f"`{xml_col}`"), F.lit(2), F.length(F.col(f"`{xml_col}`")))
        mixed = F.coalesce(F.contains(behind, F.lit("<!")) | F.contains(behind, F.lit("<?")), F.lit(False))
        one, several = (tokens(docs.where(c), options, id_col, xml_col) for c in (~mixed, mixed))
        if options.namespaces:
            one, several = one.where("not declares"), several.where("not declares")
        rows = structured(one, False).unionByName(structured(several, True)).select("*", *nothing)
        if options.namespaces:
            rows = rows.unionByName(_resolved(structured(tokens(docs, options, id_col, xml_col).where("declares"), True), options))
    else:
        rows = structured(tokens(docs, options, id_col, xml_col), False)
        plain = rows.select("*", *nothing)
        if options.namespaces:
            rows = plain.where("not declares").unionByName(_resolved(rows.where("declares"), options))
        else:
            rows = plain
    none, tag = F.lit(None).cast("string"), F.col("kind").isin(START, END)
    kinds = {FIRST: S.START_DOCUMENT, LAST: S.END_DOCUMENT, _FAILED: S.ERROR, START: S.START_ELEMENT, END: S.END_ELEMENT, RAW: S.CDATA, TEXT: S.CHARACTERS}
    kind = F
    for k, v in kinds.items():
        kind = kind.when(F.col("kind") == k, F.lit(v))
    entries = F.map_from_entries(last_wins(F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))))
    # events of a token: its own, the text and the end of an element that is one token
    own, text, end = (F.lit(x) for x in range(3))
    parts = F.when(~F.col("closed") | (F.col("kind") != START), F.array(own)).when(F.coalesce("blank", F.lit(True)), F.array(own, end)).otherwise(F.array(own, text, end))
    rows = rows.withColumn("type", kind).select("*", F.posexplode(parts).alias("more", "sub"))
    start = (F.col("kind") == START) & (F.col("sub") == 0)
    tag, is_text, inside = tag & (F.col("sub") != 1), is_text | (F.col("sub") == 1), tag | is_text | (F.col("kind") == RAW)
    return rows.select(
        "doc_id", (F.col("seq") + F.col("more")).alias("seq"), F.when(F.col("sub") == 1, S.CHARACTERS).when(F.col("sub") == 2, S.END_ELEMENT).otherwise(F.col("type")).alias("type"),
        F.when(tag, F.col("name")).alias("name"), F.when(tag, local_of(F.col("name"))).alias("local_name"), F.when(tag, prefix_of(F.col("name"))).alias("prefix"),
        F.when(tag, F.col("uri")).alias("uri"), F.when(start, entries).alias("attributes"), F.when(start, _infos(options)).alias("attributes_with_prefix"),
        F.when(F.col("kind") == RAW, F.substring("piece", F.lit(10), F.length("piece") - 12)).when(is_text, value).alias("value"),
        F.when(F.col("kind") == _FAILED, F.col("fault")).alias("error"), F.when(inside, F.col("level")).otherwise(0).cast("int").alias("depth"),
        F.when(inside & (F.col("level") > 0), F.col("node_id")).alias("node_id"), F.when(inside & (F.col("level") > 1), F.col("parent_id")).alias("parent_id"),
        F.when(inside & (F.col("level") > 0), F.col("element")).alias("element"))
