"""Nesting: depth, numbers, matching of tags, the first error, text runs.

All windows are partitioned by document, so they share the partitioning that the documents came in; they ask for two sorts (four in
the stream dialect), of rows that hold raw text only. Within one document and level
a well-formed beginning alternates start and end tags, so the element that an end tag closes is the start tag before it
on its level. All before the first error is well-formed, so what finds the first error is exact; what follows is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.lexer import END, FIRST, LAST, OPEN, RAW, START, TEXT
from tagloom.schema import ParserOptions

#: What a document is told by in windows: its id, and a fact of its text that conditions can be pushed down by.
DOCUMENT = ["doc_id", "declares"]
#: Error messages.
NOT_CLOSED = "Unexpected end of document. Not all elements were closed."
UNKNOWN_MARKUP = "Unrecognized markup declaration"
UNCLOSED = [
    ("!--", "Unclosed comment"), ("![CDATA[", "Unclosed CDATA section"), ("!DOCTYPE", "Unclosed DOCTYPE declaration"), ("!", UNKNOWN_MARKUP),
    ("?", "Unclosed processing instruction"), ("/", "Unclosed end tag"),
]


def levels(tokens: DataFrame, *more: Column) -> DataFrame:
    """With depth (elements open after the token), level (that of the tag's element, 1 for a root), and rest: what follows an open `<`.
    more: further columns of the same sort."""
    step = F.when((F.col("kind") == START) & ~F.col("closed"), 1).when(F.col("kind") == END, -1).otherwise(0)
    order = Window.partitionBy(*DOCUMENT).orderBy("at")
    after = F.lead(F.when(F.col("kind") == LAST, F.lit("")).otherwise(F.col("piece"))).over(order)
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = tokens.select("*", depth.alias("depth"), F.when(F.col("kind") == OPEN, after).alias("rest"), *more)
    tag = (F.col("kind") == END) | (F.col("kind") == START) & F.col("closed")
    return rows.withColumn("level", F.when(tag, F.col("depth") + 1).otherwise(F.col("depth")))


def events_before(*order: str) -> Column:
    """The number of events before a token's own."""
    kind, told = F.col("kind"), F.when(F.col("blank"), 0).otherwise(1)
    n = F.when(kind == TEXT, told).when(F.col("inner").isNotNull(), told + 2).when((kind == START) & F.col("closed"), 2).otherwise(1)
    return F.coalesce(F.sum(n).over(Window.partitionBy(*DOCUMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def text_runs(rows: DataFrame) -> DataFrame:
    """Stream dialect: text between two tags is one piece, whatever stands in between, and comes after the CDATA among it.

    With run and class to order by. Text that waits for markup that never ends inside of an element is not told, and nothing behind an open `<` is.
    A run of tokens is one row for a moment, so that its texts are joined once.
    """
    up_to = Window.partitionBy(*DOCUMENT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.col("kind").isin(START, END).cast("long")).over(up_to))
    rows = rows.withColumn("opened", F.sum((F.col("kind") == OPEN).cast("int")).over(up_to)).where((F.col("opened") == 0) | (F.col("opened") == 1) & (F.col("kind") == OPEN))
    is_text, fields = F.col("kind") == TEXT, [c for c in rows.columns if c not in (*DOCUMENT, "run", "opened")]
    waits = (F.col("kind") == OPEN) & (F.col("depth") > 0) & F.col("rest").rlike(r"^(?:!--|!\[CDATA\[|\?)")
    whole = F.struct(*fields)
    runs = rows.groupBy(*DOCUMENT, "run").agg(
        F.collect_list(F.when(~is_text, whole)).alias("others"), F.collect_list(F.when(is_text, F.struct("at", "piece"))).alias("texts"),
        F.max_by(F.when(is_text, whole), F.when(is_text, F.col("at"))).alias("text"), F.max(waits).alias("waits"))
    text = F.when(F.size("texts") == 1, F.col("text")).otherwise(F.col("text").withField("piece", F.array_join(F.transform(F.array_sort("texts"), lambda t: t["piece"]), "")))
    each = F.when((F.size("texts") > 0) & ~F.col("waits"), F.concat("others", F.array(text))).otherwise(F.col("others"))
    rows = runs.select(*DOCUMENT, "run", F.explode(each).alias("t")).select(*DOCUMENT, "run", "t.*")
    kind = F.col("kind")
    return rows.withColumn("class", F.when(kind == FIRST, -1).when(kind.isin(START, END), 0).when(kind == RAW, 1).when(kind == TEXT, 2).otherwise(3))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with seq get node_id, element and parent_id, and expected: the name of the element that an end tag has to close.

    In the order of the document, a start tag right behind an open start tag (text does not count) is below that one. Within a level,
    its sisters follow it, so they have the parent that was found last; and what belongs to an element comes between its start tag
    and the next one on its level.
    """
    kind, opens = F.col("kind"), (F.col("kind") == START) & ~F.col("closed")
    ahead = Window.partitionBy(*DOCUMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tag = F.last(F.when(kind.isin(START, END), F.struct(F.when(opens, F.col("seq")).alias("opener"))), ignorenulls=True).over(ahead)
    rows = rows.withColumn("below", F.when(kind == START, tag["opener"]))
    # an end tag opens nothing, so that its own row may be looked at, too
    so_far = Window.partitionBy(*DOCUMENT, "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def last(x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(so_far)

    return rows.select("*", last(F.when(opens, F.col("name"))).alias("expected"), last(F.when(kind == START, F.col("seq"))).alias("node_id"), last(F.when(kind == START, F.col("name"))).alias("element"), last(F.col("below")).alias("parent_id"))


def faults(rows: DataFrame, options: ParserOptions) -> DataFrame:
    """With fault: what is wrong with each token ('' ends the document there without an error)."""
    sync = options.dialect == "sync"
    nothing = F.format_string("Mismatched closing tag: </%s>. " + ("No open elements." if sync else "Expected </nothing>"), "name")
    other = F.format_string("Mismatched closing tag: </%s>. Expected </%s>" + ("." if sync else ""), "name", "expected")
    wrong = F.when(F.col("kind") == END, F.when(F.col("level") < 1, nothing).when(~F.col("name").eqNullSafe(F.col("expected")), other))
    if sync:
        unclosed = F
        for beginning, message in UNCLOSED:
            unclosed = unclosed.when(F.startswith("rest", F.lit(beginning)), F.lit(message))
        unclosed = unclosed.otherwise("Unclosed start tag")
    else:  # the rest is dropped; it is an error only inside of an element
        unclosed = F.when(F.col("depth") > 0, NOT_CLOSED).otherwise("")
    open_at_end = F.when((F.col("kind") == LAST) & (F.col("depth") > 0) & F.lit(not sync or options.strict), NOT_CLOSED)
    return rows.withColumn("fault", F.coalesce("fault", wrong, F.when(F.col("kind") == OPEN, unclosed), open_at_end)).drop("expected", "rest")


def cut(rows: DataFrame) -> DataFrame:
    """Tokens up to the first fault, that one included."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.col("at"))).over(Window.partitionBy(*DOCUMENT))
    return rows.withColumn("failed_at", first).where(F.col("failed_at").isNull() | (F.col("at") <= F.col("failed_at"))).drop("failed_at")
