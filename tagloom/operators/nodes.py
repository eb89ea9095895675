"""Events to elements, records and counts: what users of events ask of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom import schema as S


def _is_text() -> Column:
    return F.col("type").isin(S.CHARACTERS, S.CDATA)


def _joined(pieces: Column) -> Column:
    """Pieces (seq, value), in order, as one text."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["value"]), "")


def select_events(events: DataFrame, types: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Events of these types, and of elements of these names."""
    for column, values in (("type", types), ("name", names)):
        if values is not None:
            events = events.where(F.col(column).isin(values))
    return events


def first_match(events: DataFrame, condition: Column) -> DataFrame:
    """The first event of each document that fits: one aggregate, no sort."""
    row = F.struct(*(c for c in events.columns))
    return events.where(condition).groupBy("doc_id").agg(F.min_by(row, "seq").alias("e")).select("e.*")


def counts(events: DataFrame) -> DataFrame:
    """(doc_id, type, n)."""
    return events.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def name_counts(events: DataFrame) -> DataFrame:
    """(name, n): start tags by name."""
    return events.where(F.col("type") == S.START_ELEMENT).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def balanced(events: DataFrame) -> DataFrame:
    """(doc_id, starts, ends, balanced)."""
    n = events.groupBy("doc_id").agg(F.count_if(F.col("type") == S.START_ELEMENT).alias("starts"), F.count_if(F.col("type") == S.END_ELEMENT).alias("ends"))
    return n.withColumn("balanced", F.col("starts") == F.col("ends"))


def text_length(events: DataFrame) -> DataFrame:
    """(doc_id, length): code points of all text. CDATA counts too."""
    return events.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(_is_text(), F.length("value"))), F.lit(0)).alias("length"))


def nodes(events: DataFrame) -> DataFrame:
    """One row an element: doc_id, node_id, parent_id, depth, names, attributes, text (its own, in order), ordinal among its parent's elements, children."""
    inside = events.where(F.col("node_id").isNotNull())
    start = F.col("type") == S.START_ELEMENT
    own = inside.where(start | _is_text()).groupBy("doc_id", "node_id").agg(
        F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"),
        *(F.any_value(F.when(start, F.col(c)), True).alias(c) for c in ("name", "local_name", "prefix", "uri", "attributes")),
        _joined(F.collect_list(F.when(_is_text(), F.struct("seq", "value")))).alias("text"))
    order = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    own = own.withColumn("ordinal", F.row_number().over(order))
    children = own.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    return own.join(children, ["doc_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def child_text(tree: DataFrame, parent: str, child: str) -> DataFrame:
    """(doc_id, node_id, text): text of each element `child` right below an element `parent`; node_id is the parent's."""
    above = tree.where(F.col("name") == parent).select("doc_id", "node_id")
    below = tree.where(F.col("name") == child).select("doc_id", F.col("parent_id").alias("node_id"), "text")
    return above.join(below, ["doc_id", "node_id"])


def nth_child(tree: DataFrame, n: int) -> DataFrame:
    """The n-th element (from 1) below each element."""
    return tree.where((F.col("ordinal") == n) & F.col("parent_id").isNotNull())


def records(events: DataFrame, record: str, fields: dict[str, str]) -> DataFrame:
    """A row for each element `record`: doc_id, node_id, and a text column for each field.

    A field names a child, whose text it takes (the first child of that name; null without one), or `@attribute` of the record.
    """
    start = F.col("type") == S.START_ELEMENT
    rows = events.where(F.col("node_id").isNotNull())
    if "element" not in events.columns:
        peers = Window.partitionBy("doc_id", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("element", F.last(F.when(start, F.col("name")), True).over(peers))
    head = start & (F.col("name") == record)
    rows = rows.withColumn("record", F.when(head, F.col("node_id")).otherwise(F.col("parent_id"))).where("record is not null")
    out = [F.max(head).alias("is_record")]
    for column, path in fields.items():
        if path.startswith("@"):
            out.append(F.any_value(F.when(head, F.element_at("attributes", F.lit(path[1:]))), True).alias(column))
        else:
            child = (F.col("element") == path) & ~head
            out.append(F.min(F.when(child & start, F.col("node_id"))).alias(f"{column}__first"))
            out.append(F.collect_list(F.when(child & _is_text(), F.struct("seq", "node_id", "value"))).alias(column))
    rows = rows.where(start | _is_text()).groupBy("doc_id", "record").agg(*out).where("is_record")

    def text(c: str) -> Column:
        first = F.col(f"{c}__first")
        own = F.filter(c, lambda x: x["node_id"] == first)
        joined = F.array_join(F.transform(F.array_sort(own), lambda x: x["value"]), "")
        only = F.get(F.col(c), F.lit(0))
        return F.when(first.isNotNull(), F.when((F.size(c) == 1) & (only["node_id"] == first), only["value"]).otherwise(joined)).alias(c)

    return rows.select("doc_id", F.col("record").alias("node_id"), *(F.col(c) if p.startswith("@") else text(c) for c, p in fields.items()))
