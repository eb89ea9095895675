"""Queries of the event engine on the driver's tables, and the same in SQL over the original columns.

The tables hold no XML, so documents are built from rows, parsed again, and compared with what they were built from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schema as S
from tagloom.functions.text import NAME, escape, local_of, prefix_of, trim, unescape
from tagloom.operators import nodes as N
from tagloom.operators.lexer import lex
from tagloom.plans.calls import Calls
from tagloom.plans.parse import parse_xml
from tagloom.plans.tables import element, json_to_events, props_to_xml, rows_to_xml, table_to_xml, text
from tagloom.plans.write import ATTRS, nodes_to_events, write_xml, writer_events
from tagloom.schema import ParserOptions, WriterOptions
from tagloom.sources.documents import chunks, decoded, read_chunk_stream, shared_folder, stored
from tagloom.streaming.incremental import parse_chunks, parse_stream

Query = Callable[[SparkSession, str], DataFrame]
SYNC, STREAM = ParserOptions(dialect="sync"), ParserOptions(dialect="stream")
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    """Money as whole cents: engines write doubles differently."""
    return F.round(x * 100).cast("long")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): an order as <order id=".." status=".."><priority>..</priority><cents>..</cents></order>."""
    o = table(spark, sf_dir, "orders").withColumn("cents", cents(F.col("o_totalprice")))
    body = F.concat(element("priority", text(F.col("o_orderpriority"))), element("cents", text(F.col("cents"))), element("customer", text(F.col("o_custkey"))))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('<?xml version="1.0"?>\n'), element("order", body, {"id": F.col("o_orderkey"), "status": F.col("o_orderstatus")})).alias("xml"))


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): an order's lines, <order><line no=".." part=".."><qty>..</qty><flag>..</flag></line>...</order>."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"))
    return table_to_xml(rows, "doc_id", "order", "line", ["no", "part"], ["qty", "flag"], "no")


_LINE = """'<line no="' || l_linenumber || '" part="' || l_partkey || '"><qty>' || CAST(l_quantity AS BIGINT) || '</qty><flag>' || l_returnflag || '</flag></line>'"""
_ORDERS = f"SELECT l_orderkey, {{0}}'<order>' || string_agg({_LINE}, '' ORDER BY l_linenumber, {_LINE}) || '</order>' AS xml FROM lineitem GROUP BY l_orderkey"


def node_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<part key="'), F.col("p_partkey"), F.lit('" small="" tested><name>'), escape(F.col("p_name")), F.lit('</name><size v="'), F.col("p_size"), F.lit('"/><!-- '), F.lit("note"), F.lit(" --></part>"))
    return p.select(F.col("p_partkey").alias("doc_id"), xml.alias("xml"))


# scalar functions

_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""


@query(f"SELECT doc_id, {_ESCAPED.format('text')} AS escaped FROM documents")
def escape_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, text FROM documents")
def unescape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", unescape(escape(F.col("text"))).alias("text"))


@query("SELECT p_partkey, replace(replace(replace(p_type, 'STEEL', '[S]'), 'BRASS', '[B]'), ' ', '&sp;') AS coded, replace(replace(p_type, 'STEEL', 'steel'), 'BRASS', 'brass') AS read FROM part")
def custom_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = escape(F.col("p_type"), (("STEEL", "[S]"), ("BRASS", "[B]"), (" ", "&sp;")))
    read = unescape(coded, (("[S]", "steel"), ("[B]", "brass"), ("&sp;", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", coded.alias("coded"), read.alias("read"))


@query("SELECT o_orderkey, '&lt;' || o_orderstatus || '&amp;' AS raw FROM orders")
def entities_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("&lt;"), F.col("o_orderstatus"), F.lit("&amp;"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), element("a", raw).alias("xml"))
    events = parse_xml(docs, ParserOptions(decode_entities=False))
    return events.where(F.col("type") == S.CHARACTERS).select(F.col("doc_id").alias("o_orderkey"), F.col("value").alias("raw"))


@query(r"SELECT doc_id, regexp_replace(text, '^[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS trimmed FROM documents")
def trim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", trim(F.col("text")).alias("trimmed"))


@query("SELECT n_nationkey, 'n' || n_regionkey AS prefix, n_name AS local_name FROM nation")
def qname_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("n_regionkey"), F.lit(":"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", prefix_of(name).alias("prefix"), local_of(name).alias("local_name"))


@query("SELECT doc_id, upper(lang) AS encoding, repeat('  ', CAST(doc_id % 5 AS INT)) AS indent FROM documents")
def upper_and_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.upper("lang").alias("encoding"), F.repeat(F.lit("  "), (F.col("doc_id") % 5).cast("int")).alias("indent"))


# records and counts

@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey FROM orders")
def orders_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.records(parse_xml(order_documents(spark, sf_dir)), "order", {"id": "@id", "status": "@status", "priority": "priority", "cents": "cents", "customer": "customer"})
    return rows.select(
        F.expr("try_cast(id AS BIGINT)").alias("o_orderkey"), F.col("status").alias("o_orderstatus"), F.col("priority").alias("o_orderpriority"),
        F.expr("try_cast(cents AS BIGINT)").alias("cents"), F.expr("try_cast(customer AS BIGINT)").alias("o_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS qty, l_returnflag FROM lineitem")
def order_lines_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.records(parse_xml(nested_documents(spark, sf_dir)), "line", {"no": "@no", "part": "@part", "qty": "qty", "flag": "flag"})
    return rows.select(
        F.col("doc_id").alias("l_orderkey"), F.col("no").cast("int").alias("l_linenumber"), F.col("part").cast("long").alias("l_partkey"), F.col("qty").cast("long").alias("qty"), F.col("flag").alias("l_returnflag"))


@query("""
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'START_DOCUMENT' AS type, n FROM n UNION ALL SELECT 'END_DOCUMENT', n FROM n UNION ALL SELECT 'START_ELEMENT', 4 * n FROM n
UNION ALL SELECT 'END_ELEMENT', 4 * n FROM n UNION ALL SELECT 'CHARACTERS', 3 * n FROM n""")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_xml(order_documents(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'order' AS name, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'line', count(*) FROM lineitem
UNION ALL SELECT 'qty', count(*) FROM lineitem UNION ALL SELECT 'flag', count(*) FROM lineitem""")
def element_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.name_counts(parse_xml(nested_documents(spark, sf_dir)))


@query("SELECT 2 * count(*) AS n FROM lineitem")
def count_either_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse_xml(nested_documents(spark, sf_dir))
    return N.select_events(events, [S.START_ELEMENT], ["qty", "flag"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, 3 AS depth, count(*) AS children FROM lineitem GROUP BY l_orderkey")
def depth_and_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = N.nodes(parse_xml(nested_documents(spark, sf_dir)))
    return tree.groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.max("depth").alias("depth"), F.max(F.when(F.col("depth") == 1, F.col("children"))).alias("children"))


@query(f"SELECT l_orderkey, l_linenumber AS ordinal, CAST(l_partkey AS VARCHAR) AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE}) AS k FROM lineitem) WHERE k = 2")
def second_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = N.nth_child(N.nodes(parse_xml(nested_documents(spark, sf_dir))), 2).where(F.col("name") == "line")
    return tree.select(F.col("doc_id").alias("l_orderkey"), F.element_at("attributes", "no").cast("int").alias("ordinal"), F.element_at("attributes", "part").alias("part"))


@query("SELECT o_orderkey, o_orderpriority AS text FROM orders")
def child_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.child_text(N.nodes(parse_xml(order_documents(spark, sf_dir))), "order", "priority")
    return found.select(F.col("doc_id").alias("o_orderkey"), "text")


@query("SELECT o_orderkey, length(o_orderpriority) + length(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) AS length FROM orders")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.text_length(parse_xml(order_documents(spark, sf_dir))).withColumnRenamed("doc_id", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse_xml(order_documents(spark, sf_dir)).where((F.col("name") == "order") & (F.element_at("attributes", F.lit("status")) == "F"))
    return events.where(F.col("type") == S.START_ELEMENT).select(F.col("doc_id").alias("o_orderkey"), F.element_at("attributes", F.lit("status")).alias("o_orderstatus"))


@query("SELECT o_orderkey, 'order' AS name, 1 AS seq FROM orders")
def first_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.first_match(parse_xml(order_documents(spark, sf_dir)), F.col("type") == S.START_ELEMENT)
    return found.select(F.col("doc_id").alias("o_orderkey"), "name", "seq")


@query("SELECT l_orderkey, 3 * count(*) + 1 AS starts, 3 * count(*) + 1 AS ends, true AS balanced FROM lineitem GROUP BY l_orderkey")
def start_end_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.balanced(parse_xml(nested_documents(spark, sf_dir), STREAM)).withColumnRenamed("doc_id", "l_orderkey")


@query("SELECT CAST(avg(n) AS DOUBLE) AS mean, CAST(stddev_pop(n) AS DOUBLE) AS deviation FROM (SELECT 8 * count(*) + 4 AS n FROM lineitem GROUP BY l_orderkey)")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = parse_xml(nested_documents(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


@query("SELECT o_orderkey, o_totalprice * 0 + CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders ORDER BY o_orderkey LIMIT 20")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.records(parse_xml(order_documents(spark, sf_dir)), "order", {"id": "@id", "cents": "cents"})
    return rows.select(F.col("id").cast("long").alias("o_orderkey"), F.col("cents").cast("double").alias("cents")).orderBy("o_orderkey").limit(20)


# namespaces

def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in one of two namespaces under one prefix; the inner declaration overrides the outer one for odd regions."""
    n = table(spark, sf_dir, "nation")
    inner = F.when(F.col("n_regionkey") % 2 == 1, ' xmlns:g="urn:odd"').otherwise("")
    xml = F.concat(F.lit('<g:world xmlns="urn:d" xmlns:g="urn:even"><g:nation'), inner, F.lit(' g:name="'), F.col("n_name"), F.lit('" plain="1"><city/></g:nation><g:after/></g:world>'))
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), xml.alias("xml"))


_NS_SQL = """
WITH n AS (SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 1 THEN 'urn:odd' ELSE 'urn:even' END AS u, n_name FROM nation)
SELECT n_nationkey, 'world' AS local_name, 'urn:even' AS uri, CAST(NULL AS VARCHAR) AS name_uri FROM n
UNION ALL SELECT n_nationkey, 'nation', u, u FROM n UNION ALL SELECT n_nationkey, 'city', 'urn:d', NULL FROM n UNION ALL SELECT n_nationkey, 'after', 'urn:even', NULL FROM n"""


_WORLDS = """
WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN 'urn:odd' ELSE 'urn:even' END AS u, c_name FROM customer)
SELECT c_custkey, 'world' AS local_name, 'urn:even' AS uri, CAST(NULL AS VARCHAR) AS name_uri FROM c
UNION ALL SELECT c_custkey, 'customer', u, u FROM c UNION ALL SELECT c_custkey, 'city', 'urn:d', NULL FROM c UNION ALL SELECT c_custkey, 'after', 'urn:even', NULL FROM c"""


def _customers(options: ParserOptions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Customers in one of two namespaces under one prefix: documents with declarations, as many as there are customers."""
        inner = F.when(F.col("c_nationkey") % 3 == 1, ' xmlns:g="urn:odd"').otherwise("")
        xml = F.concat(F.lit('<g:world xmlns="urn:d" xmlns:g="urn:even"><g:customer'), inner, F.lit(' g:name="'), F.col("c_name"), F.lit('" plain="1"><city/></g:customer><g:after/></g:world>'))
        starts = parse_xml(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), xml.alias("xml")), options).where(F.col("type") == S.START_ELEMENT)
        key = "name" if options.dialect == "stream" else "g:name"
        return starts.select(F.col("doc_id").alias("c_custkey"), "local_name", "uri", F.element_at("attributes_with_prefix", F.lit(key))["uri"].alias("name_uri"))

    return run


for _name, _options in (("ns_customers", SYNC), ("ns_customers_stream", STREAM)):
    QUERIES[_name], ORACLE_SQL[_name] = _customers(_options), _WORLDS


def _ns(events: DataFrame, key: str) -> DataFrame:
    starts = events.where(F.col("type") == S.START_ELEMENT)
    return starts.select(F.col("doc_id").cast("int").alias("n_nationkey"), "local_name", "uri", F.element_at("attributes_with_prefix", F.lit(key))["uri"].alias("name_uri"))


@query(_NS_SQL)
def ns_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ns(parse_xml(region_documents(spark, sf_dir), SYNC), "g:name")


@query(_NS_SQL)
def ns_resolve_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ns(parse_xml(region_documents(spark, sf_dir), STREAM), "name")


@query("SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 1 THEN 'urn:odd' ELSE 'urn:even' END AS uri FROM nation WHERE n_regionkey % 2 = 1")
def ns_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_xml(region_documents(spark, sf_dir)).where((F.col("type") == S.END_ELEMENT) & (F.col("local_name") == "nation") & (F.col("uri") == "urn:odd"))
    return e.select(F.col("doc_id").cast("int").alias("n_nationkey"), "uri")


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS stream, 'u' AS sync FROM nation")
def ns_declared_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit('<a b:c="1" xmlns:b="u"/>').alias("xml"))
    a, b = (parse_xml(docs, o).where(F.col("type") == S.START_ELEMENT).select("doc_id", F.element_at("attributes_with_prefix", F.lit(k))["uri"].alias(n)) for o, k, n in ((STREAM, "c", "stream"), (SYNC, "b:c", "sync")))
    return a.join(b, "doc_id").select(F.col("doc_id").cast("int").alias("n_nationkey"), "stream", "sync")


@query("SELECT n_nationkey, 2 AS n FROM nation")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_xml(region_documents(spark, sf_dir)).where((F.col("type") == S.START_ELEMENT) & F.contains("name", F.lit("g:")) & (F.col("depth") == 2) | (F.col("type") == S.START_ELEMENT) & (F.col("name") == "g:none"))
    return e.groupBy(F.col("doc_id").cast("int").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("int").alias("n"))


# lexical matters

@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def cdata_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that holds the end of a section goes in several."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    body = F.replace(F.col("text"), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    docs = d.select("doc_id", F.concat(F.lit("<d><![CDATA["), body, F.lit("]]></d>")).alias("xml"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("type") == S.CDATA, F.struct("seq", "value"))))
    return parse_xml(docs).groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "").alias("text"))


@query("SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def text_roundtrip_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", element("d", escape(F.col("text"))).alias("xml"))
    return parse_xml(docs, STREAM).where(F.col("type") == S.CHARACTERS).select("doc_id", F.col("value").alias("text"))


_SKIPPED = "SELECT o_orderkey, 1 AS starts, 'a' AS name, {0} AS texts FROM orders"


def _skipped(options: ParserOptions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        xml = F.lit('<?xml version="1.0"?><!-- <b> --><?pi x?><a>one<!---->two<?p?> </a><!-->')
        docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))
        e = parse_xml(docs, options)
        return e.groupBy(F.col("doc_id").alias("o_orderkey")).agg(
            F.count_if(F.col("type") == S.START_ELEMENT).cast("int").alias("starts"), F.max("name").alias("name"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == S.CHARACTERS, F.struct("seq", "value")))), lambda x: x["value"]), "|").alias("texts"))

    return run


for _name, _options, _texts in (("comments_pi_skipped", SYNC, "'one|two'"), ("comments_pi_skipped_stream", STREAM, "'onetwo '")):
    QUERIES[_name], ORACLE_SQL[_name] = _skipped(_options), _SKIPPED.format(_texts)


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size, 3 AS starts, 3 AS ends FROM part")
def self_closing_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_xml(node_documents(spark, sf_dir))
    return e.groupBy(F.col("doc_id").alias("p_partkey")).agg(
        F.max(F.when(F.col("type") == S.CHARACTERS, F.col("value"))).alias("name"), F.max(F.when(F.col("name") == "size", F.element_at("attributes", F.lit("v")))).alias("size"),
        F.count_if(F.col("type") == S.START_ELEMENT).cast("int").alias("starts"), F.count_if(F.col("type") == S.END_ELEMENT).cast("int").alias("ends"))


@query("SELECT p_partkey, 'true' AS sync_empty, 'true' AS sync_bare, '' AS stream_empty, CAST(NULL AS VARCHAR) AS stream_bare FROM part")
def boolean_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = node_documents(spark, sf_dir)
    a, b = (parse_xml(docs, o).where((F.col("name") == "part") & (F.col("type") == S.START_ELEMENT)).select("doc_id", F.element_at("attributes", F.lit("small")).alias(f"{o.dialect}_empty"), F.element_at("attributes", F.lit("tested")).alias(f"{o.dialect}_bare")) for o in (SYNC, STREAM))
    return a.join(b, "doc_id").withColumnRenamed("doc_id", "p_partkey")


@query("SELECT o_orderkey, 'x>y' AS sync, CAST(NULL AS VARCHAR) AS stream FROM orders")
def tag_end_in_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit('<a b="x>y"></a>').alias("xml"))
    a, b = (parse_xml(docs, o).where(F.col("type") == S.START_ELEMENT).select("doc_id", F.element_at("attributes", F.lit("b")).alias(o.dialect)) for o in (SYNC, STREAM))
    return a.join(b, "doc_id").withColumnRenamed("doc_id", "o_orderkey")


@query("SELECT o_orderkey, 4 AS events, CAST(NULL AS VARCHAR) AS error, o_orderstatus AS status FROM orders")
def doctype_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE order SYSTEM "order.dtd">'), element("order", F.lit(""), {"status": F.col("o_orderstatus")}))
    e = parse_xml(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml")))
    return e.groupBy(F.col("doc_id").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("int").alias("events"), F.max("error").alias("error"), F.max(F.element_at("attributes", F.lit("status"))).alias("status"))


@query("SELECT p_partkey, p_name || ' é' AS name FROM part")
def other_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of ISO-8859-1; a byte of it is no UTF-8."""
    xml = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'), element("name", F.concat(escape(F.col("p_name")), F.lit(" é"))))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.encode(xml, "ISO-8859-1").alias("xml"))
    e = parse_xml(docs, ParserOptions(encoding="ISO-8859-1"))
    return e.where(F.col("type") == S.CHARACTERS).select(F.col("doc_id").alias("p_partkey"), F.col("value").alias("name"))


@query("SELECT 8 * count(*) + 4 * count(DISTINCT l_orderkey) AS events, CAST(sum(length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) + length(l_returnflag)) AS BIGINT) AS chars FROM lineitem")
def consume_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every document is looked at."""
    return parse_xml(nested_documents(spark, sf_dir)).agg(F.count("type").alias("events"), F.sum(F.when(F.col("type") == S.CHARACTERS, F.length("value")).otherwise(0)).alias("chars"))


# errors

def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order whose fault goes by its key: none, a mismatch, a lone end, unclosed markup, an open element, a declaration."""
    k = F.col("o_orderkey") % 7
    xml = (
        F.when(k == 0, "<a><b>t</b></a>").when(k == 1, "<a><b>t</B></a>").when(k == 2, "</a>").when(k == 3, "<a>t<!-- x").when(k == 4, "<a><b>t</b>")
        .when(k == 5, "<!ELEMENT x><a/>").otherwise("<a/><b c='d").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))


def _first_errors(options: ParserOptions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = parse_xml(faulty_documents(spark, sf_dir), options)
        return e.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.max("error").alias("error"), F.max("seq").alias("last"), F.count_if(F.col("type") == S.END_DOCUMENT).cast("int").alias("ended"))

    return run


_OPEN = "Unexpected end of document. Not all elements were closed."
_ERRORS = {
    "malformed_first_error": (SYNC, [None, "Mismatched closing tag: </B>. Expected </b>.", "Mismatched closing tag: </a>. No open elements.", "Unclosed comment", None, "Unrecognized markup declaration", "Unclosed start tag"], [6, 4, 1, 3, 5, 1, 3]),
    "malformed_first_error_stream": (STREAM, [None, "Mismatched closing tag: </B>. Expected </b>", "Mismatched closing tag: </a>. Expected </nothing>", _OPEN, _OPEN, "Malformed start tag", None], [6, 4, 1, 2, 5, 1, 3]),
    "malformed_first_error_strict": (ParserOptions(strict=True), [None, "Mismatched closing tag: </B>. Expected </b>.", "Mismatched closing tag: </a>. No open elements.", "Unclosed comment", _OPEN, "Unrecognized markup declaration", "Unclosed start tag"], [6, 4, 1, 3, 5, 1, 3]),
}
for _name, (_options, _messages, _last) in _ERRORS.items():
    QUERIES[_name] = _first_errors(_options)
    _m = " ".join(f"WHEN {i} THEN " + (f"'{m}'" if m else "NULL") for i, m in enumerate(_messages))
    _l = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_last))
    _e = " ".join(f"WHEN {i} THEN {int(m is None)}" for i, m in enumerate(_messages))
    ORACLE_SQL[_name] = f"SELECT o_orderkey, CASE o_orderkey % 7 {_m} END AS error, CASE o_orderkey % 7 {_l} END AS last, CASE o_orderkey % 7 {_e} END AS ended FROM orders"


@query("SELECT page_id, 'Malformed start tag' AS error, 2 AS events FROM pages")
def pages_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
    return parse_xml(docs, STREAM).groupBy(F.col("doc_id").alias("page_id")).agg(F.max("error").alias("error"), F.count(F.lit(1)).cast("int").alias("events"))


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '<a [^>]*>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM t WHERE contains(tag, 'href="')""")
def html_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexer only: real pages do not nest well."""
    pieces = table(spark, sf_dir, "pages").select("page_id", F.explode(lex(F.col("html"), "stream")).alias("tag")).where(F.startswith("tag", F.lit("<a ")))
    return pieces.select("page_id", F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("href")).where(F.contains("tag", F.lit('href="')))


# writing

def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to write of an order: a declaration, an element with attributes, children with text, a comment, an empty element."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")

    def e(seq: int, kind: str, name: Column | None = None, value: Column | None = None, attrs: Column | None = None, closing: bool = False) -> Column:
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), (none if name is None else name).cast("string").alias("name"), (none if value is None else value).cast("string").alias("value"),
            (F.lit(None) if attrs is None else attrs).cast(ATTRS).alias("attrs"), F.lit(closing).alias("self_closing"))

    attrs = F.array(F.struct(F.lit("id").alias("name"), F.col("o_orderkey").cast("string").alias("value"), none.alias("prefix")))
    events = F.array(
        e(0, S.START_DOCUMENT), e(1, S.START_ELEMENT, F.lit("order"), attrs=attrs), e(2, S.START_ELEMENT, F.lit("priority")), e(3, S.CHARACTERS, value=F.concat(F.col("o_orderpriority"), F.lit(" & <more>"))),
        e(4, S.END_ELEMENT), e(5, S.COMMENT, value=F.lit("note")), e(6, S.START_ELEMENT, F.lit("empty"), closing=True), e(7, S.START_ELEMENT, F.lit("raw")), e(8, S.CDATA, value=F.lit("<&>")),
        e(9, S.END_DOCUMENT))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(events).alias("e")).select("doc_id", "e.*")
    return rows.withColumn("name", F.when(F.col("seq") == 4, "priority").otherwise(F.col("name")))


_DECL = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>'"
_PRIORITY = "o_orderpriority || ' &amp; &lt;more&gt;'"


@query(f"""SELECT o_orderkey, {_DECL} || '<order id="' || o_orderkey || '"><priority>' || {_PRIORITY} || '</priority><!-- note --><empty/><raw><![CDATA[<&>]]></raw></order>' AS xml FROM orders""")
def write_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_xml(_order_events(spark, sf_dir)).select(F.col("doc_id").alias("o_orderkey"), "xml")


@query(f"""
SELECT o_orderkey, {_DECL} || chr(10) || '<order id="' || o_orderkey || '">' || chr(10) || '  <priority>' || {_PRIORITY} || '</priority>' || chr(10) || '  <!-- note -->' || chr(10) || chr(10)
    || '  <empty/>' || chr(10) || chr(10) || '  <raw><![CDATA[<&>]]></raw>' || chr(10) || '</order>' AS xml FROM orders""")
def write_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_xml(_order_events(spark, sf_dir), WriterOptions(pretty=True)).select(F.col("doc_id").alias("o_orderkey"), "xml")


@query("SELECT o_orderkey, '<o k=\"' || o_orderstatus || '&\"><?sort by=\"key\" ' || o_orderkey || '?><?break?>a & <b></o>' AS xml FROM orders")
def write_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as it is, and processing instructions with and without data."""
    none, o = "cast(NULL AS STRING)", table(spark, sf_dir, "orders")

    def e(seq: int, kind: str, name: str = none, value: str = none, target: str = none, attrs: str = "NULL") -> str:
        return f"named_struct('seq', {seq}L, 'type', '{kind}', 'name', {name}, 'value', {value}, 'target', {target}, 'attrs', cast({attrs} AS {ATTRS}))"

    status = f"array(named_struct('name', 'k', 'value', concat(o_orderstatus, '&'), 'prefix', {none}))"
    events = [
        e(0, S.START_ELEMENT, "'o'", attrs=status), e(1, S.PROCESSING_INSTRUCTION, value="concat('by=\"key\" ', o_orderkey)", target="'sort'"), e(2, S.PROCESSING_INSTRUCTION, target="'break'"),
        e(3, S.CHARACTERS, value="'a & <b>'"), e(4, S.END_DOCUMENT)]
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.expr(f"array({', '.join(events)})")).alias("e")).select("doc_id", "e.*")
    return write_xml(rows, WriterOptions(encode_entities=False)).select(F.col("doc_id").alias("o_orderkey"), "xml")


@query("""SELECT s_suppkey, '<?xml version="1.1" encoding="ISO-8859-1"?><p:s xmlns:p="urn:s" k="v&amp;"><p:t>x</p:t><e/><!-- c --></p:s>' AS xml FROM supplier""")
def write_chained_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a writer, chained, once for every supplier."""
    calls = Calls().start_document("1.1", "iso-8859-1").start_element("s", "p", "urn:s", {"k": "v&"}).start_element("t", "p").characters("x").end_element().start_element("e", self_closing=True).comment("c").end_document()
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    # one document's calls, a known handful of rows, beside each supplier
    rows = suppliers.select("doc_id", F.explode(F.expr(f"sequence(0L, {len(calls.events) - 1}L)")).alias("seq")).join(F.broadcast(calls.frame(spark).drop("doc_id")), "seq")
    return write_xml(rows).select(F.col("doc_id").alias("s_suppkey"), "xml")


def _call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a writer takes or refuses, by key."""
    none = "cast(NULL AS STRING)"
    attrs = "array(named_struct('name', 'k', 'value', 'v', 'prefix', 'p'))"

    def e(seq: int, kind: str, name: str = none, value: str = none, prefix: str = none, uri: str = none, attributes: str = f"cast(NULL AS {ATTRS})") -> str:
        return f"named_struct('seq', {seq}L, 'type', '{kind}', 'name', {name}, 'value', {value}, 'prefix', {prefix}, 'uri', {uri}, 'target', 'pi', 'attrs', {attributes})"

    a, end = e(0, S.START_ELEMENT, "'a'"), e(9, S.END_DOCUMENT)
    cases = [
        [a, e(1, S.CDATA, value="'x]]>y'"), end], [a, e(1, S.COMMENT, value="'a--b'"), end], [a, e(1, S.PROCESSING_INSTRUCTION, value="'a?>b'"), end],
        [a, e(1, S.END_ELEMENT, "'a'"), e(2, S.END_ELEMENT, "'a'")], [a, e(1, S.CHARACTERS, value="'t'"), e(2, S.ATTRIBUTE, "'k'", "'v'")],
        [a, e(1, S.START_ELEMENT, "'b'", attributes=attrs), end],
        [e(0, S.START_ELEMENT, "'a'", prefix="'p'", uri="'u'"), e(1, S.START_ELEMENT, "'b'", attributes=attrs), end],
        [a, e(1, S.NAMESPACE, prefix="'p'", uri="'u'"), e(2, S.ATTRIBUTE, "'k'", "'v'"), e(3, S.START_ELEMENT, "'b'", attributes=attrs), end],
        [a, e(1, S.START_DOCUMENT)], [a, e(1, S.END_DOCUMENT), e(2, S.CHARACTERS, value="'t'")],
    ]
    picked = "CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN array({', '.join(c)})" for i, c in enumerate(cases)) + " END"
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.expr(picked)).alias("e")).select("doc_id", "e.*")


_REFUSED = [
    'CDATA section cannot contain "]]>" sequence.', 'XML comment cannot contain "--" sequence.', 'Processing instruction data cannot contain "?>" sequence.', "No open element to close.",
    "writeAttribute can only be called after writeStartElement.", "Namespace prefix ''p'' is not defined for attribute ''k''", None, None,
    "writeStartDocument can only be called once at the beginning of the document.", "Cannot writeCharacters: Writer is closed or in error state.",
]
_WRITTEN = {6: '<p:a xmlns:p="u"><b p:k="v"></b></p:a>', 7: '<a xmlns:p="u" k="v"><b p:k="v"></b></a>'}


@query(
    "SELECT c_custkey, CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _WRITTEN.items()) + " END AS xml, CASE c_custkey % 10 "
    + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_REFUSED) if m) + " END AS error FROM customer")
def write_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_xml(_call_events(spark, sf_dir)).withColumnRenamed("doc_id", "c_custkey")


@query("""SELECT s_suppkey, '<supplier key="' || s_suppkey || '"><name>' || s_name || '</name><nation>' || s_nationkey || '</nation></supplier>' AS xml FROM supplier""")
def row_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return s.select("s_suppkey", rows_to_xml(s, "supplier", ["key"], ["name", "nation"]).alias("xml"))


@query(_ORDERS.format(""))
def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_documents(spark, sf_dir).withColumnRenamed("doc_id", "l_orderkey")


@query(_ORDERS.format(_DECL + " || "))
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, and written again from the events."""
    return write_xml(writer_events(parse_xml(nested_documents(spark, sf_dir))), check_prefixes=False).select(F.col("doc_id").alias("l_orderkey"), "xml")


@query("SELECT l_orderkey, 8 * count(*) + 4 AS n FROM lineitem GROUP BY l_orderkey")
def roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, written and parsed again. What was written is stored: a parse reads its documents more than once (with and without declarations)."""
    again = stored(write_xml(writer_events(parse_xml(nested_documents(spark, sf_dir))), check_prefixes=False).select("doc_id", "xml"))
    return parse_xml(again, STREAM).groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, '<order id="' || o_orderkey || '" status="' || o_orderstatus || '"><priority>' || o_orderpriority || '</priority><cents>' || CAST(round(o_totalprice * 100) AS BIGINT) || '</cents><customer>' || o_custkey || '</customer></order>' AS xml FROM orders""")
def tree_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as a tree, and the tree written."""
    tree = N.nodes(parse_xml(order_documents(spark, sf_dir)))
    return write_xml(nodes_to_events(tree), check_prefixes=False).select(F.col("doc_id").alias("o_orderkey"), "xml")


@query("SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE '<props>' || coalesce((SELECT string_agg('<' || k || '>' || json_extract_string(props, '$.\"' || k || '\"') || '</' || k || '>', '' ORDER BY k) FROM (SELECT unnest(json_keys(props)) AS k)), '') || '</props>' END AS xml FROM events")
def json_props_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", props_to_xml(F.col("props"), "props").alias("xml"))


@query("""SELECT c_custkey, '<person name="' || c_name || '"><phone>1</phone><phone>2</phone>' || c_mktsegment || '<e></e></person>' AS attributes, '<person><name>' || c_name || '</name><e></e></person>' AS ordered FROM customer""")
def json_trees_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("doc_id"), F.format_string('{"person": {"_name": "%s", "phone": [1, 2], "__text": "%s", "e": {}}}', "c_name", "c_mktsegment").alias("json"))
    b = c.select(F.col("c_custkey").alias("doc_id"), F.format_string('[{"person": [{"name": [{"#text": "%s"}]}, {"e": []}]}]', "c_name").alias("json"))
    x, y = (write_xml(json_to_events(d, form), check_prefixes=False).select("doc_id", F.col("xml").alias(form)) for d, form in ((a, "attributes"), (b, "ordered")))
    return x.join(y, "doc_id").withColumnRenamed("doc_id", "c_custkey")


# sources

@query("SELECT doc_id, text FROM documents")
def chunks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut into chunks of 1000 bytes, joined and decoded again."""
    rows = chunks(table(spark, sf_dir, "documents").withColumnRenamed("text", "xml"), 1000)
    pieces = F.array_sort(F.collect_list(F.struct("chunk_seq", "bytes")))
    joined = rows.groupBy("doc_id").agg(F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p["bytes"])).alias("b"))
    return joined.select("doc_id", decoded(F.col("b")).alias("text"))


_ORDERS_SQL = ORACLE_SQL["orders_extract"]


def _order_rows(events: DataFrame) -> DataFrame:
    rows = N.records(events, "order", {"id": "@id", "status": "@status", "priority": "priority", "cents": "cents", "customer": "customer"})
    return rows.select(
        F.col("id").cast("long").alias("o_orderkey"), F.col("status").alias("o_orderstatus"), F.col("priority").alias("o_orderpriority"), F.col("cents").cast("long").alias("cents"), F.col("customer").cast("long").alias("o_custkey"))


@query(_ORDERS_SQL)
def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 7 bytes, read by the incremental parser."""
    return _order_rows(parse_chunks(chunks(order_documents(spark, sf_dir), 7)))


@query("SELECT s_suppkey, s_name AS name, 'urn:s' AS uri, 'n' || s_nationkey || '&' AS nation FROM supplier")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents as a stream of files, parsed by a stateful query with entities of its own, written to files and read again."""
    s, at = table(spark, sf_dir, "supplier"), shared_folder(spark)
    xml = F.concat(F.lit('<s:supplier xmlns:s="urn:s" s:nation="n'), F.col("s_nationkey"), F.lit('&and;"><name>'), escape(F.col("s_name")), F.lit("</name></s:supplier>"))
    chunks(s.select(F.col("s_suppkey").alias("doc_id"), xml.alias("xml")), 11).repartition(2, F.pmod("chunk_seq", F.lit(2))).write.parquet(f"{at}/chunks")
    events = parse_stream(read_chunk_stream(spark, f"{at}/chunks"), ParserOptions(dialect="stream", entities=(("&and;", "&"),)))
    running = events.writeStream.format("parquet").option("path", f"{at}/events").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    found = spark.read.schema(S.EVENTS).parquet(f"{at}/events")
    starts = F.when((F.col("type") == S.START_ELEMENT) & (F.col("local_name") == "supplier"), F.element_at("attributes_with_prefix", F.lit("nation")))
    return found.groupBy(F.col("doc_id").alias("s_suppkey")).agg(F.max("value").alias("name"), F.max(starts["uri"]).alias("uri"), F.max(starts["value"]).alias("nation"))


@query(f"SELECT doc_id, count(*) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{NAME}+')) AS w FROM documents) GROUP BY doc_id")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could be a name, by the pattern of names."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{NAME}+"), F.lit(0))).alias("w")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))
