from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.udtf import register
from tagloom.sources.documents import CHUNKS, chunks, decoded, read_chunk_stream, read_files, read_records
from tagloom.streaming.incremental import parse, parse_chunks, parse_stream


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf<a>\xff</a>")
    (tmp_path / "b.xml").write_bytes("<a>é</a>".encode())
    assert sorted(r.xml for r in read_files(spark, str(tmp_path)).collect()) == ["<a>é</a>", "<a>�</a>"]
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin/c.xml").write_bytes("<a>é</a>".encode("latin-1"))
    assert read_files(spark, str(tmp_path / "latin"), "ISO-8859-1").first().xml == "<a>é</a>"
    assert spark.range(1).select(decoded(F.lit(b"x")).alias("x")).first().x == "x"


def test_records(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<l><b id='1'><t>x</t></b><b id='2'><t>007</t></b></l>")
    rows = read_records(spark, str(tmp_path / "r.xml"), "b", "_id string, t string").collect()
    assert sorted((r._id, r.t) for r in rows) == [("1", "x"), ("2", "007")]


def test_stream_of_chunks(spark, tmp_path):
    texts = ["<a>é<b k=\"v\">t</b><!-- c --><![CDATA[z]]></a>", "<a><b></a>", "", "<a>open", "<x xmlns:p='u'/>" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    rows = chunks(docs, 3).orderBy(F.xxhash64("doc_id", "chunk_seq")).collect()  # out of order, over several batches
    for i in range(4):
        spark.createDataFrame([tuple(r) for r in rows[i::4]], CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    path = str(tmp_path / "in" / "*")
    q = parse_stream(read_chunk_stream(spark, path)).writeStream.format("memory").queryName("chunk_events").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got: dict[int, list] = {}
    for r in spark.table("chunk_events").orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.type, r.name, r.value, r.error, r.depth, r.node_id, r.parent_id))
    for i, t in enumerate(texts):
        assert got[i] == [tuple(e.get(c) for c in ("seq", "type", "name", "value", "error", "depth", "node_id", "parent_id")) for e in parse(t)]


def test_udtf(spark):
    register(spark)
    rows = spark.sql("SELECT e.type, e.name FROM VALUES ('<a/>') d(xml), LATERAL xml_events(d.xml) e").collect()
    assert [(r.type, r.name) for r in rows] == [("START_DOCUMENT", None), ("START_ELEMENT", "a"), ("END_ELEMENT", "a"), ("END_DOCUMENT", None)]


def test_a_table_of_chunks_is_read_in_streams(spark):
    """No call a document; chunks out of order, again, missing, empty, without number or behind the end; a document without id."""
    texts = ["<a>é<b k=\"v\">t</b><!-- c --><![CDATA[z]]></a>", "<a><b></a>", "", "<a>open", "<x xmlns:p='u'/>" * 5, "<a>" + "long " * 4000 + "</a>"]
    docs = spark.createDataFrame([(i if i else None, texts[i % 6]) for i in range(60)], "doc_id long, xml string")
    rows = [tuple(r) for r in chunks(docs, 3).collect()]
    odd = [(1, None, bytearray(b"<z>"), False), (1, 0, bytearray(b"<a>"), False), (1, 99, bytearray(b"<z>"), True), (77, 1, bytearray(b"<a/>"), True), (78, 0, None, None), (78, 1, bytearray(b"<a/>"), True)]
    table = spark.createDataFrame(sorted(rows, key=lambda r: hash((r[0], r[1])) % 1009) + odd, CHUNKS)
    for given, more in ((table.repartition(4, "chunk_seq"), {78: "<a/>"}), (chunks(docs, 3), {})):
        events = parse_chunks(given)
        assert "FlatMapGroups" not in events._jdf.queryExecution().executedPlan().toString()
        got: dict = {}
        for r in events.collect():
            got.setdefault(r.doc_id, []).append(tuple(r.asDict(True).values())[1:])
        for i, t in ({i if i else None: texts[i % 6] for i in range(60)} | more).items():
            assert sorted(got.pop(i), key=lambda e: e[0]) == [tuple(e[c] for c in events.columns[1:]) for e in parse(t)]
        assert not got
