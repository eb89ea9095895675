"""Events of small documents, written down by hand, in both dialects."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.plans.parse import parse_xml
from tagloom.schema import ParserOptions
from tagloom.streaming.incremental import Incremental, parse

OPEN = "Unexpected end of document. Not all elements were closed."
#: (document, events of sync, events of stream); an event is +name, -name, text, [cdata] or !error.
CASES = [
    ("<note>see <em>page 7</em>, below</note>", "+note|see|+em|page 7|-em|, below|-note|.", "+note|see |+em|page 7|-em|, below|-note|."),
    ("<p><q>a</q><q> </q><q></q><q>&lt;b</q ></p>", "+p|+q|a|-q|+q|-q|+q|-q|+q|<b|-q|-p|.", "+p|+q|a|-q|+q|-q|+q|-q|+q|<b|-q|-p|."),
    ("<p><q>a</p></q>", "+p|+q|a|!Mismatched closing tag: </p>. Expected </q>.", "+p|+q|a|!Mismatched closing tag: </p>. Expected </q>"),
    ("<p>x<!-- c -->y<q>z</q><!-- d -->w<![CDATA[k]]>v</p>", "+p|x|y|+q|z|-q|w|[k]|v|-p|.", "+p|xy|+q|z|-q|[k]|wv|-p|."),
    ("<p>x<q>y</q>z<", "+p|x|+q|y|-q|z|!Unclosed start tag", f"+p|x|+q|y|-q|z|!{OPEN}"),
    ("<a><b>1</b><c k='<b>2</b>'>3</c></a>", "+a|+b|1|-b|+c|3|-c|-a|.", "+a|+b|1|-b|+c|2|!Mismatched closing tag: </b>. Expected </c>"),
    ("<a>x<![CDATA[y]]>z</a>", "+a|x|[y]|z|-a|.", "+a|[y]|xz|-a|."),
    ("<a>\n <b/>\n</a>", "+a|+b|-b|-a|.", "+a|+b|-b|-a|."),
    ("<!DOCTYPE r><r/>", "+r|-r|.", "!Malformed start tag"),
    ("<!ELEMENT x><a/>", "!Unrecognized markup declaration", "!Malformed start tag"),
    ("<!--><a/>", "+a|-a|.", "+a|-a|."),
    ("<?><a/>", "+a|-a|.", "+a|-a|."),
    ("<a>", "+a|.", f"+a|!{OPEN}"),
    ("</a>", "!Mismatched closing tag: </a>. No open elements.", "!Mismatched closing tag: </a>. Expected </nothing>"),
    ("<a><b></a>", "+a|+b|!Mismatched closing tag: </a>. Expected </b>.", "+a|+b|!Mismatched closing tag: </a>. Expected </b>"),
    ("<a/><b/>t", "+a|-a|+b|-b|t|.", "+a|-a|+b|-b|t|."),
    ("<a>x<!-- y", "+a|x|!Unclosed comment", f"+a|!{OPEN}"),
    ("x<!-- y", "x|!Unclosed comment", "x|."),
    ("x<![CDATA[ y", "x|!Unclosed CDATA section", "x|."),
    ("x<?y", "x|!Unclosed processing instruction", "x|."),
    ("x<!DOCTYPE", "x|!Unclosed DOCTYPE declaration", "x|."),
    ("x</y", "x|!Unclosed end tag", "x|."),
    ("x<y z='>", "x|!Unclosed start tag", f"x|+y|!{OPEN}"),
    ("<a b='>'></a>", "+a|-a|.", "+a|'>|-a|."),
    ("<a\n></a\n>", "+a\n|!Mismatched closing tag: </a>. Expected </a\n>.", "+a|-a|."),
    ("<é></é>", "+é|-é|.", "!Malformed start tag"),
    ("&amp;lt;&#65;&quot;", '&lt;&#65;"|.', '&lt;&#65;"|.'),
    ("<a> </a>", "+a|-a|.", "+a|-a|."),
    ("", ".", "."),
    (None, ".", "."),
]


def shown(events) -> str:
    out = []
    for e in events:
        get = e.get if isinstance(e, dict) else (lambda k, e=e: e[k])
        kind = get("type")
        out += {"START_ELEMENT": [f"+{get('name')}"], "END_ELEMENT": [f"-{get('name')}"], "CHARACTERS": [get("value")], "CDATA": [f"[{get('value')}]"], "ERROR": [f"!{get('error')}"], "END_DOCUMENT": ["."], "START_DOCUMENT": []}[kind]
    return "|".join(out)


@pytest.mark.parametrize("dialect", ["sync", "stream"])
def test_cases(spark, dialect):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, xml string")
    found: dict[int, list] = {}
    for r in sorted(parse_xml(docs, ParserOptions(dialect=dialect)).collect(), key=lambda r: (r.doc_id, r.seq)):
        found.setdefault(r.doc_id, []).append(r)
    for i, case in enumerate(CASES):
        assert [r.seq for r in found[i]] == list(range(len(found[i])))
        assert found[i][0].type == "START_DOCUMENT"
        assert shown(found[i]) == case[1 if dialect == "sync" else 2], case[0]


def one(spark, xml, **options):
    return parse_xml(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), ParserOptions(**options)).orderBy("seq").collect()


def test_attributes(spark):
    tag = '<a b="" c d = "1" xmlnsx="2" e=\'v w\' b="3" f="&lt;"/>'
    sync, stream = (one(spark, tag, dialect=d)[1].attributes for d in ("sync", "stream"))
    assert sync == {"b": "3", "c": "true", "d": "1", "e": "true", "v": "true", "w": "true", "f": "<"}
    assert stream == {"b": "3", "xmlnsx": "2", "f": "<"}


def test_namespaces(spark):
    xml = '<r xmlns="d" xmlns:p="1"><p:c xmlns:p="2&amp;"><p:d/></p:c><p:e p:k="v" q:k="w" k="x"/></r>'
    for dialect, inner in (("sync", "2&amp;"), ("stream", "2&")):
        rows = [r for r in one(spark, xml, dialect=dialect) if r.name]
        assert [(r.name, r.uri) for r in rows] == [("r", "d"), ("p:c", inner), ("p:d", inner), ("p:d", inner), ("p:c", inner), ("p:e", "1"), ("p:e", "1"), ("r", "d")]
    info = rows[5].attributes_with_prefix
    assert set(info) == {"k"} and info["k"].value == "x"  # the last of one local name
    keyed = one(spark, xml, dialect="sync")[6].attributes_with_prefix
    assert (keyed["p:k"].uri, keyed["q:k"].uri, keyed["k"].uri, keyed["k"].local_name) == ("1", None, None, "k")


def test_options(spark):
    text = [r.value for r in one(spark, "<a>&x;&amp;&lt;</a>", entities=(("&x;", "&lt;"), ("&lt;", "L"), ("", "y"), ("&amp;", "no"))) if r.type == "CHARACTERS"]
    assert text == ["&lt;&L"]
    assert [r.value for r in one(spark, "<a>&amp;</a>", decode_entities=False) if r.value] == ["&amp;"]
    assert one(spark, "<a>", strict=True)[-1].error == OPEN
    assert [r.name for r in one(spark, "<a\tb='1'></a>", strict=True) if r.name] == ["a", "a"]


def test_bytes(spark):
    docs = spark.createDataFrame([(1, bytearray("<a>é</a>".encode("latin-1")))], "doc_id long, xml binary")
    assert [r.value for r in parse_xml(docs, ParserOptions(encoding="ISO-8859-1")).collect() if r.value] == ["é"]


def test_tree_columns(spark):
    rows = one(spark, "<a>t<b><c/></b><b>u</b></a>")
    assert [(r.type[:3], r.name, r.depth, r.node_id, r.parent_id) for r in rows[1:-1]] == [
        ("STA", "a", 1, 1, None), ("CHA", None, 1, 1, None), ("STA", "b", 2, 3, 1), ("STA", "c", 3, 4, 3), ("END", "c", 3, 4, 3), ("END", "b", 2, 3, 1),
        ("STA", "b", 2, 7, 1), ("CHA", None, 2, 7, 1), ("END", "b", 2, 7, 1), ("END", "a", 1, 1, None)]


def test_long_pieces_do_not_overflow(spark):
    xml = "<a b='" + "x" * 300_000 + "' c=\"" + "y>" * 100_000 + '"><![CDATA[' + "z" * 300_000 + "]]>" + "t" * 300_000 + "</a>"
    assert [r.type for r in one(spark, xml)][1:-1] == ["START_ELEMENT", "CDATA", "CHARACTERS", "END_ELEMENT"]


PIECES = st.sampled_from(["<a>", "</a>", "<b/>", "<p:c xmlns:p='u' p:k=\"v\">", "</p:c>", "t", " ", "é€😀", "<!-- x -->", "<![CDATA[<y>]]>", "<?pi?>", "&amp;", "<", "<!", "<!-", "<![CD", "]]>", "-->", ">"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14), st.lists(st.integers(1, 7), min_size=1, max_size=40))
def test_chunks_do_not_matter(pieces, sizes):
    data = "".join(pieces).encode()
    parser, out, at, k = Incremental(), [], 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out += parser.feed(data[at : at + n], at + n >= len(data))
        at, k = at + n, k + 1
    if not data:
        out += parser.feed(b"", True)
    assert out == parse("".join(pieces))


def test_incremental_is_the_stream_dialect(spark):
    import random

    rng = random.Random(5)
    pieces = ["<a>", "</a>", "<b/>", '<p:c xmlns:p="u" p:k="v">', "</p:c>", "t", " ", "é😀", "<!-- x -->", "<![CDATA[<y>]]>", "<?pi?>", "&amp;", "<", "<!-", "]]>", ">", "<d"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    found: dict[int, list] = {}
    for r in parse_xml(docs, ParserOptions(dialect="stream")).orderBy("doc_id", "seq").collect():
        found.setdefault(r.doc_id, []).append(tuple(r[c] for c in ("seq", "type", "name", "local_name", "prefix", "uri", "value", "error", "depth", "node_id", "parent_id")) + (r.attributes,))
    for i, t in enumerate(texts):
        want = [tuple(e.get(c) for c in ("seq", "type", "name", "local_name", "prefix", "uri", "value", "error", "depth", "node_id", "parent_id")) + (e.get("attributes"),) for e in parse(t)]
        assert found[i] == want, t


def test_element_names_and_columns(spark):
    rows = one(spark, "<a>t<b>u</b><c/><!-- x -->v</a>")
    assert [(r.type[:3], r.element, r.seq, r.node_id, r.parent_id) for r in rows[1:-1]] == [
        ("STA", "a", 1, 1, None), ("CHA", "a", 2, 1, None), ("STA", "b", 3, 3, 1), ("CHA", "b", 4, 3, 1), ("END", "b", 5, 3, 1), ("STA", "c", 6, 6, 1), ("END", "c", 7, 6, 1),
        ("CHA", "a", 8, 1, None), ("END", "a", 9, 1, None)]


def test_many_pieces_in_one_run_and_many_tags_on_one_level(spark):
    began = time.time()
    pieces = "<a>" + "x<!-- y -->" * 40_000 + "</a>"
    rows = one(spark, pieces, dialect="stream")
    assert [r.value for r in rows if r.value] == ["x" * 40_000]
    wide = '<a xmlns:p="u">' + "<p:b></p:b>" * 40_000 + "</a>"
    assert {r.uri for r in one(spark, wide) if r.name == "p:b"} == {"u"}
    assert time.time() - began < 60


OPTIONS = ParserOptions(dialect="stream", entities=(("&co;", "A & B"), ("&nl;", " ")))


def test_stream_options_are_those_of_the_plan(spark):
    texts = [
        '<r xmlns="d" xmlns:p="1"><p:c xmlns:p="2&amp;" p:k="v" q:k="w" k="&co;"/>&co;&lt;<p:e p:k="&nl;" late:x="1" xmlns:late="3"/>&nl;</r>', "<a>&amp;lt;</a>", "﻿<a>é</a>", "<a>&nl;<b/></a>", "plain &co;"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    for options in (OPTIONS, ParserOptions(dialect="stream", decode_entities=False), ParserOptions(dialect="stream", namespaces=False)):
        plan: dict[int, list] = {i: [] for i in range(len(texts))}
        for r in parse_xml(docs, options).orderBy("doc_id", "seq").collect():
            plan[r.doc_id].append(r.asDict(True))
        for i, t in enumerate(texts):
            got = parse(t, options)
            assert len(got) == len(plan[i])
            for e, r in zip(got, plan[i], strict=True):
                for c in ("seq", "type", "name", "uri", "value", "attributes", "attributes_with_prefix", "depth", "node_id", "parent_id", "element"):
                    assert e.get(c) == r[c], (t, c)
    whole = Incremental().feed("<a>é</a>".encode("utf-16"), True, ParserOptions(dialect="stream", encoding="utf-16"))
    assert [e.get("value") for e in whole if e.get("value")] == ["é"]


def test_a_token_that_does_not_end_is_not_searched_again():
    began, parser, out = time.process_time(), Incremental(), []
    for k in range(4000):
        out += parser.chunk(k, b"<a><![CDATA[" if not k else b"x]" * 1000, False)
    out += parser.chunk(4000, b"]></a>", True)
    assert [e["type"] for e in out] == ["START_DOCUMENT", "START_ELEMENT", "CDATA", "END_ELEMENT", "END_DOCUMENT"] and len(out[2]["value"]) == 2000 * 3999 - 1
    assert time.process_time() - began < 5
