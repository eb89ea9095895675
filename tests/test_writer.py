"""Documents that the writer gives, written down by hand."""

from __future__ import annotations

import random
from xml.etree import ElementTree
from xml.etree.ElementTree import canonicalize

from tagloom import schema as S
from tagloom.operators.nodes import nodes
from tagloom.plans.calls import Calls
from tagloom.plans.parse import parse_xml
from tagloom.plans.write import ATTRS, nodes_to_events, write_xml, writer_events
from tagloom.schema import WriterOptions

SCHEMA = f"doc_id long, seq long, type string, name string, prefix string, uri string, value string, target string, attrs {ATTRS}, self_closing boolean"


def events(*calls):
    rows = []
    for i, (kind, kw) in enumerate(calls):
        rows.append((1, i, kind, *(kw.get(k) for k in ("name", "prefix", "uri", "value", "target", "attrs")), kw.get("self_closing", False)))
    return rows


def start(name, **kw):
    return S.START_ELEMENT, {"name": name, **kw}


def end(name):
    return S.END_ELEMENT, {"name": name}


def chars(x):
    return S.CHARACTERS, {"value": x}


DONE = (S.END_DOCUMENT, {})


def written(spark, calls, **options):
    return write_xml(spark.createDataFrame(events(*calls), SCHEMA), WriterOptions(**options)).first()


def test_compact(spark):
    calls = [
        (S.START_DOCUMENT, {"value": "1.1", "target": "ascii"}), start("a", attrs=[("k", '<"', None), ("l", None, None)]), (S.ATTRIBUTE, {"name": "m", "value": "&", "prefix": "q"}),
        (S.NAMESPACE, {"prefix": "", "uri": "u"}), start("b", prefix="p", uri="v"), chars("x'>"), end("b"), (S.PROCESSING_INSTRUCTION, {"target": "t", "value": "d"}), (S.PROCESSING_INSTRUCTION, {"target": "t"}),
        start("c", self_closing=True), start("e"), DONE]
    calls[6] = (S.END_ELEMENT, {"name": "b", "prefix": "p"})
    r = written(spark, calls)
    assert r.error is None
    assert r.xml == '<?xml version="1.1" encoding="ASCII"?><a k="&lt;&quot;" l="" q:m="&amp;" xmlns="u"><p:b xmlns:p="v">x&apos;&gt;</p:b><?t d?><?t?><c/><e></e></a>'


def test_pretty(spark):
    calls = [(S.START_DOCUMENT, {}), start("a"), start("b"), chars("t"), end("b"), (S.COMMENT, {"value": "c"}), (S.PROCESSING_INSTRUCTION, {"target": "p"}), start("s", self_closing=True), start("m"), chars("x"), start("i"), end("i"), start("j"), end("j"), end("m"), DONE]
    assert written(spark, calls, pretty=True, indent="\t").xml == (
        '<?xml version="1.0" encoding="UTF-8"?>\n<a>\n\t<b>t</b>\n\t<!-- c -->\n\n\t<?p?>\n\n\t<s/>\n\n\t<m>x<i></i>\n\t\t<j></j></m>\n</a>')


def test_first_event_is_not_indented(spark):
    assert written(spark, [start("a"), DONE], pretty=True).xml == "<a></a>"


def test_entities(spark):
    assert written(spark, [start("a"), chars("a.b&c"), DONE], entities=((".", "&dot;"), ("&", "no"), ("", "x"))).xml == "<a>a&dot;bnoc</a>"
    assert written(spark, [start("a"), chars("<&"), DONE], encode_entities=False).xml == "<a><&</a>"


def test_calls(spark):
    calls = Calls().start_document().start_element("a", attributes={"k": "v"}).namespace("p", "u").attribute("l", "w", "p").start_element("b", prefix="p", attributes={"m": ("x", "p")}).characters("<").end_element()
    calls = calls.comment("c").processing_instruction("t", "d").start_element("s", self_closing=True).cdata("z").end_element().end_document()
    assert write_xml(calls.frame(spark)).first().xml == '<?xml version="1.0" encoding="UTF-8"?><a k="v" xmlns:p="u" p:l="w"><p:b p:m="x">&lt;</p:b><!-- c --><?t d?><s/><![CDATA[z]]></a>'
    assert write_xml(Calls().end_element().frame(spark)).first().error == "No open element to close."


def test_not_ended(spark):
    assert written(spark, [start("a"), start("b"), chars("t")]).xml == "<a><b>t"


def test_errors(spark):
    cases = {
        "writeStartDocument can only be called once at the beginning of the document.": [start("a"), (S.START_DOCUMENT, {})],
        "No open element to close.": [start("a"), end("a"), end("a")],
        "Cannot writeStartElement: Writer is closed or in error state.": [start("a"), DONE, start("b")],
        "writeNamespace can only be called after writeStartElement.": [(S.NAMESPACE, {"prefix": "p", "uri": "u"})],
        "Namespace prefix 'p' is not defined for attribute 'k'": [start("a", prefix="p", uri="u", self_closing=True), start("b", attrs=[("k", "v", "p")])],
        'CDATA section cannot contain "]]>" sequence.': [start("a"), (S.CDATA, {"value": "]]>"}), (S.COMMENT, {"value": "--"})],
    }
    for message, calls in cases.items():
        r = written(spark, calls)
        assert (r.xml, r.error) == (None, message)


def generate(rng, depth=0):
    name = rng.choice(["a", "b", "c-d"])
    attrs = "".join(f' {k}="{rng.choice(["1", "&lt;", "é"])}"' for k in rng.sample(["x", "y", "z"], rng.randint(0, 2)))
    inner = "".join(rng.choice(["t", "&amp;u", "é"]) if rng.random() < 0.3 else generate(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else ""
    return f"<{name}{attrs}>{inner}</{name}>"


def test_round_trip(spark):
    rng = random.Random(3)
    texts = [generate(rng) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    back = {r.doc_id: r for r in write_xml(writer_events(parse_xml(docs).where("type <> 'START_DOCUMENT'")), check_prefixes=False).collect()}
    for i, t in enumerate(texts):  # attribute order is free
        assert canonicalize(back[i].xml) == canonicalize(t)
    again = {r.doc_id: r.xml for r in write_xml(writer_events(parse_xml(spark.createDataFrame([(i, r.xml) for i, r in back.items()], "doc_id long, xml string")).where("type <> 'START_DOCUMENT'")), check_prefixes=False).collect()}
    assert again == {i: r.xml for i, r in back.items()}
    tree = nodes(parse_xml(docs))
    from_tree = {r.doc_id: r.xml for r in write_xml(nodes_to_events(tree), check_prefixes=False).collect()}
    for i, t in enumerate(texts):
        assert canonicalize(from_tree[i]) == canonicalize(text_first(t))


def text_first(xml):
    """The document with each element's text before its children: what a tree keeps."""

    def moved(e):
        e.text = "".join([e.text or "", *(c.tail or "" for c in e)])
        for c in e:
            c.tail = None
            moved(c)
        return e

    return ElementTree.tostring(moved(ElementTree.fromstring(xml)), encoding="unicode")


def test_documents_close_what_is_open(spark):
    deep = 300
    rows = [(1, k, "START_ELEMENT", f"e{k}", None) for k in range(deep)] + [(1, deep, "END_DOCUMENT", None, None)]
    rows += [(2, 0, "START_ELEMENT", "a", None), (2, 1, "START_ELEMENT", "b", None), (2, 2, "END_ELEMENT", "b", None), (2, 3, "START_ELEMENT", "b", None), (2, 4, "CHARACTERS", None, "t"), (2, 5, "END_DOCUMENT", None, None)]
    rows += [(3, 0, "START_ELEMENT", "a", None), (3, 1, "END_ELEMENT", "a", None), (3, 2, "END_DOCUMENT", None, None), (3, 3, "END_ELEMENT", "a", None)]
    rows += [(4, 0, "START_ELEMENT", "a", None), (4, 1, "START_ELEMENT", "b", None)]  # no end: nothing is closed
    got = {r.doc_id: r for r in write_xml(spark.createDataFrame(rows, "doc_id long, seq long, type string, name string, value string")).collect()}
    assert got[1].xml == "".join(f"<e{k}>" for k in range(deep)) + "".join(f"</e{k}>" for k in reversed(range(deep)))
    assert got[2].xml == "<a><b></b><b>t</b></a>"
    assert (got[3].xml, got[3].error) == (None, "No open element to close.")
    assert got[4].xml.startswith("<a><b")
