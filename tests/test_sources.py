"""Lift vectors: documents and the triples they must give."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import patterns as m
from loomgraph.plans.convert import Adapter, AdapterError, DocumentError, accepts, convert, related
from loomgraph.sources import documents
from loomgraph.sources import nodes as nd
from loomgraph.sources import triples as tr
from loomgraph.streaming import ingest

XYZ, FX, RDF = tr.XYZ, tr.FX, "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def triples(df):
    return {(r["rid"], r["s"], r["p"].removeprefix("I"), r["o"]) for r in df.collect()}


def test_xml_vector(spark):
    text = '<c xmlns:n="urn:n#"><item id="1" n:k="v"> \n<t>A &amp; <![CDATA[B]]></t><!-- x --> tail <n:u/></item><item/></c>'
    got = triples(tr.xml_triples(nd.xml_nodes(docs(spark, text), "item")))
    first = {(p, o) for rid, _, p, o in got if rid == "0/0"}
    assert {(RDF + "type", "I" + XYZ + "item"), (RDF + "type", "I" + FX + "root"), (XYZ + "id", "S1"), ("urn:n#k", "Sv"), (RDF + "type", "Iurn:n#u"), (RDF + "_1", "SA & B"), (RDF + "_2", "S tail ")} <= first
    assert {(p, o[0]) for p, o in first if "_3" in p} == {(RDF + "_3", "B")}
    assert {p for rid, _, p, _ in got if rid == "0/1"} == {RDF + "type"}


def test_nested_records_stay_inside(spark):
    n = nd.xml_nodes(docs(spark, "<r><i><i/></i><i/></r>"), "i")
    assert n.filter("path = '' AND record >= 0").count() == 2
    assert {r["selector"] for r in n.filter("kind = 'element'").collect()} == {"/r", "/r/i[1]", "/r/i[1]/i[1]", "/r/i[2]"}


def test_no_break_space_is_text(spark):
    n = nd.xml_nodes(docs(spark, "<i><a> </a><b> \t</b></i>"), "i")
    assert [r["value"] for r in n.filter("kind = 'text'").collect()] == [" "]


def test_text_content(spark):
    n = nd.xml_nodes(docs(spark, "<i>a<b>c<d>e</d></b>f</i>"), "i")
    got = tr.text_content(n).join(n.select("pos", "name"), "pos").select("name", "text").collect()
    assert {r["name"]: r["text"] for r in got} == {"i": "acef", "b": "ce", "d": "e"}


def test_json_vector(spark):
    text = '{"a": 1.50, "a": "x", "n": null, "b": true, "o": {"k y": []}, "l": [null, {"z": -0}]}'
    got = triples(tr.json_triples(nd.json_nodes(docs(spark, text))))
    assert {(XYZ + "a", "S1.50"), (XYZ + "a", "Sx"), (XYZ + "b", "Strue"), (XYZ + "z", "S-0"), (RDF + "type", "I" + FX + "root")} <= {(p, o) for _, _, p, o in got}
    assert {p for _, _, p, _ in got} >= {XYZ + "k%20y", RDF + "_2"} and not any(p in (XYZ + "n", RDF + "_1") for _, _, p, _ in got)


@pytest.mark.parametrize("text", ["", "{", "1", '"x"', "[NaN]", '{"a": "\\ud800"', "<a>"])
def test_json_refusals(spark, text):
    assert [r["kind"] for r in nd.json_nodes(docs(spark, text)).collect()] == ["error"]


@pytest.mark.parametrize("text", ["", "<a>", "<a/><b/>", "plain", '<!DOCTYPE a [<!ENTITY x "y">]><a>'])
def test_xml_refusals(spark, text):
    assert [r["kind"] for r in nd.xml_nodes(docs(spark, text), "a").collect()] == ["error"]


def test_pointers_are_escaped(spark):
    n = nd.json_nodes(docs(spark, '{"items": [3, {"a/b~c": 1}]}'), "items")
    assert {r["selector"] for r in n.filter("record >= 0").collect()} == {"#/items/1", "#/items/1/a~1b~0c"}


def test_attachments(spark):
    df = spark.createDataFrame([("aGVs\nbG8=",), ("aGVsbG8",), ("////",), (None,)], "v string")
    assert [r[0] for r in df.select(tr.decoded_attachment(F.col("v"))).collect()] == ["hello", None, None, None]


def test_element_breaks(spark):
    df = spark.createDataFrame([("<p> a  b</p><p>\n</p>c",)], "v string")
    assert df.select(tr.element_breaks(F.col("v"), "</?p>")).first()[0] == "a b\nc"


def test_n_triples_round_trip(spark, tmp_path):
    rows = [("1", "Iurn:a", "Iurn:p", 'Sq"\\\n'), ("1", "Bx", "Iurn:p", "Len\0hi"), ("1", "Iurn:a", "Iurn:p", "Thttp://x#d\0v"), ("2", "Bx", "Iurn:p", "Len\0hi")]
    quads = spark.createDataFrame(rows, "rid string, s string, p string, o string")
    tr.write_n_triples(quads, f"{tmp_path}/g")
    back = tr.read_n_triples(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, back.collect())) == sorted({r[1:] for r in rows})
    (tmp_path / "bad.nt").write_text("# fine\n\nno triple\n")
    with pytest.raises(Exception, match="no triple"):
        tr.read_n_triples(spark, f"{tmp_path}/bad.nt").collect()


def adapter(spark):
    def mapping(q):
        found = m.bgp(q, ("?i", tr.TYPE, "I" + FX + "root"), ("?i", "I" + XYZ + "id", "?id"))
        d = F.concat(F.lit("Iurn:draft:"), F.substring("id", 2, 99))
        found = found.withColumn("d", d).withColumn("r", F.lit("Iurn:rec"))
        return found, [("?d", "Ihttp://www.w3.org/ns/prov#specializationOf", "?r"), ("?d", "Iurn:id", "?id")]

    acc = m.values(spark, ["path", "verdict", "gap", "lookup", "miss_gap"], [("/@id", "carried", None, None, None), ("/status", "noHome", "g", "map", "miss")])
    gaps = m.values(spark, ["gap", "kind", "severity"], [("g", "noPredicate", "Warning"), ("miss", "valueNotMapped", None)])
    return Adapter("xml", "item", [mapping], lambda s: s.filter("name = 'item'"), acc, gaps, m.values(spark, ["map", "notation"], [("map", "ok")]), None, m.values(spark, ["p"], [("Iurn:id",)]))


def test_convert(spark):
    table = docs(spark, "<c><item id='1'><status> OK </status><extra/></item><item id='2'><status>bad</status></item></c>", "<broken>", "<c/>")
    got = convert(table, adapter(spark))
    assert {(r["rid"], r["p"], r["o"]) for r in got.graph.collect() if r["p"] == "Iurn:id"} == {("0/0", "Iurn:id", "S1"), ("0/1", "Iurn:id", "S2")}
    found = sorted((r["record"], r["body"], r["severity"], r["value"]) for r in got.findings.filter("body <> 'undeclared'").collect())
    assert found == [(0, "g", "Warning", None), (0, "unaccounted", "Info", None), (1, "g", "Warning", None), (1, "miss", "Info", "bad")]
    assert [r["doc_id"] for r in got.errors.collect()] == [1] and got.names.count() == 3
    assert related(got.graph, got.graph).count() == 0
    assert {r["doc_id"]: r["accepted"] for r in accepts(table, adapter(spark)).collect()} == {0: True, 1: False, 2: False}
    with pytest.raises(DocumentError):
        convert(table, adapter(spark), strict=True)


def test_encodings(spark, tmp_path):
    text = "<?xml version='1.0'?><a>é</a>"
    label = "<?xml version='1.0' encoding='ISO-8859-1'?><a>é</a>"
    rows = [b"\xef\xbb\xbf" + text.encode(), text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), text.encode("utf-16-be"), label.encode("latin-1"), b"<a>\xff</a>", b"<?xml version='1.0' encoding='EBCDIC'?><a/>"]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "v binary")
    assert [r[0] for r in df.select(documents.decoded(F.col("v"))).collect()] == [text, text, text, text, label, None, None]
    assert [r[0] for r in df.limit(2).select(documents.decoded_json(F.col("v"))).collect()] == [None, text]
    (tmp_path / "a.xml").write_bytes(rows[1])
    got = documents.read(spark, str(tmp_path)).first()
    assert got["text"] == text and got["media_type"] == "application/xml" and got["name"].startswith("ni:///sha-256;")


def test_adapters_are_checked(spark):
    with pytest.raises(AdapterError):
        Adapter("csv", "x").checked()
    twice = m.values(spark, ["path", "verdict", "gap", "lookup", "miss_gap"], [("/a", "carried", None, None, None), ("/a", "noHome", None, None, None)])
    with pytest.raises(AdapterError, match="two verdicts"):
        Adapter("xml", "x", accounting=twice).checked()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.xml").write_text(f"<c><item id='{k}'/></c>")
    stream = ingest.documents(spark, f"{tmp_path}/in")
    query = ingest.start(stream, adapter(spark), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    graph = spark.read.parquet(f"{tmp_path}/out/graph")
    assert {r["o"] for r in graph.filter("p = 'Iurn:id'").collect()} == {"S0", "S1", "S2"}


@pytest.mark.parametrize(("text", "good"), [("[" * 512 + "]" * 512, True), ("[" * 513 + "]" * 513, False), ('{"a":' * 2000 + "1" + "}" * 2000, False), ("[" * 100_000, False), ('{"items": ["\\ud800"]}', False), ('{"\\uDFFF": 1}', False), ('["\\ud83d\\ude00 [[["]', True), ('"x"', False), ("[1,]", False)])
def test_a_bad_document_is_one_row(spark, text, good):
    rows = nd.json_nodes(spark.createDataFrame([(1, text), (2, "{}")], "doc_id long, text string")).collect()
    errors = [r for r in rows if r["kind"] == "error"]
    assert [r["doc_id"] for r in errors] == ([] if good else [1]) and any(r["doc_id"] == 2 and r["kind"] == "object" for r in rows)


def test_elements_of_two_namespaces_keep_their_text(spark):
    text = '<r xmlns:a="urn:a" xmlns:b="urn:b"><a:x>1</a:x><b:x>2</b:x><x>3<y>4</y></x></r>'
    n = nd.xml_nodes(spark.createDataFrame([(1, text)], "doc_id long, text string"), "r")
    content = {r["pos"]: r["text"] for r in tr.text_content(n).collect()}
    got = {r["selector"]: content[r["pos"]] for r in n.filter("kind = 'element'").collect()}
    assert got == {"/r": "1234", "/r/*[local-name()='x' and namespace-uri()='urn:a'][1]": "1", "/r/*[local-name()='x' and namespace-uri()='urn:b'][1]": "2", "/r/x[1]": "34", "/r/x[1]/y[1]": "4"}


def test_n_triples_escapes(spark):
    lines = [r'<urn:caf\u00E9> <urn:p> "a\tb\b\n\r\f\"\'\\u0041\U0001F600\u0001"@en .', r'_:x <urn:p> "\\n" .', "# nothing", ""]
    got = sorted(tuple(r) for r in tr.parsed_n_triples(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [("Bx", "Iurn:p", "S\\n"), ("Iurn:café", "Iurn:p", "Len\0a\tb\b\n\r\f\"'\\u0041😀\x01")]


def test_member_names_keep_what_an_iri_may_hold(spark):
    names = ["a b", "é/日", "x\u0080", "😀", "", "~-._", "\ue000"]
    df = spark.createDataFrame([(x,) for x in names], "n string")
    assert [r[0] for r in df.select(tr.percent_encoded(F.col("n"))).collect()] == ["a%20b", "é%2F日", "x%C2%80", "😀", "", "~-._", "%EE%80%80"]


def test_text_content_sends_no_table_to_all_tasks(spark):
    """Files of nodes are far smaller than their rows, so a join that trusts their size fills the driver."""
    n = nd.xml_nodes(docs(spark, "<i>a<b>c</b></i>"), "i")
    assert "Broadcast" not in tr.text_content(n)._jdf.queryExecution().executedPlan().toString()


def test_namespaces_join_sends_no_table_to_all_tasks(spark, sf_dir):
    from loomgraph import catalog

    assert "Broadcast" not in catalog.lift_xml_namespaces(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_only_asked_columns_are_made(spark):
    n = nd.json_nodes(docs(spark, '{"a": [1]}', "["), columns=["kind"])
    assert n.columns == ["doc_id", "kind"] and sorted(map(tuple, n.collect())) == [(0, "array"), (0, "number"), (0, "object"), (1, "error")]
    x = nd.xml_nodes(docs(spark, "<i k='1'>a</i>"), "i", columns=["value", "pos"])
    assert x.columns == ["doc_id", "pos", "value"] and sorted(map(tuple, x.collect())) == [(0, 0, None), (0, 1, "1"), (0, 2, "a")]


@pytest.mark.parametrize("bad", [False, True])
def test_long_documents_go_out_in_blocks(bad):
    text = "<r>" + "<i k='1'>aé</i>" * 100_000 + ("</i>" if bad else "</r>")
    blocks = list(nd.parse_xml(text, "i"))
    assert [len(b) for b in blocks] == [1] if bad else max(map(len, blocks)) < 250_000
    assert [r for b in blocks for r in b][-1][:4] == ((-1, 0, -1, "error") if bad else (99_999, 300_000, 299_998, "text"))


def test_deep_documents_are_dealt_over_tasks(spark, sf_dir):
    from loomgraph import catalog

    assert catalog.dealt_customers(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
