"""Readers, writers, the store, and streams."""

from pyspark.sql import functions as F

from lectern.sources import papers_xml as P
from lectern.sources import records as S

JATS = """<?xml version="1.0"?><article><front><article-meta><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>On cats</article-title></title-group>
<contrib-group><contrib><name><surname>Smith</surname><given-names>Ann</given-names></name><xref ref-type="aff" rid="a1"/></contrib></contrib-group><aff id="a1">Uni</aff>
<pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date pub-type="epub"><year>2000</year></pub-date></article-meta></front>
<body><sec><title>Intro</title><p>As said <xref ref-type="bibr" rid="B1">1</xref> &amp; more.</p></sec></body>
<back><ref-list><ref id="B1"><element-citation publication-type="journal"><person-group><name><surname>Doe</surname></name></person-group><article-title>Dogs</article-title><source>J</source><year>1999</year></element-citation></ref></ref-list></back></article>"""
SCI = '<PAPER><TITLE>T</TITLE><BODY><DIV><HEADER>H</HEADER><P><S AZ="OWN">One <REF REFID="R1">x</REF> two.</S><S AZ="BKG">Three.</S></P></DIV></BODY><REFERENCELIST><REFERENCE ID="R1"><SURNAME>Roe</SURNAME><TITLE>U</TITLE></REFERENCE></REFERENCELIST></PAPER>'


def test_jats():
    d = P.parse(JATS, "a.xml")
    assert (d["dialect"], d["title"], d["year"], d["doi"]) == ("jats", "On cats", "2000", "10.1/x")
    assert d["authors"] == [{"given": "Ann", "family": "Smith", "affiliation": "Uni"}]
    assert d["refs"][0]["title"] == "Dogs" and d["refs"][0]["surnames"] == ["Doe"] and d["citations"] == [{"cit_id": "cit0", "ref_id": "B1", "elem_id": "p1"}]
    assert [e["text"] for e in d["elements"] if e["elem_type"] == "p"] == ["As said <CIT ID=cit0/> & more."]


def test_scixml_round_trip(spark):
    d = P.parsed(spark.createDataFrame([("b.xml", SCI), ("c.xml", None), ("d.xml", "<article><body>"), ("e.xml", "plain")], "name string, xml string"))
    rows = {r["dialect"] or r["error"]: r for r in d.collect()}
    assert rows["azscixml"]["elements"][2]["zone"] == "OWN" and rows["azscixml"]["refs"][0]["title"] == "U"
    assert rows["empty"]["elements"] == [] and "not well-formed" in rows["jats"]["error"] and rows["unknown dialect"]
    xml = P.to_scixml(P.exploded(d.where("dialect = 'azscixml'"), "elements")).first()["xml"]
    again = P.parse(xml, "b.xml")
    assert [e["text"] for e in again["elements"] if e["elem_type"] == "s"] == ["One  two.", "Three."] or '<S AZ="OWN">One <REF ID="cit0"/> two.</S>' in xml


def test_record_readers(spark):
    t = spark.createDataFrame([("id = {A1}\nauthor = {X;Y}\ntitle = {T}\nvenue = {V}\nyear = {1999}\n\nid = {A2}\ntitle = {U}\n",)], "value string")
    assert [(r["id"], r["author"], r["title"], r["year"]) for r in S.bibliography(t).collect()] == [("A1", "X;Y", "T", "1999"), ("A2", None, "U", None)]
    e = spark.createDataFrame([("A ==> B",), ("a ==> b",), ("x y",)], "value string")
    assert [tuple(r) for r in S.edges(e).collect()] == [("a", "b")]
    a = spark.createDataFrame([(0, "#ID: q1"), (1, "#WORDS x"), (2, "#KEYWORDS: cat, dog"), (3, "#KEYWORDS: cat")], "n int, value string")
    assert sorted(tuple(r) for r in S.annotations(a, "n").collect()) == [("q1", 1, "cat"), ("q1", 1, "dog"), ("q1", 2, "cat")]
    c = spark.createDataFrame([(0, "a"), (1, "</doc>"), (2, "b")], "n int, value string")
    assert sorted((r["doc_no"], r["text"]) for r in S.split_collection(c, "n").collect()) == [(0, "a\n</doc>"), (1, "b")]
    s = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "doc string, ord int")
    x = spark.createDataFrame([("d", 1, "OWN"), ("d", 2, "BKG"), ("e", 1, "A"), ("e", 2, "B")], "doc string, ord int, label string")
    assert sorted((r["doc"], r["ord"], r["label"]) for r in S.positional_labels(s, x).collect()) == [("d", 1, "OWN"), ("d", 2, "BKG"), ("e", 1, "")]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "id int, v string, w string")
    assert sorted(map(tuple, S.upsert(old, new, "id").collect())) == [(1, "a", "x"), (2, None, "z"), (3, "c", "q")]
    assert sorted(map(tuple, S.upsert(old, new, "id", partial=True).select("id", "v", "w").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    assert S.delete(old, new, "id").count() == 1 and S.insert_missing(old, new, "id").count() == 3
    for kind in ("csv", "tsv", "json", "jsonl.gz", "orc", "parquet"):
        S.export(old, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "jsonl.gz")).count() == 2
    (tmp_path / "w.tsv").write_text("cls\ttitle\tbody\nOWN\t1\t2.5\n")
    assert sorted(map(tuple, S.weights_table(spark, str(tmp_path / "w.tsv")).collect())) == [("OWN", "body", 2.5), ("OWN", "title", 1.0)]


def test_streaming_ingest(spark, tmp_path):
    from lectern.streaming import ingest

    docs = spark.createDataFrame([("d1", "cat cat"), ("d2", "dog")], "guid string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.postings_sink(ingest.stream_table(spark, str(tmp_path / "in")), "guid", ["text"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r["term"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("cat", 2), ("dog", 1)]
    ev = spark.createDataFrame([(1, "2020-01-01 00:10:00", 2.0), (1, "2020-01-01 00:20:00", 3.0), (1, "2020-01-01 03:00:00", 1.0)], "u int, t string, v double").withColumn("t", F.to_timestamp("t"))
    ev.write.parquet(str(tmp_path / "ev"))
    s = ingest.windowed(ingest.stream_table(spark, str(tmp_path / "ev")), "t", ["u"], "v")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.sql("select * from w").collect()) == [(1, 1.0), (2, 5.0)]
    assert sorted(r["n"] for r in ingest.sessions(ev, "t", "u").collect()) == [1, 2]
