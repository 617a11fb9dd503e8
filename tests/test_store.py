"""The store, citation parsers' XML, writers, stemming and contexts."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.stem import stem, stemmed
from lectern.operators import contexts as C
from lectern.operators import formulas as E
from lectern.operators import references as J
from lectern.operators import reports as A
from lectern.sources import citation_xml as P
from lectern.sources import store as S

SCI = '<PAPER><TITLE>{t}</TITLE><BODY><DIV><HEADER>H</HEADER><P><S AZ="OWN">One <REF REFID="R1">x</REF>.</S></P></DIV></BODY><REFERENCELIST><REFERENCE ID="R1"><SURNAME>Roe</SURNAME><TITLE>{c}</TITLE></REFERENCE></REFERENCELIST></PAPER>'


def one(spark, sql, *columns):
    return spark.sql(f"SELECT {sql}").select(*columns).first()


@pytest.mark.parametrize("word,want", [("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("generate", "generat"), ("hopping", "hop"), ("hoped", "hope"), ("flies", "fli"), ("dying", "die"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("news", "news"), ("communism", "communism"), ("agreed", "agre"), ("by", "by")])
def test_stems(word, want):
    assert stem(word) == want


def test_stemming_keeps_markers_and_nulls(spark):
    t = spark.createDataFrame([(["running", "__cit1"],), (None,)], "w array<string>").select(stemmed("w").alias("s")).collect()
    assert [r["s"] for r in t] == [["run", "__cit1"], None]


def test_text_scalars(spark):
    t = spark.createDataFrame([("He met Dr. Smith et al. here. “Then” he left! It was 5.",), (None,)], "t string").select(X.sentence_split("t").alias("s")).collect()
    assert t[0]["s"] == ["He met Dr. Smith et al. here.", "“Then” he left!", "It was 5."] and t[1]["s"] == []
    c = spark.createDataFrame([("(Smith and Jones, 2001a)",), ("Smith et al. (1999)",), ("Roe 2004",), ("x",)], "c string")
    a, y = X.parse_citation("c")
    assert [(r["a"], r["y"]) for r in c.select(a.alias("a"), y.alias("y")).collect()] == [(["Smith", "Jones"], "2001a"), (["Smith"], "1999"), (["Roe"], "2004"), (["x"], None)]
    n = spark.createDataFrame([("SMITH",), ("VAN DYKE",), ("roe",)], "n string").select(X.normal_case("n").alias("n")).collect()
    assert [r["n"] for r in n] == ["Smith", "van Dyke", "Roe"]
    assert one(spark, "array('SMITH', 'Roe', 'Lu') AS s", X.apa_authors(F.col("s")).alias("a"))["a"] == "Smith, Roe & Lu"
    assert one(spark, "'g' AS g", X.cache_key("bow", "g", 1, "x").alias("k"))["k"] == "bow_g_1_x" and one(spark, "'g' AS g", X.as_list("g").alias("k"))["k"] == ["g"]


def test_import_links_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, title, cites in (("a", "On cats", "On dogs"), ("b", "On dogs", "Elsewhere")):
        (tmp_path / "in" / f"{name}.xml").write_text(SCI.format(t=title, c=cites).replace("<TITLE>" + title, "<AUTHOR><SURNAME>Roe</SURNAME></AUTHOR><TITLE>" + title, 1))
    p = S.import_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), "i1", "c1")
    rows = {r["norm_title"]: r for r in p.collect()}
    assert rows["on cats"]["num_in_collection_references"] == 1 and rows["on dogs"]["num_inlinks"] == 1 and rows["on cats"]["num_references"] == 1
    assert S.import_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), "i2", "c1").count() == 2
    assert S.random_files(spark.createDataFrame([(f"f{i}",) for i in range(5)], "name string"), "name", 20, 3).count() == 20
    assert set(S.create_tables(spark, str(tmp_path / "t"))) == set(S.SCHEMAS)


def test_store_lookups(spark):
    p = spark.createDataFrame([("g1", "a", [1]), ("g2", "b", [2])], "guid string, title string, inlinks array<int>")
    assert [r["title"] for r in S.metadata_of(p, ["G1, g9"]).collect()] == ["a"] and "inlinks" not in S.metadata_of(p, ["g1"]).columns
    assert S.query(spark, {"p": p}, "SELECT title FROM p WHERE guid = 'g2'").first()["title"] == "b" and len(list(S.stream(p, ["guid"]))) == 2
    assert [r["guid"] for r in S.subset(p, ["guid"], [1]).collect()] == ["g2"] and S.scan(p, ["guid"], 1).count() == 1
    e = S.exclude(spark.createDataFrame([], S.SCHEMAS["exclusions"]), "x", spark.createDataFrame([("g2", ["A"], ["g1"])], "guid string, authors array<string>, guids_from array<string>"))
    links = spark.createDataFrame([("g1", "g2"), ("g3", "g2")], "guid_from string, guid_to string")
    assert [r["guid_from"] for r in S.excluded_links(links, e, "x").collect()] == ["g3"]
    items = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert S.second_annotator(items, items.where("query_id = 2")).first()["query_id"] == 2


def test_references_of_other_kinds(spark):
    t = spark.createDataFrame([("<mixed-citation>Doe J, inventors; Acme assignee. Fast cats. US patent 123 2001. x.</mixed-citation>",), ("<mixed-citation>Roe A. On dogs. Press 1999.</mixed-citation>",), (None,)], "t string")
    rows = t.select(*[c.alias(k) for k, c in S.patent_reference("t").items()]).collect()
    assert (rows[0]["kind"], rows[0]["title"], rows[0]["year"]) == ("patent", "Fast cats", "2001") and (rows[1]["kind"], rows[1]["title"], rows[1]["year"]) == ("other", "On dogs", "1999") and rows[2]["kind"] is None
    c = spark.createDataFrame([("Smith,J.(2001)Title.InProceedings of X",)], "t string").select(S.cleaned_references("t").alias("c")).first()["c"]
    assert c == "Smith, J.(2001) Title. In Proceedings of X"
    xml = "<algorithm><citationList><citation><authors><author>J. Smith</author></authors><title>On cats, In Proc of X</title><date>2001</date></citation><citation><journal>Dogs at large</journal></citation></citationList></algorithm>"
    r = P.parsed_references(spark.createDataFrame([("a", xml), ("b", "no"), ("c", None)], "name string, xml string")).orderBy("number").collect()
    assert [(x["title"], x["journal"], x["surnames"]) for x in r] == [("On cats", "Proc of X", ["Smith"]), ("Dogs at large", "", [])]


def test_documents_as_xml_and_html(spark):
    e = spark.createDataFrame([("g", 0, "section", "Intro", ""), ("g", 1, "p", None, "As <CIT ID=cit0/> & so")], "guid string, ord int, elem_type string, header string, text string")
    assert P.to_jats(e, spark.createDataFrame([("g", "T", "2001")], "guid string, title string, year string")).first()["xml"].count('<xref ref-type="bibr" rid="cit0"/> &amp; so</p>') == 1
    h = P.to_html(e, {"section": lambda: F.upper("header")}, spark.createDataFrame([("g", "R1", "Roe")], "guid string, ref_id string, text string")).first()["html"]
    assert h.startswith("INTRO\n<p>As <a") and h.endswith('<ol><li id="R1">Roe</li></ol>')
    a = spark.createDataFrame([("1", "<a><ref-list>old</ref-list></a>"), ("2", "<a/>")], "pmid string, xml string")
    o = spark.createDataFrame([("1", "<b><ref-list>new</ref-list></b>")], "pmid string, xml string")
    assert {r["pmid"]: r["xml"] for r in P.replaced_references(a, o).collect()} == {"1": "<a><ref-list>new</ref-list></a>", "2": "<a/>"}
    import xml.etree.ElementTree as ET

    assert [x.text for x in P.path_select(ET.fromstring("<r><a><b>1</b></a></r>"), "a/c?/b")] == ["1"]


def test_marks_and_windows(spark):
    t = spark.createDataFrame([(1, "the cats run [1,3] and dogs [2] sleep"), (2, None), (3, "none")], "id int, text string")
    m = C.marks(t)
    assert [(r["k"], r["mark"], r["at"]) for r in m.orderBy("k").collect()] == [(1, "[1,3]", 13), (2, "[2]", 28)]
    w = C.word_windows(m, 2, 1).orderBy("k").collect()
    assert [(r["before"], r["after"]) for r in w] == [(["cats", "run"], ["dogs"]), (["run", "dogs"], ["sleep"])]
    links = spark.createDataFrame([("G", "B"), ("g", "a")], "GUID_from string, GUID_to string")
    r = C.resolved(m.withColumn("guid", F.lit(" G")), C.numbered_references(links))
    assert sorted((x["number"], x["to"]) for x in r.collect()) == [(1, "a"), (2, "b")] and [x["number"] for x in C.unresolved(m.withColumn("guid", F.lit("g")), C.numbered_references(links)).collect()] == [3]
    s = spark.createDataFrame([("d", 1, "A cat. "), ("d", 2, None)], "doc string, ord int, text string")
    lost = spark.createDataFrame([("d", 1, "cit2"), ("d", 1, "cit1")], "doc string, ord int, cit_id string")
    assert [r["text"] for r in C.reinserted(s, lost).orderBy("ord").collect()] == ["A cat <CIT ID=cit1/> <CIT ID=cit2/>. ", None]


EXPLAINED = '{"matched": true, "explanation": {"value": 1.0, "description": "product of:", "details": [{"value": 3.0, "description": "sum of:", "details": [{"value": 2.0, "description": "weight(text:cat in 3) [x], result of:", "details": [{"value": 2.0, "description": "score(doc=3), product of:", "details": [{"value": 0.5, "description": "queryWeight, product of:", "details": [{"value": 1.5, "description": "idf(docFreq=4, maxDocs=9)", "details": []}]}, {"value": 4.0, "description": "fieldWeight in 3, product of:", "details": [{"value": 2, "description": "tf(freq=4.0), with freq of:", "details": []}]}]}]}]}, {"value": 0.5, "description": "coord(1/2)", "details": []}]}}'
OUTLINE = "0.5 = (MATCH) sum of:\n  0.5 = (MATCH) weight(title:dog in 7), product of:\n    0.25 = queryWeight(title:dog), product of:\n      1.0 = idf(docFreq=2, maxDocs=5)\n    2.0 = (MATCH) fieldWeight(title:dog in 7), product of:\n      1.0 = tf(termFreq(title:dog)=1)\n"


def test_explanations(spark):
    rows = spark.createDataFrame([(1, "a", EXPLAINED), (1, "b", OUTLINE), (2, "c", None)], "query_id int, guid string, explanation string")
    got = {r["guid"]: r for r in E.parse_explanations(rows).collect()}
    assert (got["a"]["coord"], got["a"]["field"], got["a"]["term"], got["a"]["qw"], got["a"]["fw"], got["a"]["tf"], got["a"]["doc_freq"], got["a"]["max_docs"]) == (0.5, "text", "cat", 0.5, 4.0, 4, 4, 9)
    assert (got["b"]["field"], got["b"]["qw"], got["b"]["fw"], got["b"]["max_docs"]) == ("title", 0.25, 2.0, 5) and len(got) == 2


def test_exhaustive_equals_the_ranked_run(spark):
    from lectern.operators import retrieval as R

    docs = spark.createDataFrame([("a", "cat dog"), ("b", "dog"), ("c", None)], "guid string, text string")
    q = R.structured_query(spark.createDataFrame([(1, "cat")], "query_id int, text string"), "query_id", "text")
    i = R.build(docs, "guid", ["text"])
    all_docs = {r["guid"]: r["score"] for r in E.exhaustive(i, q, docs, {"text": 1.0}).collect()}
    best = R.score(R.formula_hits(i, q), {"text": 1.0}).first()
    assert all_docs == {"a": best["score"], "b": 0.0, "c": 0.0}
    b = spark.createDataFrame([(1, "text", "cat", 2.0)], "query_id int, field string, term string, boost double")
    assert E.boosted(R.formula_hits(i, q), b, {"text": 1.0}).first()["score"] == pytest.approx(2 * best["score"])


def test_held_out_weights(spark):
    from lectern.operators.learning import greedy_weights

    hits = spark.createDataFrame([(q, g, f, "t", 1.0, s) for q in range(4) for g, f, s in (("m", "good", 2.0), ("o", "bad", 3.0))], "query_id int, guid string, field string, term string, qw double, fw double")
    m = spark.createDataFrame([(q, "m") for q in range(4)], "query_id int, guid string")
    r = E.held_out(hits, m, spark.createDataFrame([(q, q % 2) for q in range(4)], "query_id int, fold int"), ["good", "bad"], 2, greedy_weights).collect()
    assert all(x["trained"] == 1.0 > x["baseline"] and x["improvement"] > 0 for x in r)


def test_reference_lookups_and_annotations(spark):
    refs = spark.createDataFrame([("d", "r1", "g1"), ("d", "r2", "g1"), ("d", "r3", None)], "doc string, ref_id string, guid string")
    assert [r["ref_id"] for r in J.reference_of(refs, spark.createDataFrame([("d", "g1")], "doc string, value string"), "guid").collect()] == ["r1"]
    e = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, sid int")
    a = spark.createDataFrame([("d", 1, "Obj", "New", "x")], "doc string, sid int, csc_type string, csc_adv string, csc_nov string")
    assert {r["sid"]: r["csc_type"] for r in J.merge_annotations(e, a).collect()} == {1: "Obj", 2: None}
    c = spark.createDataFrame([("d", 0, 0, 3, "r1"), ("d", 0, 5, 8, "r9"), ("d", 0, 10, 12, "r1")], "doc string, sentence int, start int, end int, ref_id string")
    assert [r["cluster"] for r in J.untag_lost(c, spark.createDataFrame([("r1", "g")], "ref_id string, guid string")).collect()] == [1, 1]


def test_bootstrap_draws_with_replacement(spark):
    b = A.bootstrap(spark.range(500), 4, 1.0, 7).groupBy("grp").count().collect()
    assert len(b) == 4 and all(400 < r["count"] < 600 for r in b)


def test_classifier_annotates(spark):
    from lectern.operators.learning import annotate, citation_features, cross_validated, train_classifier

    rows = spark.createDataFrame([(i, ["cat", "purr"] if i % 2 else ["dog", "bark"], "C" if i % 2 else "D") for i in range(40)], "id int, words array<string>, label string")
    assert all(r["predicted"] == r["label"] for r in annotate(train_classifier(rows, "words", "label"), rows, "label").collect())
    assert all(r["accuracy"] == 1.0 for r in cross_validated(rows, ["id"], "words", "label", 2).collect())
    c = citation_features(spark.createDataFrame([("d", "c1", "the cats ran", 5, 10, True, 2)], "doc string, cit_id string, text string, ord int, last_ord int, is_self boolean, multi int")).first()["features"]
    assert c == ["cats", "ran", "place_5", "self", "many"]
