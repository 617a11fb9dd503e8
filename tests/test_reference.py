"""Contracts of the citation-analytics operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import documents as D
from lectern.operators import keywords as K
from lectern.operators import metrics as M
from lectern.operators import references as J
from lectern.operators import reports as A
from lectern.operators import retrieval as R
from lectern.operators import similarity as G


def _measure(spark, ranked, match):
    r = spark.createDataFrame([(1, g, i) for i, g in enumerate(ranked, 1)], "query_id int, guid string, rank int")
    return M.measure(r, spark.createDataFrame([(1, g) for g in match], "query_id int, guid string")).first().asDict()


def test_metric_goldens(spark):
    a = _measure(spark, "abcde", "a")
    assert (a["mrr"], a["precision"], a["ndcg"], a["rank"], a["map"]) == (1, 1, 1, 1, 1)
    b = _measure(spark, "abcde", "bd")
    assert b["mrr"] == pytest.approx(0.625) and b["precision"] == 0.5 and b["ndcg"] == pytest.approx(0.7153382790366966) and b["rank"] == 2 and b["map"] == pytest.approx(2 / 3)


def test_metric_of_a_missing_match(spark):
    c = _measure(spark, "abc", "z")
    assert (c["mrr"], c["precision"], c["ndcg"], c["rank"]) == (0, 0, 0, 200)
    d = _measure(spark, "abc", "az")
    assert d["rank"] == 100 and d["mrr"] == 0.5


def _brute_map(ranked, match):
    found, total = 0, 0.0
    for i, g in enumerate(ranked, 1):
        found += g in match
        total += found / i
        if found == len(match):
            break
    return total / len(match)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), unique=True, min_size=1, max_size=8), st.sets(st.sampled_from("abcdefghz"), min_size=1, max_size=4))
def test_metric_bounds(spark, ranked, match):
    m = _measure(spark, ranked, match)
    assert 0 <= m["mrr"] <= 1 and 0 <= m["ndcg"] <= 1 and 0 <= m["precision"] <= 1 and 1 <= m["rank"] <= 200
    assert m["map"] == pytest.approx(_brute_map(ranked, match))


def test_empty_retrieval_has_rank_zero(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    m = M.measure(spark.createDataFrame([(1, "a", 1)], "query_id int, guid string, rank int"), spark.createDataFrame([(1, "a"), (2, "a")], "query_id int, guid string"))
    rows = {r["query_id"]: r for r in M.with_empty(m, q).collect()}
    assert rows[2]["rank"] == 0 and not rows[2]["retrieved_any"] and rows[1]["retrieved_any"]


def test_scores_by_hand(spark):
    docs = spark.createDataFrame([("d1", "red cat cat", None), ("d2", "dog", "cat"), ("d3", None, "")], "guid string, text string, title string")
    i = R.build(docs, "guid", ["text", "title"])
    q = R.structured_query(spark.createDataFrame([(1, "the cat and the cat 2nd")], "query_id int, text string"), "query_id", "text")
    assert [(r["term"], r["count"]) for r in q.collect()] == [("cat", 2)]
    hits = R.formula_hits(i, q)
    got = {r["guid"]: r["score"] for r in R.score(hits, {"text": 1.0, "title": 3.0}).collect()}
    idf = 1 + math.log(3 / 2)
    assert got["d1"] == pytest.approx(2 * idf * math.sqrt(2) * idf / math.sqrt(3)) and got["d2"] == pytest.approx(3 * 2 * idf * idf)
    assert [r["guid"] for r in R.top(R.score(hits, {"text": 1.0, "title": 3.0})).orderBy("rank").collect()] == ["d2", "d1"]
    assert R.score_best_field(hits, {"text": 1.0, "title": 3.0}).count() == 2
    assert "title:\"cat\"^6.0" in R.query_string(q, {"title": 3.0}).first()["query"]


def test_sentence_windows(spark):
    s = spark.createDataFrame([("d", i // 3, i, f"s{i}") for i in range(1, 9)], "doc string, para int, ord int, text string")
    c = spark.createDataFrame([("d", 2)], "doc string, cit_ord int")
    sel = lambda p, **k: sorted(r["ord"] for r in D.sentence_window(s, c, p, **k).collect())
    assert sel("2up_1down") == [1, 2, 3] and sel("2up_1down_withinpara") == [1, 2] and sel("1only") == [2] and sel("paragraph") == [1, 2]
    assert sel("3up_1down", clip=True) == [2, 3]
    with pytest.raises(ValueError):
        D.sentence_window(s, c, "sideways")


def test_passages_overlap_by_half(spark):
    d = spark.createDataFrame([("d", "a b c d e"), ("n", None), ("e", "")], "guid string, text string")
    assert sorted((r["offset"], r["passage"]) for r in D.passages(d, "guid", "text", 4).collect()) == [(0, "a b c d"), (2, "c d e"), (4, "e")]


def test_word_window_and_nearest_lower(spark):
    t = spark.createDataFrame([(["a", "b", "X", "c", "d"],)], "w array<string>")
    assert t.select(D.word_window(F.col("w"), F.lit(3), 1, 5).alias("x")).first()["x"] == ["b", "c", "d"]
    n = D.nearest_lower(spark.createDataFrame([("d", "c1", 5), ("d", "c0", 0)], "doc string, item string, at int"), spark.createDataFrame([("d", 2), ("d", 4), ("d", 9)], "doc string, ord int"))
    assert {r["item"]: r["ord"] for r in n.collect()} == {"c1": 4, "c0": None}


def test_numbered_citations(spark):
    t = spark.createDataFrame([("[1,2,5-7]",), ("[3]",), ("[9-2]",)], "c string")
    assert [r[0] for r in t.select(X.numbered_list("c")).collect()] == [[1, 2, 5, 6, 7], [3], [9, 2]]


def test_author_and_reference_forms(spark):
    t = spark.createDataFrame([("Smith, John",), ("John Smith",), ("Smith J.",), ("",), (None,)], "n string")
    got = [r[0] for r in t.select(X.author_parts("n")).collect()]
    assert [tuple(x) if x else None for x in got] == [("Smith", "John"), ("Smith", "John"), ("Smith", "J."), None, None]
    assert t.select(X.reference_name(F.lit("John"), F.lit("Smith"))).first()[0] == "J. Smith"


def test_reference_match_by_priority(spark):
    refs = spark.createDataFrame([("r1", "d1", None, None, "t1", ["x"]), ("r2", "", None, None, "t2", ["b", "q"]), ("r3", 'bad"', None, None, "t2", ["z"]), ("r4", None, "c9", None, None, [])], "ref_id string, doi string, corpus_id string, guid string, norm_title string, surnames array<string>")
    papers = spark.createDataFrame([("g2", "d1", "c1", "t9", ["a"]), ("g1", "d1", "c2", "t1", ["x"]), ("g3", None, "c9", "t2", ["b"])], "guid string, doi string, corpus_id string, norm_title string, surnames array<string>")
    assert {r["ref_id"]: (r["guid"], r["matched_by"]) for r in J.match_references(refs, papers).collect()} == {"r1": ("g1", "doi"), "r2": ("g3", "title"), "r4": ("g3", "corpus_id")}


def test_greedy_word_matching_is_one_to_one(spark):
    cited = spark.createDataFrame([("d", "p1", 1, "2001", ["smith"], ["smith", "2001", "deep", "cats"]), ("d", "p2", 2, "2001", ["smith"], ["smith", "2001", "dogs", "run"])], "doc string, cited_id string, ord int, year string, surnames array<string>, words array<string>")
    refs = spark.createDataFrame([("d", "a", ["smith", "2001", "deep", "cats"]), ("d", "b", ["smith", "2001", "dogs"])], "doc string, ref_id string, words array<string>")
    assert {r["cited_id"]: r["ref_id"] for r in J.greedy_by_words(cited, refs).collect()} == {"p1": "a", "p2": "b"}


def test_citation_to_reference(spark):
    c = spark.createDataFrame([("d", "c1", ["foo", "2013"], "2013", "one")], "doc string, cit_id string, words array<string>, year string, kind string")
    r = spark.createDataFrame([("d", "r1", ["foo"], "2013"), ("d", "r2", ["foo"], "1990"), ("d", "r3", ["bar"], "2013")], "doc string, ref_id string, surnames array<string>, year string")
    assert [(x["cit_id"], x["ref_id"]) for x in J.match_citations(c, r).collect()] == [("c1", "r1")]


def test_citation_clusters(spark):
    c = spark.createDataFrame([("d", 1, 0, 10), ("d", 1, 15, 25), ("d", 1, 60, 70)], "doc string, sentence int, start int, end int")
    assert [(r["start"], r["cluster"], r["multi"]) for r in J.clusters(c).orderBy("start").collect()] == [(0, 1, 2), (15, 1, 2), (60, 2, 1)]


def test_dice_is_half_for_inseparable_items(spark):
    c = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p3", "c"), ("p1", "a"), (None, "a")], "place string, item string")
    s = G.dice(*G.cocitation(c, "place", "item"))
    assert [(r["a"], r["b"], r["together"], r["dice"]) for r in s.collect()] == [("a", "b", 2, 0.5)]
    e = G.expand(s, spark.createDataFrame([(1, "a")], "set_id int, item string"))
    assert [(r["item"], r["score"]) for r in e.collect()] == [("b", 0.5)]


def test_keyword_normalisation_sums_to_one(spark):
    s = spark.createDataFrame([(1, "d1", "x", 2.0), (1, "d1", "y", 1.0), (1, "d2", "x", 4.0)], "query_id int, guid string, term string, score double")
    n = K.normalised(s, spark.createDataFrame([(1, "d1")], "query_id int, guid string")).collect()
    assert sum(r["score"] for r in n) == pytest.approx(1.0) and {r["term"] for r in n} == {"x", "y"}
    assert {r["term"]: r["score"] for r in n}["y"] > {r["term"]: r["score"] for r in n}["x"]


def test_minimal_set_and_add_and_drop(spark):
    hits = spark.createDataFrame([(1, "m", "text", "good", 1.0, 3.0), (1, "o", "text", "bad", 1.0, 9.0), (1, "m", "text", "bad", 1.0, 1.0)], "query_id int, guid string, field string, term string, qw double, fw double")
    m, s = spark.createDataFrame([(1, "m")], "query_id int, guid string"), spark.createDataFrame([(1, "good", 2.0), (1, "bad", 1.0)], "query_id int, term string, score double")
    assert K.minimal_set(s, hits, m, {"text": 1.0}).first()["n_terms"] == 1
    assert [r["term"] for r in K.add_and_drop(hits, m, s).collect()] == ["good"]


@pytest.mark.parametrize("name", sorted(K.TRANSFORMS))
def test_every_transform_gives_a_number(spark, name):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0)], "query_id int, term string, weight double")
    assert all(r["weight"] is not None for r in K.transform(w, name).collect())


def test_greedy_weights_prefer_the_telling_field(spark):
    from lectern.operators.learning import greedy_weights

    hits = spark.createDataFrame([(1, "m", "good", "t", 1.0, 1.0), (1, "o", "bad", "t", 1.0, 2.0)], "query_id int, guid string, field string, term string, qw double, fw double")
    w, v = greedy_weights(hits, spark.createDataFrame([(1, "m")], "query_id int, guid string"), ["good", "bad"])
    assert v == pytest.approx(1.0) and w["good"] > w["bad"]


def test_pivot_margins(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0)], "m string, c string, v double")
    got = {r["m"]: r.asDict() for r in A.pivot_means(rows, "m", "c", "v", ["x", "y"]).collect()}
    assert got["a"]["Mean"] == 2 and got["a"]["Max"] == 3 and got["Mean"]["x"] == 3 and got["Max"]["Max"] == 5 and got["b"]["y"] is None


def test_minus_null_and_empty_inputs(spark):
    e = spark.createDataFrame([], "guid string, text string")
    assert R.build(e, "guid", ["text"]).terms.count() == 0 and D.passages(e, "guid", "text", 4).count() == 0


def test_classifier_learns(spark):
    from lectern.operators.learning import accuracy, train_classifier

    rows = spark.createDataFrame([(["cat", "fur"], "a"), (["dog", "bark"], "b")] * 10 + [(None, "a"), (["x"], None)], "words array<string>, zone string")
    assert accuracy(train_classifier(rows, "words", "zone", 64), rows.where("words is not null and zone is not null")) == 1.0


def test_reference_tree_and_conditions(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "GUID_from string, GUID_to string")
    t = J.reference_tree(links, spark.createDataFrame([("a",)], "guid string"), 3)
    assert sorted((r["guid"], r["level"]) for r in t.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    from lectern.plans.conditions import nested_fields, select

    p = spark.createDataFrame([(1, "AAC", "1999", "deep cats"), (2, "PMC", None, "dogs")], "id int, collection string, year string, title string")
    ids = lambda c: [r["id"] for r in select(p, c, sort=["id"]).collect()]
    assert ids("collection:aac") == [1] and ids("year:[1990 TO 2000] OR title:dogs") == [1, 2] and ids("NOT (year:>1990)") == [2] and ids('title:"deep cats" AND _exists_:year') == [1] and ids("") == [1, 2]
    assert nested_fields('a.b:1 AND t:"c.d:2"') == ["a.b"]
    with pytest.raises(ValueError):
        select(p, "(collection:aac")


def test_experiment_runs(spark):
    from lectern.plans.experiment import expand, run

    docs = spark.createDataFrame([("1", "cats purr softly"), ("2", "dogs bark loudly")], "guid string, text string")
    q = spark.createDataFrame([(1, "purr cats")], "query_id int, text string")
    m = spark.createDataFrame([(1, "1")], "query_id int, guid string")
    got = run({"doc_methods": {"full_text": {}, "passage": {"parameters": [2]}}, "query_methods": {"whole": {}}, "scorers": ["sum", "best_field"]}, docs, q, m).collect()
    assert len(got) == 4 and all(r["avg_mrr"] == 1 for r in got)
    assert [x.name for x in expand({"ilc": {"parameters": [1, 2], "inner_parameters": ["a"]}})] == ["ilc_1_a", "ilc_2_a"]


def test_annotated_citations(spark):
    from lectern.functions.annotate import annotate_citations, author_mentions, guid_of, nfkd

    t = spark.createDataFrame([("We follow Foo et al. (2013) and (Bar and Qaz, 2010).", "APA"), ("See [1] and [2,5-7].", "AFI"), ("plain", None), (None, "APA")], "t string, s string")
    got = [r["x"] for r in t.select(annotate_citations("t", "s").alias("x")).collect()]
    assert got[0]["text"] == "We follow <CIT ID=1/> and (<CIT ID=2/>)." and [(c["a1"], c["a2"], c["etal"], c["year"]) for c in got[0]["citations"]] == [("Foo", None, True, "2013"), ("Bar", "Qaz", False, "2010")]
    assert got[1]["text"] == "See <CIT ID=1/> and <CIT ID=2/>." and [c["nums"] for c in got[1]["citations"]] == [[1], [2, 5, 6, 7]]
    assert got[2]["text"] == "plain" and got[3]["text"] is None
    m = spark.createDataFrame([("as Foo and Bar (2001) say", ["Foo", "Bar"]), ("x", None), (None, ["Foo"])], "t string, n array<string>")
    assert [r[0] for r in m.select(author_mentions("t", "n")).collect()] == ["as __author say", "x", None]
    g = spark.createDataFrame([("ﬁ", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in g.select(nfkd("a")).collect()] == ["fi", None] and len({r[0] for r in g.select(guid_of("a", "b")).collect()}) == 2


def test_terms_and_graphs(spark):
    from lectern.operators import terms as T

    d = spark.createDataFrame([("d", "deep cats", "cats run", "wild cats wild cats")], "k string, t string, a string, b string")
    assert {r["ngram"]: r["n"] for r in T.document_keyphrases(d, "k", "t", "a", "b").collect()} == {"deep cats": 1, "cats run": 1, "wild cats": 2}
    r = {x["term"]: x["score"] for x in T.text_rank(spark.createDataFrame([("d", "hub a hub b hub c")], "k string, t string"), "k", "t").collect()}
    assert max(r, key=r.get) == "hub"
    nodes, links = T.graph(spark.createDataFrame([("x", "y"), ("x", "y")], "a string, b string"), spark.createDataFrame([("x", "l")], "guid string, label string"))
    assert nodes.count() == 2 and links.first()["weight"] == 2


def test_divisor_sweep(spark):
    t = spark.createDataFrame([("a", 1), ("b", 5), ("c", 10)], "term string, df int")
    got = {r["divisor"]: r["f1"] for r in K.divisor_sweep(t, spark.createDataFrame([("a",), ("b",)], "term string"), [2.0, 1.0]).collect()}
    assert got[2.0] == 1.0 and got[1.0] == pytest.approx(0.8)


def test_contexts_of_a_paper_that_more_than_400_cite(spark, tmp_path):
    from hashlib import md5

    from lectern.plans.reference_queries import QUERIES

    citing = [f"c{i:04d}" for i in range(450)]
    docs = [(f"x{i:04d}", c, "citing_context", f"  says {i} é" + " word" * (i % 40) + " ") for i, c in enumerate(citing)] + [("o1", "hot", "abstract", " own "), ("o2", "alone", "abstract", "  "), ("o3", "hot", "citing_context", None)]
    spark.createDataFrame(docs, "doc_id string, guid string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    links = [(c, "HOT ") for c in citing] + [(c, "hot") for c in citing] + [(c, "few") for c in citing[:3]] + [("alone", "hot")]
    spark.createDataFrame(links, "GUID_from string, GUID_to string").write.parquet(f"{tmp_path}/links.parquet")
    texts = [x[3] for x in docs[:450]]
    digest = lambda t: md5(t.encode()).hexdigest()
    got = {r["guid"]: (r["digest"], r["n_contexts"]) for r in QUERIES["b_inlink_context"](spark, str(tmp_path)).collect()}
    assert got == {"hot": (digest(" ".join(texts)), 450), "few": (digest(" ".join(texts[:3])), 3)}
    both = {r["guid"]: r["digest"] for r in QUERIES["b_mashup"](spark, str(tmp_path)).collect()}
    assert both == {"hot": digest(" ".join([" own ", *texts]).strip(" ")), "few": digest(" ".join(texts[:3]).strip(" ")), "alone": digest("")}


def test_blocks_of_contexts_are_bounded(spark):
    c = spark.createDataFrame([(f"a{i}", i, "x" * 30) for i in range(50)], "guid string, ctx_id int, text string")
    b = D.inlink_blocks(c, spark.createDataFrame([(f"a{i}", "hot") for i in range(50)], "guid string, to string"), size=100).orderBy("block").collect()
    assert all(len(r["text"]) < 131 for r in b) and " ".join(r["text"] for r in b) == " ".join(["x" * 30] * 50) and sum(r["n_contexts"] for r in b) == 50


def test_citation_style_reads_any_text(spark, tmp_path):
    from lectern.plans.reference_queries import QUERIES

    texts = {"a": "as “shown” in Smith (2010) – and", "b": "Müller and Özgür, 2011a say", "c": "Özgür et al. (2012)", "d": "seen in [1–3] and [4], Élan", "e": None, "f": "“nothing” here", "g": "Smith (2010) [1]", "h": "naïveSmith 2010"}
    spark.createDataFrame(list(texts.items()), "scidoc_id string, text string").write.parquet(f"{tmp_path}/scidoc.parquet")
    got = {r["scidoc_id"]: r["style"] for r in QUERIES["t_citation_style"](spark, str(tmp_path)).collect()}
    assert got == {"a": "APA", "b": "APA", "c": "APA", "d": "AFI", "e": None, "f": None, "g": "APA", "h": None}


def test_similar_titles_with_accents(spark, tmp_path):
    from lectern.plans.reference_queries import QUERIES

    spark.createDataFrame([(1, "Über die Bäume im Garten", "2001"), (2, "Plain title of old", "2001")], "rec_id int, title string, year string").write.parquet(f"{tmp_path}/aan_records.parquet")
    papers = [("g1", "uber die bäume im garten"), ("g2", "über die baume im garten"), ("g3", "plain title of olf"), ("g4", "über die bäume")]
    spark.createDataFrame(papers, "GUID string, norm_title string").selectExpr("GUID", "norm_title", "'2001' AS year", "cast(null AS string) AS corpus_id", "timestamp_ntz'2001-01-01' AS time_created", "cast(null AS timestamp_ntz) AS time_deleted").write.parquet(f"{tmp_path}/papers.parquet")
    got = {(r["ref_id"], r["guid"]): r["similarity"] for r in QUERIES["j_similar_titles"](spark, str(tmp_path)).collect()}
    assert got == {(1, "g1"): round(1 - 1 / 24, 6), (1, "g2"): round(1 - 1 / 24, 6), (2, "g3"): round(1 - 1 / 18, 6)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.9, 0.7])
def test_similar_titles_equal_brute_force(spark, least):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    titles = [" ".join(word() for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["does wocifopa normalise hybrid networks", "parsing german"]

    def typed(t):
        for _ in range(r.randrange(0, max(2, int(len(t) * (1 - least)) + 1))):
            k = r.randrange(len(t) + 1)
            t = t[:k] + r.choice(["", "x", " ", "é"]) + t[k + r.randrange(2) :]
        return t or "x"

    papers = [(f"g{i}", t, 2000 + i % 2) for i, t in enumerate(titles)]
    refs = [(3 * i + k, typed(t), 2000 + (i + (k == 2)) % 2) for i, t in enumerate(titles) for k in range(3)] + [(900, "does woicfopa normalisehybrid networks", 2000), (901, "parsingg german", 2001), (902, None, 2000), (903, "x", None)]
    want = {(i, g) for i, t, y in refs for g, u, z in papers if t and y == z and 1 - _edits(t, u) / max(len(t), len(u)) > least}
    got = J.similar_titles(spark.createDataFrame(refs, "ref_id int, norm_title string, year int"), spark.createDataFrame(papers, "guid string, norm_title string, year int"), least)
    assert sorted((x["ref_id"], x["guid"]) for x in got.collect()) == sorted(want) and {(900, "g60"), (901, "g61")} <= want


def test_minimal_set_equals_brute_force(spark):
    import random

    r = random.Random(8)
    terms = [f"t{k}" for k in range(10)]
    hits = [(q, f"d{i:02d}", "text", t, 1.0, float(r.choice([1, 2, 3]))) for q in range(6) for i in range(12) for t in terms if r.random() < 0.4]
    matches = [(q, f"d{i:02d}") for q in range(6) for i in r.sample(range(12), 1 + q % 2)]
    scores = [(q, t, float(10 - k)) for q in range(6) for k, t in enumerate(terms)]
    want = {}
    for q in range(6):
        tried = []
        for n in range(1, len(terms) + 1):
            run = {}
            for x, g, _, t, _, s in hits:
                if x == q and t in terms[:n]:
                    run[g] = run.get(g, 0.0) + s
            order = sorted(run, key=lambda g: (-run[g], g))
            at = [order.index(g) + 1 for x, g in matches if x == q and g in run]
            if at:
                tried.append((sum(at) / len(at), n))
        want[q] = min(tried)
    got = K.minimal_set(spark.createDataFrame(scores, "query_id int, term string, score double"), spark.createDataFrame(hits, "query_id int, guid string, field string, term string, qw double, fw double"), spark.createDataFrame(matches, "query_id int, guid string"), {"text": 1.0})
    assert {x["query_id"]: (x["rank"], x["n_terms"]) for x in got.collect()} == want


def test_minimal_set_of_the_query_tries_every_term(spark, tmp_path):
    from lectern.plans.reference_queries import QUERIES

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = [("d0", " ".join(words))] + [(f"a{i}", " ".join(w for w in reversed(words) if w != words[i])) for i in range(10)]
    spark.createDataFrame(docs, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", " ".join(words))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["k_minimal_set"](spark, str(tmp_path)).collect()
    assert [(x["n_terms"], x["rank"]) for x in got] == [(10, 1.0)]


def test_transforms_round_as_their_sql(spark):
    import duckdb

    from lectern.plans.reference_queries import _product_rounded

    halves = [0.0161822 * 2 + 1e-7, 0.0323645, 0.2752685, 0.0002465, 1.0012035, 1.0005425, -0.0323645, 2.5e-07, 1234.0000005, 0.0]
    got = [x["x"] for x in spark.createDataFrame(list(enumerate(halves)), "i int, x double").select("i", _product_rounded("x", 6)).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in halves]
    assert [x["x"] for x in spark.createDataFrame([(None,)], "x double").select(_product_rounded("x", 6)).collect()] == [None]


def test_expansion_in_rounds_equals_the_whole(spark, monkeypatch):
    import random
    from pathlib import Path

    from lectern.operators import similarity as G
    from lectern.plans import session

    r = random.Random(4)
    cited = {(p, r.randrange(30)) for p in range(40) for _ in range(r.randrange(1, 6))} | {(99, i) for i in range(12)}
    c = spark.createDataFrame([*cited, (None, 1), (3, None)], "p int, i int")
    seeds = spark.createDataFrame([(s, i) for s in range(5) for i in r.sample(range(30), 4)], "set_id int, item int")
    want = sorted(G.expand(G.dice(*G.cocitation(c, "p", "i")), seeds).collect())
    write, names = session.written, []

    def noted(df, name="stage"):
        out = write(df, name)
        names.append((name, out.written_at.removeprefix("file:")))
        return out

    monkeypatch.setattr(session, "written", noted)
    monkeypatch.setattr(G, "ROUND_ROWS", 60)
    monkeypatch.setattr(G, "ROUND_PAIRS", 0.5)
    monkeypatch.setattr(G, "BLOCK", 5)
    monkeypatch.setattr(G, "ROUND_HITS", 1)
    got = G.expand(G.stored_dice(c, "p", "i"), seeds, stored=True)
    assert sorted(got.collect()) == want and len(want) == 25
    kinds = [n for n, _ in names]
    assert kinds.count("dice") > 1 and kinds.count("best") > 1 and {n for n, p in names if Path(p).exists()} == {"dice", "best"}


@pytest.mark.parametrize("kind", ["long", "string", "sparse"])
def test_expand_over_blocks_of_seeds_equals_the_sums_of_all_hits(spark, monkeypatch, kind):
    import random

    r = random.Random(6)
    name = {"long": int, "string": lambda x: f"i{x}", "sparse": lambda x: x * 10**9}[kind]
    typ = "string" if kind == "string" else "long"
    similar = [(name(a), name(b), r.choice([0.1, 0.2, 0.25, 1 / 3])) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.3]
    seeds = [(s, name(i)) for s in [*range(12), None] for i in r.sample(range(45), 5)] + [(3, None)]
    near, sums = {}, {}
    for a, b, x in similar:
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))
    for s, i in seeds:
        for b, x in near.get(i, []):
            if s is None or (s, b) not in seeds:
                sums[s, b] = sums.get((s, b), 0.0) + x
    want = {(s, b, round(x, 9)) for q in [*range(12), None] for (s, b), x in sorted(((k, x) for k, x in sums.items() if k[0] == q), key=lambda t: (-round(t[1], 9), t[0][1]))[:4]}
    monkeypatch.setattr(G, "SEEDS_SENT", 20)
    monkeypatch.setattr(G, "SLICE_HITS", 30)
    for dense in (0, 8):
        monkeypatch.setattr(G, "DENSE", dense)
        got = G.expand(spark.createDataFrame(similar, f"a {typ}, b {typ}, dice double"), spark.createDataFrame(seeds, f"set_id int, item {typ}"), 4)
        assert {(x["set_id"], x["item"], round(x["score"], 9)) for x in got.collect()} == want


def test_expand_rounds_scores_once(spark):
    got = G.expand(spark.createDataFrame([(1, 2, 0.1234564996)], "a int, b int, dice double"), spark.createDataFrame([(1, 1)], "set_id int, item int")).collect()
    assert [x["score"] for x in got] == [0.1234564996]


def test_similar_titles_broadcast_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "plain title of old", 2001)], "ref_id int, norm_title string, year int").write.parquet(f"{tmp_path}/refs")
    spark.createDataFrame([("g", "plain title of olf", 2001)], "guid string, norm_title string, year int").write.parquet(f"{tmp_path}/papers")
    got = J.similar_titles(spark.read.parquet(f"{tmp_path}/refs"), spark.read.parquet(f"{tmp_path}/papers"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x["ref_id"], x["guid"]) for x in got.collect()] == [(1, "g")]


def _ranking_case(spark, seed):
    """An index of 60 documents, some of them equal, its queries' terms, and matches."""
    import random

    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(3, 15))) for _ in range(50)]
    docs = [(i, t, t[: 2 + len(t) // 3].rsplit(" ", 1)[0]) for i, t in enumerate(texts + texts[:10])] + [(90, None, None)]
    index = R.build(spark.createDataFrame(docs, "doc_id long, text string, head string").repartition(3), "doc_id", ["head", "text"]).stored
    q = spark.createDataFrame([(k, w, 1 + i % 2) for k in range(5) for i, w in enumerate(r.sample(words, 8))] + [(0, "unseen", 1)], "query_id int, term string, count int")
    m = spark.createDataFrame([(k, g) for k in range(5) for g in r.sample(range(60), 1 + 3 * k)] + [(4, 90), (7, 1)], "query_id int, guid long")
    return index, q, m


_TWO = {"head": 2.0, "text": 1.0}


def _without_all_hits(monkeypatch):
    made = R.formula_hits

    def some(index, query, norm="field", pairs=None):
        assert pairs is not None, "every hit of every query is made"
        return made(index, query, norm, pairs)

    monkeypatch.setattr(R, "formula_hits", some)


def test_matches_and_ranks_are_not_broadcast(spark, tmp_path):
    from lectern.operators.metrics import measure

    def stored(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    s = stored([(1, 5, "a", 2.0), (1, 6, "a", 1.0)], "query_id int, guid long, term string, score double", "scores")
    m = stored([(1, 5)], "query_id int, guid long", "matches")
    ranked = stored([(1, 6, 1), (1, 5, 2)], "query_id int, guid long, rank int", "ranked")
    merges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    own, per = K.normalised(s, m, ranked), measure(ranked, m)
    assert merges(own) == 2 and merges(per) == 3
    assert [tuple(x) for x in own.collect()] == [(1, 5, "a", 1.0)] and [x["rank"] for x in per.collect()] == [2]
    index, q, m = _ranking_case(spark, 3)
    assert merges(R.formula_hits(index, q, pairs=m)) == 1


def test_minimal_set_over_the_index_equals_that_of_its_hits(spark, monkeypatch):
    index, q, m = _ranking_case(spark, 3)
    scores = q.select("query_id", "term", F.pmod(F.xxhash64("term", "query_id"), F.lit(9)).cast("double").alias("score"))
    hits = R.formula_hits(index, q)
    order = {}
    for x in sorted(scores.collect(), key=lambda x: (-x["score"], x["term"])):
        order.setdefault(x["query_id"], []).append(x["term"])
    leaves, want = [(x["query_id"], x["guid"], x["term"], x["qw"] * x["fw"] * _TWO[x["field"]]) for x in hits.collect()], {}
    for k, terms in order.items():
        tried, run = [], {}
        for n, t in enumerate(terms, 1):
            for a, g, b, s in leaves:
                if (a, b) == (k, t):
                    run[g] = run.get(g, 0.0) + s
            at = sorted(run, key=lambda g: (-round(run[g], 7), g))
            own = [at.index(x["guid"]) + 1 for x in m.collect() if x["query_id"] == k and x["guid"] in run]
            if own:
                tried.append((round(sum(own) / len(own), 9), n))
        want[k] = min(tried)
    monkeypatch.setattr(K, "CURVE_POINTS", 60)
    monkeypatch.setattr(R, "TABLE_CELLS", 100)
    got = lambda x: {r["query_id"]: (round(r["rank"], 9), r["n_terms"]) for r in x.collect()}
    assert got(K.minimal_set_of(index, q, scores, m, _TWO)) == want
    assert got(K.minimal_set(scores, hits.repartition(7, "term"), m, _TWO)) == want


def test_minimal_set_of_the_query_makes_no_hits(spark, tmp_path, monkeypatch):
    from lectern.plans.reference_queries import QUERIES

    text = "alpha beta gamma delta epsilon zeta eta theta iota"
    spark.createDataFrame([(1, text), (2, text + " kappa"), (3, "alpha alpha alpha")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _without_all_hits(monkeypatch)
    assert [(x["query_id"], x["rank"]) for x in QUERIES["k_minimal_set"](spark, str(tmp_path)).collect()] == [(5, 1.5)]


def test_retrieved_equals_the_top_of_all_hits(spark, monkeypatch):
    index, q, _ = _ranking_case(spark, 4)
    rows = lambda df: sorted((x["query_id"], x["rank"], x["guid"], round(x["score"], 8)) for x in df.collect())
    want = rows(R.top(R.score(R.formula_hits(index, q), _TWO).withColumn("score", F.round("score", 9)), 7))
    monkeypatch.setattr(R, "TABLE_CELLS", 100)
    monkeypatch.setattr(R, "HELD", 8)
    assert rows(R.retrieved(index, q, _TWO, 7)) == want and len(want) == 35


@pytest.mark.parametrize("deep", [200, 6])
def test_compare_transforms_over_the_index_equals_that_of_its_hits(spark, monkeypatch, deep):
    index, q, m = _ranking_case(spark, 5)
    names = ["multiply", "constant", "invert", "top", "quadratic"]
    w = q.select("query_id", "term", (1 + F.pmod(F.xxhash64("term", "query_id"), F.lit(9))).cast("double").alias("weight")).where("term <> 'w3'")
    leaf = R.formula_hits(index, q).join(K.transform_all(w, names), ["query_id", "term"])
    scores = {}
    for x in leaf.collect():
        for n in names:
            at = scores.setdefault((n, x["query_id"]), {})
            at[x["guid"]] = at.get(x["guid"], 0.0) + x["qw"] * x["fw"] * _TWO[x["field"]] * x[n]
    matched = {}
    for x in m.collect():
        matched.setdefault(x["query_id"], []).append(x["guid"])
    want = {n: [] for n in names}
    for (n, k), s in scores.items():
        place = {g: i for i, g in enumerate(sorted(s, key=lambda g: (-round(math.log(s[g]), 9), g))[:deep], 1)}
        own = matched[k]
        gain = [0.0 if g not in place else 1.0 if len(own) > 1 and place[g] <= len(own) else math.log(2) / math.log(1 + place[g]) for g in own]
        want[n].append(sum(gain) / len(own))
    near = R.retrieved(index, q, _TWO, deep).select("query_id", "guid")
    monkeypatch.setattr(R, "TOP", deep)
    monkeypatch.setattr(R.top, "__defaults__", (deep,))
    monkeypatch.setattr(R.best_by, "__defaults__", (deep, False, None))
    monkeypatch.setattr(R, "TABLE_CELLS", 100)
    monkeypatch.setattr(R, "HELD", 8)
    _without_all_hits(monkeypatch)
    got = {x["transform"]: (x["n_queries"], x["ndcg"]) for x in K.compare_transforms(index, q, w, m, near, _TWO, names).collect()}
    assert {n: c for n, (c, _) in got.items()} == {n: 5 for n in names}
    assert {n: x for n, (_, x) in got.items()} == pytest.approx({n: sum(v) / len(v) for n, v in want.items()})
