"""Training-text operators: brute force, exact round trips, and defined results for odd input."""

import json
import random

import numpy as np
import pytest

LONG = "some words " * 20_000


# ---- p7 ----
def test_encoding_equals_the_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lectern.llm.tokens import encode_corpus

    r = random.Random(3)
    texts = [None, "", " ", "<|endoftext|> it's 42 naïve\n\n  x", "a" * 5000, LONG, *["".join(r.choice("ab 1.\n\t'sé　漢😀<|>") for _ in range(r.randrange(60))) for _ in range(300)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "", "y"), (None, "null id", "z")], "doc_id bigint, text string, ids string")
    tk = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    tk.encode_special_tokens = True
    rows = encode_corpus(docs, words=50).collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        want = "null id" if x["doc_id"] is None else texts[x["doc_id"]] or ""
        assert list(x["ids"]) == tk.encode(want, add_special_tokens=False).ids
    assert encode_corpus(docs.limit(0)).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    from lectern.llm.tokens import Transducer

    r = random.Random(1)
    words = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 7))): [r.randrange(9) for _ in range(r.randrange(1, 4))] for _ in range(400)}
    t = Transducer.compile(words)
    (tmp_path / "t").write_bytes(t.to_bytes())
    t = Transducer.map(str(tmp_path / "t"))
    assert all(t.find(w) == ids for w, ids in words.items())
    assert all(t.find(w + b"d") is None and t.find(b"d" + w) is None for w in words)
    same = Transducer.compile({w + s: [1] for w in (b"a", b"b", b"c") for s in (b"xyz", b"xy")})
    assert len(same.final_at) - 1 == 5  # start, and one shared chain of suffixes
    assert Transducer.compile({}).find(b"a") is None


# ---- p8 ----
def test_leaks_against_brute_force(spark):
    from lectern.llm.leaks import leaks, words

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40)))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for k in range(120):
        noise = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))]
        w = items[r.randrange(30)][1].split()
        a = r.randrange(len(w))
        piece = w[a : a + r.randrange(9, 20)]
        piece = [f"<i>{x.upper()}</i>," if r.random() < 0.3 else x + "​ [1,2]" if r.random() < 0.2 else x for x in piece]
        docs.append((k, " ".join([*noise[:20], *piece, *noise[20:]])))
    docs += [(500, None), (501, ""), (502, LONG), (3, docs[3][1])]
    want = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, x in items:
            v = words(x)
            if any(tuple(v[k : k + 12]) in runs for k in range(len(v) - 11)):
                want.add((d, i))
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    assert want and set(map(tuple, leaks(D, I).collect())) == want
    assert leaks(D, I.limit(0)).count() == 0 and leaks(D.limit(0), I).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from lectern.llm import leaks as L

    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(10)]
    docs = [(i, "so " + items[i][1] + " it is") for i in range(10)]
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, L.leaks(D, I).collect())) == [(i, i) for i in range(10)]


@pytest.mark.parametrize("edits", [1, 2])
def test_leaks_with_edits_against_brute_force(spark, edits):
    from lectern.llm.leaks import edit_distance, leaks, words

    r = random.Random(edits)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(16))) for i in range(40)]
    docs = []
    for d in range(120):
        ws = items[r.randrange(40)][1].split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(ws))
            ws = r.choice([ws[:k] + ["new"] + ws[k:], ws[:k] + ws[k + 1 :], ws[:k] + ["new"] + ws[k + 1 :]])
        docs.append((d, " ".join([*r.choices(vocabulary, k=5), *ws, *r.choices(vocabulary, k=5)])))
    windows = lambda t: [words(t)[k : k + 12] for k in range(len(words(t)) - 11)]
    want = {(d, i) for d, t in docs for i, u in items if any(edit_distance(x, y, edits) <= edits for x in windows(t) for y in windows(u))}
    got = set(map(tuple, leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=edits).collect()))
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


def test_edit_distance_of_windows():
    from lectern.llm.leaks import edit_distance

    a = list("abcdefgh")
    assert edit_distance(a, a, 0) == 0 and edit_distance(a, list("abxdefgh"), 0) == 1 and edit_distance(a, list("abxdefgh"), 2) == 1 and edit_distance(a, list("zzzzzzzz"), 2) == 3


# ---- p9 ----
RESIDUE = [
    "We {{ name }} measured it.", "The [INSERT TITLE HERE] grows.", "<%= user %> was here", "Dear Firstname Lastname, hello", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "404 Not Found. The page could not be found.",
    "Please enable JavaScript to view this page.", "Some text.\nError 503: the site is down for maintenance.", "Type your abstract here.", "Value of undefined paper of undefined.", "Seite nicht gefunden. Bitte", "ページが見つかりません。", "Traceback: KeyError 'x' in y",
]
CONTENT = [
    None, "", "  \n", "Our parser skips slots such as {{name}} because they vary.", "The phrase “lorem ipsum” served as a control.", "JavaScript source files were measured as texts.", "Pages that ask readers to enable JavaScript were counted.",
    "We denote the unknown by ${4}$ and write <tag> for its tag.", "Across 404 papers, results were not found to differ.", "The generator language writes %s and %d for numbers.", "Use it:\n```\nprint('{{ name }}')\n```\nThat is all.", LONG,
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    from lectern.llm.residue import find_residue

    assert find_residue(text) and find_residue("An ordinary sentence stands before it. " + text)


@pytest.mark.parametrize("text", CONTENT)
def test_writing_about_residue_is_content(text):
    from lectern.llm.residue import find_residue

    assert not find_residue(text)


def test_residue_of_a_table(spark):
    from lectern.llm.residue import residue, without_residue

    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*RESIDUE, *CONTENT])], "doc_id bigint, text string, kinds string")
    assert sorted(r["doc_id"] for r in residue(docs).collect()) == list(range(len(RESIDUE)))
    assert without_residue(docs).count() == len(CONTENT) and residue(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Dear {FIRST_NAME}, we write.", "Dear {name}, hello.", "{First Name}, hello.", "Dear [NAME], hello.", "Dear [First Name], hello.", "Dear %name%, hello.", "Dear <first_name>, hello.", "The title is #{title} here.", "Dear :name, hello."])
def test_placeholders_of_any_identifier(text):
    from lectern.llm.residue import find_residue

    assert find_residue(text)


@pytest.mark.parametrize(
    "text",
    [
        "We discuss the filler “lorem ipsum dolor sit amet consectetur”, which printers use.", "The gene BRCA XXXX was found.", "It was a very very very very very very good thing.", "In this tutorial we explain the Jinja template language. Write {{ name }} in the page.",
        "The set {a, b} and \\emph{name} and x_{max} hold [12] [Smith] [sic].", "<abstract>We do</abstract> see [MASK] tokens: ratio 3:4 and std::vector.",
    ],
)
def test_mentions_are_content(text):
    from lectern.llm.residue import find_residue

    assert not find_residue(text)


# ---- p2 ----
CUT = {
    "Dr. Smith et al. (2010) came, e.g. here. They saw.": ["Dr. Smith et al. (2010) came, e.g. here.", "They saw."],
    "“Is it so?” asked she. It is.": ["“Is it so?” asked she.", "It is."],
    "He wrote, “It ends. It begins.” Then rest.": ["He wrote, “It ends. It begins.”", "Then rest."],
    "(See Fig. 4.) A next one.[3,4] And 1.5 more! 1. An item.": ["(See Fig. 4.)", "A next one.[3,4]", "And 1.5 more!", "1. An item."],
    "„Gut?“, sagte Fr. Dr. Maier. Am 3. Mai kam z. B. er.": ["„Gut?“, sagte Fr. Dr. Maier.", "Am 3. Mai kam z. B. er."],
    "他写道：“好。很好。”“对吗？”他问。为什么？": ["他写道：“好。很好。”", "“对吗？”他问。", "为什么？"],
    "Γιατί ο δείκτης; Η τιμή έφτασε το 3,6.": ["Γιατί ο δείκτης;", "Η τιμή έφτασε το 3,6."],
    "One; two. —¿Qué? —dijo él. Fin": ["One; two.", "—¿Qué? —dijo él.", "Fin"],
    "मान 3.5 हो गया। क्या यह है?": ["मान 3.5 हो गया।", "क्या यह है?"],
    "  spaced.  \n\n Out.  ": ["spaced.", "Out."],
}


@pytest.mark.parametrize("text", list(CUT))
def test_sentences(text):
    from lectern.llm.sentences import split

    assert [text[a:z] for a, z in split(text)] == CUT[text]


@pytest.mark.parametrize("marks", ['"%s"', "“%s”", "«%s»", "(%s)"])
@pytest.mark.parametrize("inner", [1, 5, 6, 40, 80])
def test_a_quotation_inside_a_sentence_does_not_end_it(marks, inner):
    from lectern.llm.sentences import split

    text = "He said " + marks % " ".join(["Go on now!"] * inner) + " and left. Then he came."
    assert [text[a:z] for a, z in split(text)][-1] == "Then he came." and len(split(text)) == 2


def test_spans_reach_back_over_any_number_of_candidates():
    from lectern.llm.sentences import split

    text = "We thank " + ", ".join(f"{c}. Name" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 10) + " for all. Then he came."
    assert [text[a:z] for a, z in split(text)][1:] == ["Then he came."]
    assert split('A 5" pipe is long. We see 6" here. End.') == [(0, 18), (19, 34), (35, 39)]


def test_sentences_cover_the_text(spark):
    from lectern.llm.sentences import sentences, split

    r = random.Random(8)
    for _ in range(200):
        t = "".join(r.choice("ab A.?!“”()。 \n1;«»") for _ in range(80))
        spans = split(t)
        assert all(a < z and t[a:z] == t[a:z].strip() for a, z in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join(t[a:z] for a, z in spans).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")
    rows = spark.createDataFrame([(1, "Aa bb. Cc dd.", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x"), (5, " ", "x")], "scidoc_id bigint, text string, sent_no string")
    got = sorted(map(tuple, sentences(rows, "scidoc_id").collect()))
    assert got == [(1, 1, 0, 6), (1, 2, 7, 13), (4, 1, 0, len(LONG) - 1)]
    assert sentences(rows.limit(0), "scidoc_id").count() == 0


# ---- p3 ----
PAGE = "The classifiers improve the evalua-\ntion of docurnents and expand the me\nasures over the Kizu-\n\nJournal of Things, Vol. 4\n— 12 —\n\nbaru score. We m e a s u r e them and rank the\nsco res of the documents here.\n3.2 Results\n12  40  0.5\n"


def test_page_noise():
    from lectern.llm.pages import Lexicon, repairs

    lex = Lexicon({w: 500 for w in "the classifiers improve evaluation of documents and expand measure scores over score we them rank here results measures".split()})
    found, paragraphs = repairs(PAGE, lex)
    assert set(found) == {(1, "hyphen", "evaluation"), (2, "char", "documents"), (3, "hyphen", "Kizubaru"), (5, "furniture", ""), (6, "furniture", ""), (8, "space", "measure"), (9, "space", "scores")}
    assert paragraphs[-2:] == ["3.2 Results", "12 40 0.5"] and "Kizubaru score. We measure them" in paragraphs[0] and "Journal" not in " ".join(paragraphs)
    assert repairs(None, lex) == ([], []) and repairs(" \n", lex) == ([], [])


def test_what_follows_what_is_learned(spark):
    from lectern.llm.pages import BODY, FURNITURE, label, learn_steps, steps_from

    body = "the classifiers improve the evaluation of documents and\nexpand the measures of scores over them and we rank the\nresults here in the order of their measure over all the"
    page = f"{body}\n\nMulevez et al.\n12\n\n{body}"
    step = learn_steps(spark.createDataFrame([(page,), (None,), (" ",)] * 20, "text string"))
    assert step[FURNITURE][FURNITURE] > 0 > step[FURNITURE][BODY] and label(page, step)[4:6] == [FURNITURE, FURNITURE]
    assert max(abs(x) for row in steps_from([[0.0] * 5] * 5) for x in row) < 1e-9


def test_page_noise_of_a_table(spark):
    from lectern.llm.pages import page_noise, paragraphs

    clean = "The classifiers improve the evaluation of documents and expand the measures.\n" * 30
    rows = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, clean, "x"), (5, LONG, "x")], "scidoc_id bigint, text string, noise string")
    got = set(map(tuple, page_noise(rows, "scidoc_id").collect()))
    assert (1, 1, "hyphen", "evaluation") in got and (1, 6, "furniture", "") in got and all(r[0] == 1 for r in got)
    assert paragraphs(rows, "scidoc_id").where("scidoc_id = 4").count() >= 1 and page_noise(rows.limit(0), "scidoc_id").count() == 0


# ---- p4 ----
def _author(guid, name, aff=None, papers=(), surname=None):
    return (guid, name, surname, json.dumps({"affiliation": [{"name": aff}] if aff else [], "papers": list(papers)}))


AUTHORS = [
    _author("A1", "Katherine B. Smith", "University of Ada"), _author("a2", "Smith, K.B.", "Univ. of Ada"), _author("a3", "Kate Smtih", "U. of Ada"), _author("a4", "SMITH KB", None, ["p1"]), _author("a5", "Smith Katherine", "Dept. of X, University of Ada", ["p1"]),
    _author("b1", "Katherine C. Smith", "Third Institute"), _author("c1", "Katherine Smith", "Other College"), _author("g1", "on behalf of the Foo Data Network", "College of Z"), _author("g2", "Network, Foo Data", "College of Z"), _author("g3", "Foo Data Consortium", "College of Z"),
    ("n1", None, None, None), ("n2", "", "", "no json"), _author("A1", "Katherine B. Smith", "University of Ada"), (None, "X", "Y", None),
]


def test_sole_namesakes_equal_those_of_all_pairs(spark):
    from lectern.llm.people import _SEP, weak_edges

    r = random.Random(4)
    names = [("p", r.choice(["smith", "smyth", "jones"]), r.choice(["anna", "ann", "bert"]), r.choice(["", "c"])) for _ in range(60)]
    rows = [(i, [_SEP.join(n)], r.random() < 0.5) for i, n in enumerate([*names, ("p", "miller", "rosa", ""), ("p", "miller", "rosa", "q"), ("p", "xu", "wei", ""), ("p", "xu", "wei", ""), ("p", "xu", "wei", "")])]
    rows = [(i, s, placed and i != 60) for i, s, placed in rows]
    profiles = spark.createDataFrame(rows, "pid bigint, s array<string>, placed boolean")
    keys = spark.createDataFrame([(i, f"c|{s[0].split(_SEP)[1][0]}") for i, s, _ in rows], "pid bigint, key string")
    cut, whole = ({tuple(x) for x in weak_edges(profiles, keys, block=3, stand=stand).collect()} for stand in (True, False))
    assert cut == whole and (60, 61) in cut


def test_blocks_of_any_size_give_the_same_entities(spark):
    from lectern.llm.people import resolve

    r = random.Random(5)
    rows = [_author(f"h{i:02d}", f"{r.choice(['Katherine', 'Kate', 'K.', 'Kathrine'])} {r.choice(['B. ', ''])}{r.choice(['Smith', 'Smiht', 'Smyth', 'Smitt'])}", "University of Ada") for i in range(60)]
    authors = spark.createDataFrame(rows, "GUID string, full_name string, surname string, metadata string")
    assert {tuple(x) for x in resolve(authors, block=1000).collect()} == {tuple(x) for x in resolve(authors, block=7).collect()}


def test_names(spark):
    from lectern.llm.people import resolve, same_pairs

    e = resolve(spark.createDataFrame(AUTHORS, "GUID string, full_name string, surname string, metadata string"))
    of = {r["guid"]: r["entity"] for r in e.collect()}
    assert len(of) == 12 and {of[g] for g in ("A1", "a2", "a3", "a4", "a5")} == {"A1"}
    assert of["g1"] == of["g2"] == "g1" and of["g3"] == "g3" and of["b1"] == "b1" and of["c1"] == "c1" and of["n1"] == "n1"
    pairs = {tuple(r) for r in same_pairs(e).collect()}
    assert len(pairs) == 11 and all(a < b for a, b in pairs) and ("a2", "a5") in pairs


def test_no_authors(spark):
    from lectern.llm.people import resolve

    assert resolve(spark.createDataFrame([], "GUID string, full_name string, surname string, metadata string")).count() == 0


def test_distance_with_swaps():
    from lectern.llm.people import distance, institution

    assert distance("dbeorah", "deborah") == 1 and distance("kate", "kate") == 0 and distance("abc", "xyzw") == 3
    assert institution("School of X, Natl. Lab. Ada") == institution("National Laboratory Ada") != institution("University of Ada")


# ---- p5 ----
def test_levenshtein_is_exact():
    from lectern.llm.matching import levenshtein
    from lectern.llm.people import distance

    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert levenshtein(a, b) == row[-1]
    del distance


def test_distances_of_many_pairs_equal_those_of_each():
    from lectern.llm.matching import distances, levenshtein, similarities

    r = random.Random(8)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = [(word(r.randrange(0, most), "abcd"), word(r.randrange(0, most), "abcde")) for most in (3, 12, 70, 140, 300) for _ in range(60)]
    pairs += [(word(n, "ab"), word(m, "ab")) for n in (63, 64, 65, 128, 129) for m in (1, 64, 200)] + [(a, a[1:] + "z") for a, _ in pairs if a]
    pairs += [("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30)), "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40))) for _ in range(50)]
    one, two = map(list, zip(*pairs, strict=True))
    assert distances(one, two).tolist() == [levenshtein(a, b) for a, b in pairs] and len(distances([], [])) == 0
    title, cut = similarities(["abcdefgh", "abcdefgh", "", "abcdefghij"], ["abcdefghijklmnop", "xxxxxxxxabcdefgh", "abc", "abcdefghij"])
    assert title.tolist() == [0.5, 0.5, 0.0, 1.0] and cut.tolist() == pytest.approx([0.9, 0.9, 0.0, 1.0])


def test_nodes_met_before_sum_to_the_same_vectors(monkeypatch):
    from lectern.llm import matching as M

    rng = np.random.default_rng(3)
    space = M.Space(rng.standard_normal((M.NODES, M.DIMENSIONS)).astype(np.float32), rng.random(M.NODES).astype(np.float32), np.zeros(M.DIMENSIONS, np.float32), 9)
    records = [(t, s, y, d) for _, t, s, y, d in _works(40)] + [(None, None, None, None), ("a b c", "", "1999", None)]
    read = [M.prepare(*x) for x in records]
    marked = [M._marked(x["words"].split(), x["people"].split(), x["year"], x["doi"]) for x in read]
    monkeypatch.setattr(M, "WORDS_HELD", 30)
    nodes = M.Nodes(space)
    for lo in range(0, len(marked), 7):
        part = nodes.by_part(marked[lo : lo + 7])
        for k in part:
            sums, some = space.sums([M.tokens(*x)[k] for x in records[lo : lo + 7]])
            assert np.allclose(part[k][0], sums, atol=1e-4) and (part[k][1] == some).all()
    want = np.zeros(M.NODES, np.int64)
    for x in records:
        want[list({n for own in M.tokens(*x).values() for n, _ in own})] += 1
    assert (M.Nodes().frequencies(marked) == want).all()


def _works(n):
    r = random.Random(9)
    syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()
    name = lambda k: "".join(r.choice(syllables) for _ in range(k))
    return [(f"g{i}", f"towards {name(2)} {name(2)} {name(3)} using {name(4)}", "; ".join(name(3) for _ in range(r.randrange(1, 4))), str(1990 + r.randrange(30)), f"10.9999/{i}" if i % 2 else None) for i in range(n)]


def test_matching_recall_and_precision(spark):
    from lectern.llm.matching import match_records

    works = _works(400)
    r = random.Random(2)
    records = []
    for i, (_, t, s, y, d) in enumerate(works[:200]):
        k = r.randrange(len(t) - 3)
        typo = t[:k] + t[k + 1] + t[k] + t[k + 2 :]
        records.append((i, " and ".join(f"{x.title()}, A." for x in s.split("; ")), r.choice([t.title(), typo, t[: int(len(t) * 0.8)] + "..."]), None, y if r.random() < 0.9 else None, d if r.random() < 0.3 else None))
    records += [(1000 + i, f"{s.split('; ')[0]}", t, None, y, None) for i, (_, t, s, y, _) in enumerate(_works(500)[400:])]
    records += [(3000, None, None, None, None, None), (3001, "", "", "", "", "")]
    A = spark.createDataFrame(records, "rec_id bigint, author string, title string, venue string, year string, doi string")
    P = spark.createDataFrame([*works, *works[:50], ("none", None, None, None, None), (None, "x", None, None, None)], "GUID string, norm_title string, surnames string, year string, DOI string")
    got = match_records(A, P).collect()
    right = sum(x["guid"] == f"g{x['rec_id']}" for x in got)
    assert right >= 0.9 * 200 and right >= 0.97 * len(got) and len({x["rec_id"] for x in got}) == len(got) and all(0.5 <= x["confidence"] <= 1 for x in got)


def test_matching_of_nothing(spark):
    from lectern.llm.matching import match_records

    A = spark.createDataFrame([], "rec_id bigint, author string, title string, venue string, year string, doi string")
    P = spark.createDataFrame([("g", "some title", "x", "1999", None)], "GUID string, norm_title string, surnames string, year string, DOI string")
    assert match_records(A, P).count() == 0
    B = spark.createDataFrame([(1, "x", "some title", None, "1999", None)], A.schema)
    assert match_records(B, P.limit(0)).count() == 0


def test_calibration_leans_to_the_labels_but_not_to_wrong_ones():
    from lectern.llm.matching import N_COSINES, PRIOR, WEIGHTS, calibrate, confidence

    x = np.zeros((300, len(WEIGHTS) - 1 + N_COSINES))
    x[:100, :2], x[:100, 3] = 0.95, 1.0
    x[100:, 1] = 0.5
    x[:, -N_COSINES:] = np.r_[np.full(100, 0.9), np.full(200, 0.3)][:, None]
    y = np.r_[np.ones(100), np.zeros(200)]
    c = confidence(x, calibrate(x, y))
    assert c[:100].min() > 0.9 > 0.1 > c[100:].max() and (calibrate(x[:0], y[:0]) == PRIOR).all()
    wrong = np.r_[np.zeros(100), np.ones(200)]
    c = confidence(x, calibrate(x, wrong))
    assert c[:100].min() > 0.5 > c[100:].max()


def test_titles_and_names_of_any_script_match(spark):
    from lectern.llm.matching import match_records, tokens

    works = [("g1", "基于图的引文推荐方法研究", "王伟; 李娜", "2011", None), ("g2", "анализ контекста цитирования научных статей", "Иванова; Петров", "2004", None), ("g3", "سلوك الاستشهاد في المقالات", "حسن", "1999", None)]
    assert all(tokens(t, p, None, None)["head"] and tokens(t, p, None, None)["people"] for _, t, p, _, _ in works)
    records = [(1, "王伟; 李娜", "基于图的引文推荐方法研宄", None, "2011", None), (2, "Иванова, И. and Петров, П.", "Анализ контекста цитирования научных статей.", None, None, None), (3, "حسن", "سلوك الاستشهاد في المقالات", None, "1999", None)]
    A = spark.createDataFrame(records, "rec_id bigint, author string, title string, venue string, year string, doi string")
    P = spark.createDataFrame([*works, *_works(50)], "GUID string, norm_title string, surnames string, year string, DOI string")
    assert {(x["rec_id"], x["guid"]) for x in match_records(A, P).collect()} == {(1, "g1"), (2, "g2"), (3, "g3")}


def test_tables_keep_the_chance_of_a_close_pair():
    from lectern.llm.matching import CHANCE, tables_of

    met = [1 - (1 - CHANCE**b) ** sum(n for _, n in tables_of(b)) for b in (15, 18, 21, 25, 31)]
    assert min(met) >= met[0] - 1e-9 and max(met) < met[0] + 0.15


def test_matching_in_a_bucket_of_a_third_of_the_papers(spark, monkeypatch):
    from lectern.llm import matching

    works = _works(240)
    works = [(g, f"annual report of the {t.split()[-1]}" if i % 3 == 0 else t, s, y, None) for i, (g, t, s, y, _) in enumerate(works)]
    r, records = random.Random(5), []
    for i in range(0, 240, 3):
        _, t, s, y, _ = works[i]
        k = r.randrange(len(t) - 10, len(t) - 2)
        records.append((i, s.split("; ")[0], t[:k] + t[k + 1] + t[k] + t[k + 2 :], None, y if i % 2 else None, None))
    A = spark.createDataFrame(records, "rec_id bigint, author string, title string, venue string, year string, doi string")
    P = spark.createDataFrame(works, "GUID string, norm_title string, surnames string, year string, DOI string")

    def found(crowded):
        monkeypatch.setattr(matching, "CROWDED", crowded)
        return {tuple(x) for x in matching.match_records(A, P).collect()}

    whole = found(10**6)
    assert len(whole) >= 70 and found(4) == whole


def test_matching_exchanges_few_tables_at_a_time(spark, monkeypatch):
    from pathlib import Path

    from lectern.llm import matching
    from lectern.plans import session

    works = _works(120)
    records = [(i, s.split("; ")[0], t[:6] + t[7:], None, y, None) for i, (_, t, s, y, _) in enumerate(works[::2])]
    A = spark.createDataFrame(records, "rec_id bigint, author string, title string, venue string, year string, doi string")
    P = spark.createDataFrame(works, "GUID string, norm_title string, surnames string, year string, DOI string")
    write, names = session.written, []

    def noted(df, name="stage"):
        out = write(df, name)
        names.append((name, out.written_at.removeprefix("file:")))
        return out

    monkeypatch.setattr(session, "written", noted)

    def found(rows):
        names.clear()
        monkeypatch.setattr(matching, "ROUND_ROWS", rows, raising=False)
        return {tuple(x) for x in matching.match_records(A, P).collect()}

    whole, at_once = found(10**9), [n for n, _ in names]
    monkeypatch.setattr(matching, "ROUND_PAIRS", 0)
    parts = found(30)
    kinds = [n for n, _ in names]
    assert len(whole) >= 50 and parts == whole
    assert at_once.count("met") == 1 and kinds.count("met") == -(-sum(n for _, n in matching.tables_of(8)) // matching.ROUND_TABLES) and kinds.count("scored") > 1
    # What has been used is gone.
    assert {n for n, p in names if Path(p).exists()} == {"scored"}
