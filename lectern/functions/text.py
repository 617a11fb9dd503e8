"""Text scalars as column expressions; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token class, the symbol class of titles and the stopwords of queries.
TOKEN = r"[\p{L}\p{N}_]+"
SYMBOLS = r"""["#$%&\\'()*+,\-./:;<=>?¿!¡@\[\]^_`{|}~]"""
STOPWORDS = ["~", "the", "and", "or", "not", "of", "to", "from", "by", "with", "a", "an"]
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
#: Marks of citations in text.
AUTHOR_YEAR = r"\b[A-Z][\w'’-]+(?: (?:and|&) [A-Z][\w'’-]+| et al\.)?,? \(?(?:1[89]|20)\d\d[a-z]?\)?"
_NAME = r"\p{Lu}[\p{L}\p{M}\p{N}_'’-]+"
ANY_AUTHOR_YEAR = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]){_NAME}(?: (?:and|&) {_NAME}| et al\.)?,? \(?(?:1[89]|20)\d\d[a-z]?\)?"
NUMBERED = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"
#: Generic sections and the words that speak for them, as often as they stand here.
SECTIONS = {
    "Introduction": "introduction", "Abstract": "abstract", "Conclusion": "conclusion concluding remarks conclusions", "Future work": "future future future", "Data": "data corpus corpora statistics dataset datasets corpus corpus",
    "Related work": "previous work related works comparison", "Results/Discussion": "discussion discussions results", "Problem": "problem task", "Motivation": "background motivation problem formalism idea example investigating",
    "Methodology": "methods method methodology feature features algorithm heuristic our approach preprocessing model training measure measures framework", "Implementation": "implementation overview",
    "Experiments": "experiment experiments experimental experimentation", "Evaluation": "evaluation evaluating judgement analysis test performance", "Acknowledgements": "acknowledgements",
}


def tokens(col: Column | str) -> Column:
    """Words in small letters; null for null."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), 0)


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.isin(STOPWORDS))


def remove_symbols(col: Column | str) -> Column:
    return F.regexp_replace(col, SYMBOLS, " ")


def normalize_title(col: Column | str) -> Column:
    """Small letters, line-end hyphens closed up, symbols to single blanks, at most 200 characters."""
    t = F.replace(F.replace(F.lower(col), F.lit("-  "), F.lit("")), F.lit("- "), F.lit(""))
    return F.substring(F.trim(F.regexp_replace(remove_symbols(t), r"\s+", " ")), 1, 200)


def clear_tabs(col: Column | str) -> Column:
    return F.translate(col, "\t\n\r", "   ")


def clean_xml(col: Column | str) -> Column:
    return F.regexp_replace(col, r"</?[^<>]+>", " ")


def remove_citations(col: Column | str) -> Column:
    """Citation elements vanish, footnote tags become blanks."""
    return F.regexp_replace(F.regexp_replace(col, r"(?i)<cit[^<>]*/>", ""), r"(?i)</?footnote[^<>]*>", " ")


def remove_urls(col: Column | str) -> Column:
    return F.regexp_replace(col, URL, "")


def remove_bracketed_citations(col: Column | str) -> Column:
    """Author-year citations in round brackets, and numbered ones in square brackets."""
    t = F.regexp_replace(col, r"\([^()]*(?:1[89]|20)\d\d[a-z]?[^()]*\)", "")
    return F.regexp_replace(t, NUMBERED, "")


def citation_tokens(col: Column | str) -> Column:
    """<CIT ID=citN/> as the word __citN."""
    return F.regexp_replace(col, r"(?i)<cit id=(\w+)\s*/>", " __$1 ")


def first_number(col: Column | str) -> Column:
    return F.expr(f"try_cast(regexp_extract({_name(col)}, '[0-9]+', 0) as bigint)")


def _name(col: Column | str) -> str:
    if not isinstance(col, str):
        raise TypeError("a column name is needed")
    return f"`{col}`"


def leave_one_citation(words: Column, keep: Column | str) -> Column:
    """Among word tokens the one kept as __cit; other citation tokens are dropped."""
    own = F.lit(keep) if isinstance(keep, str) else keep
    marked = F.transform(words, lambda t: F.when(t == own, F.lit("__cit")).otherwise(t))
    return F.filter(marked, lambda t: ~(t.startswith("__cit") & (t != "__cit")))


def word_count(col: Column | str) -> Column:
    """Half the word tokens, rounded down."""
    return F.shiftright(F.regexp_count(col, F.lit(r"\w+")), 1)


def citation_style(col: Column | str) -> Column:
    """AFI where numbered citations outnumber author-year ones, APA where there are any, null where there is none. Names may have letters of any script."""
    a, n = F.regexp_count(col, F.lit(ANY_AUTHOR_YEAR)), F.regexp_count(col, F.lit(NUMBERED))
    return F.when(n > a, "AFI").when(a > 0, "APA")


def numbered_list(col: Column | str) -> Column:
    """The numbers of a citation such as [1,2,5-7], ranges spelled out; backward ranges and those with a number of more than four digits, which is no reference, keep their ends."""
    parts = F.split(F.regexp_replace(col, r"[\[\]\s]", ""), ",")

    def spell(p: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), 0), lambda x: x.cast("int"))
        a, z = F.get(ends, 0), F.get(ends, F.size(ends) - 1)
        return F.when((F.size(ends) == 2) & (z >= a) & (z <= 9999), F.sequence(a, z)).otherwise(ends)

    return F.flatten(F.transform(parts, spell))


def citation_clusters(starts: str = "start", ends: str = "end", gap: int = 7) -> tuple[Column, Column]:
    """(is new cluster, nothing else): a citation begins a cluster if it starts more than ``gap`` characters after the one before ends; use over an ordered window."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc", "sentence").orderBy(starts)
    return F.coalesce(F.col(starts) - F.lag(ends).over(w) > gap, F.lit(True)), F.col(starts)


def author_parts(col: Column | str) -> Column:
    """(family, given): before and after a comma, else the last word and the rest; trailing initials put the family first."""
    t = F.trim(F.regexp_replace(col, r"\s+", " "))
    ws = F.split(t, " ")
    n = F.size(ws)
    initials = F.element_at(ws, -1).rlike(r"^(?:[A-Z]\.?)+$") & (n > 1)
    comma = F.instr(t, ",") > 0
    family = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(1)))).when(initials, F.get(ws, 0)).otherwise(F.element_at(ws, -1))
    given = F.when(comma, F.trim(F.split_part(t, F.lit(","), F.lit(2)))).when(initials, F.array_join(F.slice(ws, 2, n), " ")).otherwise(F.array_join(F.slice(ws, 1, n - 1), " "))
    return F.when(t != "", F.struct(family.alias("family"), given.alias("given")))


def reference_name(given: Column, family: Column) -> Column:
    """J. Smith"""
    return F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.upper(F.substring(given, 1, 1)), F.lit(". "), family)).otherwise(family)


def in_text(surnames: Column, year: Column) -> Column:
    """(A, 2001), (A and B, 2001) or (A et al., 2001)"""
    n = F.size(surnames)
    who = F.when(n == 1, F.get(surnames, 0)).when(n == 2, F.concat(F.get(surnames, 0), F.lit(" and "), F.get(surnames, 1))).otherwise(F.concat(F.get(surnames, 0), F.lit(" et al.")))
    return F.when(n > 0, F.concat(F.lit("("), who, F.lit(", "), F.coalesce(year, F.lit("n.d.")), F.lit(")")))


def generic_section(header: Column | str) -> Column:
    """The generic section whose words the header has most often, empty for none. At ties the one whose word comes first in the header, then in the list."""
    words = F.filter(F.split(F.lower(header), r"[\s\d,./:;-]+"), lambda w: w != "")

    def scored(k: int, name: str, own: Column) -> Column:
        n = F.aggregate(words, F.lit(0), lambda s, w: s + F.size(F.filter(own, lambda x: x == w)))
        at = F.array_position(F.transform(words, lambda w: F.array_contains(own, w)), True)
        return F.struct(n.alias("n"), (-at).alias("at"), F.lit(-k).alias("k"), F.lit(name).alias("name"))

    best = F.array_max(F.array(*[scored(k, name, F.array(*map(F.lit, ws.split()))) for k, (name, ws) in enumerate(SECTIONS.items())]))
    return F.when(best["n"] > 0, best["name"]).when(words.isNotNull(), F.lit(""))


def chance_mrr(n: Column | str) -> Column:
    """Mean reciprocal rank of one match at a random place among n."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i) / n)


def rank_of_mrr(mrr: Column | str) -> Column:
    mrr = F.col(mrr) if isinstance(mrr, str) else mrr
    return F.when(mrr > 0, F.round(F.lit(1.0) / mrr).cast("int")).otherwise(-1)


def sigmoid(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def most_common(items: Column) -> Column:
    """The most frequent element of an array, the earliest at ties."""
    scored = F.transform(F.array_distinct(items), lambda x: F.struct(F.size(F.filter(items, lambda y: y == x)).alias("n"), (-F.array_position(items, x)).alias("at"), x.alias("x")))
    return F.array_max(scored).getField("x")


def author_overlap(surnames: Column, authors: Column) -> Column:
    """Share of the surnames contained in some author's name."""
    hit = F.size(F.filter(surnames, lambda s: F.exists(authors, lambda a: F.contains(a, s))))
    return F.when(F.size(surnames) > 0, hit / F.size(surnames)).otherwise(0.0)


def quadratic(x: Column | str) -> Column:
    """x squared, from 0 to 1 over the same interval."""
    x = F.col(x) if isinstance(x, str) else x
    return F.pow(x, F.lit(2.0))


def as_list(col: Column | str) -> Column:
    """A scalar as a list of one, an empty one for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


#: Words after whose dot no sentence begins.
NO_END = "Dr|Mr|Mrs|Ms|Prof|St|vs|etc|cf|Fig|Figs|Eq|Eqs|Sec|No|al|e\\.g|i\\.e|resp|approx"


def sentence_split(col: Column | str) -> Column:
    """The sentences of a text by its stops: cut after . ! ? and closing marks where a capital, a number or an opening mark goes on, but not after titles and abbreviations; empty for null."""
    cut = rf"(?<=[.!?][\"'”’)\]]{{0,2}})(?<!\b(?:{NO_END})\.)(?<!\b\p{{Lu}}\.)\s+(?=[\"'“‘(\[]?[\p{{Lu}}\p{{N}}])"
    return F.filter(F.transform(F.split(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), cut), lambda s: F.trim(s)), lambda s: s != "")


def parse_citation(col: Column | str) -> tuple[Column, Column]:
    """(authors, year) of an in-text citation: two names, one before et al., or the first word; year null where there is none."""
    c = F.col(col) if isinstance(col, str) else col
    year = F.nullif(F.regexp_extract(c, r"((?:1[89]|20)\d\d[a-z]?)", 1), F.lit(""))
    name = r"([\p{Lu}][\p{L}'’-]+)"
    two, one = rf"{name},? (?:and|&) {name}", rf"{name},? et al"
    first = F.regexp_extract(F.regexp_replace(c, r"[,.()\[\]]", " "), r"^\s*(\S+)", 1)
    authors = F.when(c.rlike(two), F.array(F.regexp_extract(c, two, 1), F.regexp_extract(c, two, 2))).when(c.rlike(one), F.array(F.regexp_extract(c, one, 1))).otherwise(F.array(first))
    return F.filter(authors, lambda a: a != ""), year


#: What stands before a family name in small letters.
NAME_PREFIXES = r"(?:von der|van der|van den|de la|von|van|de|del|di|da|le|la|ter|ten)"


def normal_case(col: Column | str) -> Column:
    """A name with a capital first and the rest small, prefixes small."""
    low = F.trim(F.lower(col))
    prefix = F.regexp_extract(low, rf"^({NAME_PREFIXES}\s+)(?=\S)", 1)
    rest = F.regexp_replace(low, rf"^{NAME_PREFIXES}\s+(?=\S)", "")
    return F.concat(prefix, F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))


def apa_authors(surnames: Column, most: int = 6) -> Column:
    """Surnames as a citation lists them: names all in capitals in normal case, the last after an ampersand, et al. beyond ``most``."""
    fixed = F.transform(surnames, lambda s: F.when((F.upper(s) == s) & (F.length(s) > 2), normal_case(s)).otherwise(s))
    n = F.size(fixed)
    head = F.array_join(F.slice(fixed, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > most, F.concat(F.get(fixed, 0), F.lit(" et al."))).when(n > 1, F.concat(head, F.lit(" & "), F.element_at(fixed, -1))).when(n == 1, F.get(fixed, 0)).otherwise("")


def cache_key(kind: str, guid: Column | str, *parameters: object) -> Column:
    """The name under which a made representation of a paper is kept."""
    return F.concat_ws("_", F.lit(kind), F.col(guid) if isinstance(guid, str) else guid, *[F.lit(str(p)) for p in parameters])
