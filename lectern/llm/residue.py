"""Template residue and error-page text.

Placeholders are found by one grammar for each kind of delimiter, filler and messages of servers and scripts by grammars over
sentences. A hit counts only if its surroundings don't make it a subject of discussion: code blocks are cut out, hits that the
words around them introduce (a slot, a tag, a phrase ...) are discounted, and so are hits of a text that is dense with such mentions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.llm.shared import full_frames

_CODE = re.compile(r"```.*?```|~~~.*?~~~|<(code|pre|kbd|samp)\b[^>]*>.*?</\1>|`[^`\n]{1,200}`|(?:^|\n)(?: {4}|\t)[^\n]*[{};=][^\n]*(?=\n|$)|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", re.S | re.I)
#: Element names of mark-up, which in angle brackets are no slots.
_HTML = "a|abbr|b|bib|body|br|cit|cite|code|dd|div|dl|dt|em|fig|font|footer|formula|h[1-6]|head|header|hr|html|i|img|italic|kbd|label|li|math|ol|p|pre|q|ref|s|samp|script|sec|section|small|span|strong|sub|sup|table|tbody|td|th|title|tr|tt|u|ul|var|xref"
_NAME = r"[A-Za-z][\w .:|-]{0,40}"
#: Words that name a field of a form or letter (fixed values).
_FIELDS = set(
    "name names firstname lastname surname forename fullname username title subtitle author authors editor date time year month day address street city state country zip postcode email mail phone telephone fax number company "
    "organisation organization affiliation institution institute department university journal venue publisher conference volume issue pages subject topic theme keyword keywords abstract summary text content body paragraph section chapter "
    "url link website doi id user recipient sender customer client position role job product item price amount description image figure caption table reference citation quote location place project grant funder signature insert placeholder value variable field".split()
)
#: Marks and special tokens that stand in brackets as content (fixed values).
_MARKS = set("sic cls sep mask unk pad bos eos inst doi pdf html online editor editors emphasis translation".split())
_IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+){0,4}"
#: Grammars by delimiter, each beside a text without which none can match.
PLACEHOLDERS: dict[str, tuple[tuple[str, ...], str]] = {
    "double_brace": (("{{",), rf"\{{\{{\s*[#/^&>]?\s*{_NAME}\s*\}}\}}"),
    "block": (("{%",), r"\{%-?\s*[A-Za-z][^%{}]{0,60}-?%\}"),
    "server_tag": (("<%", "<?"), r"<%[=#-]?\s*[^%<>]{1,60}%>|<\?(?:php|=)[^<>]{0,60}\?>"),
    "dollar": (("$",), r"\$\{\s*[A-Za-z_][\w.]*\s*\}|\$\([A-Za-z_]\w*\)|\$[A-Z][A-Z_]{2,}\b"),
    "brace": (("{",), rf"(?<![\w{{\\$^_])\{{\s*(?P<brace>{_IDENTIFIER})\s*\}}(?!\}})"),
    "interpolation": (("#{",), r"#\{\s*[A-Za-z_][\w.]*\s*\}"),
    "double_bracket": (("[[", "<<", "«"), rf"\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|«\s*[A-Z][A-Z_ ]+\s*»"),
    "bracket": (("[",), r"\[\s*(?:insert|your|add|enter|type|todo|tbd|tba|fixme|xxx|place|put|fill|describe|provide|replace|write)\b[^\[\]\n]{0,60}\]|\[\s*[A-Za-z]{2,20}\s*\?+\s*\]|\[\s*\?{2,}\s*\]"),
    "bracket_name": (("[",), rf"\[\s*(?P<bracket_name>{_IDENTIFIER})\s*\](?!\()"),
    "percent": (("%",), r"(?<![\w%])%[A-Za-z][A-Za-z_]{2,}%(?![\w%])|%\([a-z_]+\)[sd]"),
    "underscore": (("__",), r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)"),
    "at": (("@",), r"(?<!\w)@@\s*\w+\s*@@(?!\w)|(?<!\w)@[A-Z][A-Z_]{2,}@(?!\w)"),
    "hash": (("#",), r"(?<![\w#])#{1,2}[A-Za-z][A-Za-z_]{1,30}#{1,2}(?![\w#])"),
    "colon": ((":",), r"(?<![\w:/]):(?P<colon>[A-Za-z]+(?:_[A-Za-z]+)*)\b(?![:/\w])"),
    "escaped": (("&lt;",), rf"&lt;\s*(?!/?(?:{_HTML})\s*/?&gt;)[A-Za-z][A-Za-z_ ]{{1,30}}\s*&gt;"),
    "angle": (("<",), rf"<(?!(?i:/?(?:{_HTML})\s*/?>))(?:[A-Z][a-z]+(?:[ _][A-Z]?[a-z]+)*|(?:[Yy]our|[Ii]nsert|[Ee]nter|[Aa]dd)[ _][\w ]{{1,30}})>"),
    "angle_name": (("<",), rf"<(?!(?i:/?(?:{_HTML})\s*/?>))(?P<angle_name>{_IDENTIFIER})>"),
    "command": (("\\",), r"\\[A-Za-z]+\{\s*(?:type|enter|insert|your|add|write|put)\b[^{}]{0,60}\}"),
    "crosses": (("XX",), r"\bX{3,}(?:\s+et\s+al\.?|,)?\s*\(?\s*X{2,}\b\)?|(?<![A-Z0-9]\s)(?<![A-Z0-9]-)\bX{4,}\b"),
    "query": (("?",), r"\(\s*[A-Za-z]{2,20}\?\s*(?:[,;]\s*[A-Za-z]{2,20}\?\s*)+\)"),
    "to_do": (("TB", "TODO", "FIXME", "TKTK"), r"(?<![\w-])(?:(?:TBD|TBA|TBC)\b:?|(?:TODO|FIXME|TKTK)\s*:)"),
    "sample_name": (("name", "Name", "NAME"), r"\b(?:first\s?name\s+(?:last\s?name|surname)|given\s?name\s+(?:family\s?name|surname)|name\s+surname)\b"),
    "unset": (("nde", "NDE", "ull", "ULL", "an", "AN", "one", "ONE", "il", "IL", "bject", "BJECT"), r"\b(?:undefined|null|nan|none|nil)\s+\w+\s+(?:of|by|in|for|and|on|to)\s+(?:undefined|null|nan|none|nil)\b|\[object\s+object\]|\b(?:undefined|null|nan)(?:\s*,?\s*(?:undefined|null|nan)\b){1,}"),
}
_FOLD = {"bracket", "command", "sample_name", "unset", "query"}
_PLACE = [(k, needs, re.compile(p, re.I if k in _FOLD else 0)) for k, (needs, p) in PLACEHOLDERS.items()]


def _names_a_field(kind: str, name: str, body: str) -> bool:
    """Whether what stands in an open delimiter is the name of a field, rather than a word that the delimiter belongs to by rights.

    Braces hold any identifier of three letters or more; square brackets names of fields, or capitals that are no mark; colons and angles names of fields,
    the latter without a closing tag.
    """
    parts = [w for w in re.split(r"[ _.-]", name.lower()) if w]
    fields = sum(w in _FIELDS for w in parts)
    if kind == "brace":
        return len(name) >= 3 and (len(parts) == 1 or name.isupper() or name.istitle() or fields > 0 or " " not in name)
    if kind == "bracket_name":
        if any(w in _MARKS for w in parts) or any(c.isdigit() for c in name):
            return False
        return fields > 0 and (name.isupper() or name.istitle() and len(parts) > 1 or "_" in name) or name.isupper() and len(name) >= 5
    if kind == "angle_name":
        return fields > 0 and (len(parts) > 1 or name.isupper()) and f"</{name}" not in body
    return fields == len(parts) or "_" in name and fields > 0


#: Words of the common Latin filler text (fixed values).
_LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus vestibulum curabitur pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas praesent mauris fusce nec tellus felis porta nibh mollis lacus vitae ornare tempus nullam auctor purus congue vero at accusam justo duo dolores rebum stet clita kasd gubergren sea takimata consectus elitum sanctus donec faucibus orci luctus ultrices posuere cubilia suspendisse lobortis sapien integer aliquam phasellus sagittis augue risus semper nam cras".split()
)

_THING = r"(?:page|record|article|document|text|request|export|view|volume|content|contents|session|resource|file|site|website|abstract|paper|item|issue|link|url|address|doi|service|server|application|database|viewer|reader|download|pdf|figure|account|journal)"
_SUBJECT = rf"(?:(?:the|this|that|your|our|requested|no)\s+)(?:[\w’'-]+\s+){{0,3}}{_THING}s?(?:\s+(?:you|that you|we|which you)(?:\s+[\w’']+){{1,4}}|\s+site)?"
_FAILS = (
    r"(?:has|have)\s+(?:been\s+)?(?:moved|removed|deleted|expired|withdrawn|timed\s+out|blocked|retired|changed|ended|gone)|(?:has\s+)?timed\s+out|failed(?:\s+with\s+(?:code|error|status)\s*\d+|\s+to\s+(?:load|open|respond))|"
    r"(?:is|are|was|were)\s+(?:currently\s+|temporarily\s+|no\s+longer\s+|now\s+)?(?:unavailable|not\s+available|available\s+only\s+to|offline|down\b|unreachable|blocked|withdrawn|denied|forbidden|rejected|refused|not\s+found|missing\s+from|restricted|under\s+maintenance|under\s+construction|being\s+redirected|overloaded)|"
    r"(?:is\s+)?no\s+longer\s+(?:exists?|available)|requires?\s+(?:a\s+)?(?:log-?in|login|subscription|sign-?in|scripts?|scripting|javascript|cookies?|authentication|permission)|"
    r"needs?\s+(?:scripts?|scripting|javascript|cookies?|a\s+login)|(?:cannot|can\s?not|can['’]t|could\s+not|couldn['’]t)\s+be\s+(?:shown|loaded|found|displayed|opened|reached|processed|rendered|retrieved|located|completed|read|served)|"
    r"(?:does|do|did)(?:\s+not|n['’]t)\s+(?:exist|respond|load)|(?:were|was)\s+not\s+found|will\s+(?:load|appear|be\s+shown|be\s+displayed)\s+(?:once|when|after|if)|(?:has|have)\s+(?:scripting|scripts?|javascript|cookies?)\s+(?:switched|turned|disabled)|is\s+(?:not\s+)?(?:supported|accepting)\s+"
)
_MARK = r"(?:(?:fatal\s+|internal\s+|server\s+)?(?:error|warning|notice|attention|alert|failure|status|http(?:/\d(?:\.\d)?)?|code|sorry|oops|whoops|uh[- ]oh|we['’]re sorry|we are sorry)\b[\s:!,.–—-]*(?:\d{2,5}\b)?|[1-5]\d\d\b|\[[^\[\]\n]{3,80}\])[\s:!,.–—-]*"
#: Messages that are a whole sentence; each is matched from the start of a sentence.
MESSAGES: dict[str, str] = {
    "failed_thing": rf"(?:{_MARK}){{0,3}}{_SUBJECT}\s+(?:{_FAILS})",
    "status": r"(?:(?:http(?:/\d(?:\.\d)?)?|error|status)\s*[:#–-]?\s*)?(?:[45]\d\d)\s*[:–—-]?\s*(?:not\s+found|forbidden|bad\s+gateway|bad\s+request|gone|unauthori[sz]ed|internal\s+server\s+error|service\s+(?:temporarily\s+)?unavailable|gateway\s+time-?\s?out|too\s+many\s+requests|method\s+not\s+allowed|request\s+time-?out|payment\s+required|error)\b",
    "status_line": rf"(?:error|http|status)\s*(?:code\s*)?[:#]?\s*\d{{3,5}}\s*[:.–—-]\s*(?=\S)(?!.*\b(?:we|our)\b)",
    "server_error": r"(?:internal\s+)?server\s+error\b|bad\s+gateway\b|gateway\s+time-?out\b|service\s+(?:temporarily\s+)?unavailable\b|access\s+(?:to\s+this\s+\w+\s+(?:is|was)\s+)?(?:denied|forbidden|blocked)\b|permission\s+denied\b|page\s+not\s+found\b|file\s+not\s+found\b|too\s+many\s+requests\b|forbidden\s*[.!]|unauthori[sz]ed\s*[.!]|request\s+(?:timed?\s+out|blocked|failed)\b|connection\s+(?:refused|timed\s+out|reset)\b|(?:nginx|apache)(?:/[\d.]+)?\s*$",
    "permission": r"you\s+(?:do\s+not|don['’]t)\s+have\s+(?:the\s+)?(?:permission|access|rights)\b|you\s+are\s+not\s+(?:authori[sz]ed|allowed)\s+to\b|you\s+(?:must|need\s+to|have\s+to)\s+(?:be\s+)?(?:log(?:ged)?|sign(?:ed)?)[\s-]+in\b|(?:please\s+)?(?:log|sign)\s+in\s+(?:again\s+)?to\s+(?:continue|view|read|access|see)\b|your\s+session\s+(?:has\s+)?(?:expired|ended|timed\s+out)",
    "went_wrong": rf"(?:{_MARK})?something\s+went\s+wrong\b|(?:{_MARK})?an?\s+(?:unexpected\s+|unknown\s+|internal\s+)?error\s+(?:has\s+)?occurred\b|(?:{_MARK})could\s+not\s+(?:load|open|find|display|connect)\b|could\s+not\s+(?:load|connect\s+to)\s+(?:the\s+)?(?:document|page|record|server|database)\b|(?:if\s+the\s+problem\s+persists|please\s+try\s+again\s+(?:later|in)|try\s+again\s+later\b|slow\s+down\s+and\s+retry|contact\s+the\s+(?:site|system|web\s?site|server)\s+admin|reload\s+the\s+page\b|refresh\s+(?:the|this|your)\s+(?:page|browser)|go\s+back\s+to\s+the\s+(?:start|home)\s?page|clear\s+your\s+(?:browser\s+)?cache)",
    "trace": r"traceback\b\s*(?:\(most recent|:)|(?:\w+\.)*\w*(?:Exception|Error)\s*:\s*\S|(?:fatal\s+error|parse\s+error|warning|notice)\s*:\s*(?:undefined|uncaught|unexpected|call\s+to|include|require|mysql|cannot|division|trying|array|invalid)\b|uncaught\s+(?:type|reference|syntax)?error\b|stack\s+trace\s*:|segmentation\s+fault\s*(?:\(|$)",
    "scripts": r"(?:please\s+|you\s+(?:must|need\s+to|have\s+to|should)\s+)(?:enable|activate|allow|turn\s+on|switch\s+on)\s+(?:java\s?script|scripts?|scripting|cookies?)\b|(?:enable|activate|allow|turn\s+on)\s+(?:java\s?script|scripts?|cookies)\s+(?:to|in\s+your|and\s+(?:reload|refresh))\b|(?:java\s?script|scripts?|scripting|cookies?)\s+(?:must|has\s+to|have\s+to|needs?\s+to)\s+be\s+(?:enabled|turned|switched|allowed|accepted|activated|on)\b|(?:java\s?script|scripts?|scripting|cookies?)\s+(?:is|are)\s+(?:required|disabled|switched\s+off|turned\s+off|not\s+enabled|blocked)\b|(?:this|the)\s+\w+\s+(?:requires|needs|uses)\s+(?:java\s?script|scripts|cookies)\s*(?:[.!]|$|to\b)|your\s+browser\s+(?:has|does|is|must|cannot|blocks?)\b|you\s+need\s+(?:scripts?|java\s?script|cookies?)\s+to\s+\w+|<noscript>|we\s+use\s+cookies\b",
    "robot_check": r"checking\s+(?:if\s+)?your\s+browser\b|verify(?:ing)?\s+(?:that\s+)?you\s+are\s+(?:a\s+)?(?:human|not\s+a\s+robot)\b|are\s+you\s+(?:a\s+)?(?:human|robot)\b|please\s+complete\s+the\s+captcha\b|just\s+a\s+moment\s*(?:\.{3}|…)|this\s+may\s+take\s+(?:up\s+to\s+)?\d+\s+seconds",
    "redirect": r"(?:you\s+are\s+being|you\s+will\s+be)\s+redirected\b|click\s+here\s+if\s+you\s+are\s+not\s+redirected|(?:if\s+you\s+are\s+not\s+redirected)",
    "absent": r"(?:the\s+)?(?:abstract|full\s+text|summary|text|content|preview|description|article)\s+(?:is\s+|was\s+)?(?:not\s+(?:yet\s+)?available|unavailable|missing)\s*(?:[.!]|$)|no\s+(?:abstract|full\s+text|summary|preview|content)\s+(?:is\s+)?available\b|the\s+\w+\s+you\s+(?:requested|entered|are\s+looking\s+for|were\s+looking\s+for)\b",
    "filler": r"(?:please\s+)?(?:type|enter|insert|write|paste|put|place|add)\s+(?:your|the|an?)\s+(?:[\w’'-]+\s+){1,6}?(?:here|in\s+this\s+(?:box|field|space))\b|this\s+is\s+(?:a\s+|an\s+|some\s+)?(?:sample|dummy|placeholder|filler|example|test)\s+(?:text|paragraph|content|abstract|sentence)\b|replace\s+(?:it|this)(?:\s+\w+){0,3}\s+with\s+your\b|dummy\s+(?:paragraph|text|content)(?:\s+number)?\s*\d*\s*(?:[.!]|$)|(?:\w+\s+){0,4}goes\s+here\s*(?:[.!]|$)|(?:\w+\s+){1,4}(?:to\s+be\s+(?:supplied|added|provided|written|completed|inserted|filled\s+in|announced|determined)|will\s+be\s+(?:supplied|added|provided))\s+(?:by\s+the\s+(?:authors?|editors?|publisher)|here|later|soon)\b|blah(?:\W+\w+)?\W+blah\b|coming\s+soon\s*(?:[.!]|$)|your\s+(?:text|content|title|abstract)\s+here\b|(?:under\s+construction)\s*(?:[.!]|$)|(?:tbd|tba|todo|fixme)\s*(?:[.:!]|$)|asdf\w*|qwerty\w*",
    "other_languages": r"(?:p[áa]gina|art[íi]culo|documento|recurso)\s+no\s+(?:encontrad[oa]|disponible)|acceso\s+denegado|(?:por\s+favor[,\s]+)?(?:active|habilite|activa|habilita)\s+(?:java\s?script|las\s+cookies)|inserte\s+(?:aqu[íi]|su)|escriba\s+(?:aqu[íi]|su)|vuelva\s+a\s+la\s+portada|int[ée]ntelo\s+de\s+nuevo|"
    r"(?:seite|artikel|dokument|datei)\s+(?:wurde\s+)?nicht\s+(?:gefunden|verf[üu]gbar)|zugriff\s+verweigert|bitte\s+(?:aktivieren|schalten)\s+sie\s+(?:java\s?script|cookies|skripte)|hier\s+steht\s+(?:der|ihr|die)\b.{0,40}(?:text|beitrag|zusammenfassung)|(?:f[üu]gen|geben)\s+sie\s+hier|blindtext\b|der\s+gesuchte\s+artikel|versuchen\s+sie\s+es\s+(?:sp[äa]ter|erneut)|"
    r"(?:page|article|document|ressource)\s+(?:introuvable|non\s+trouv[ée]e?|indisponible)|acc[èe]s\s+(?:refus[ée]|interdit)|(?:veuillez|merci\s+d['’])\s*(?:activer|autoriser)\s+(?:java\s?script|les\s+(?:cookies|scripts))|ins[ée]rez\s+(?:ici|votre)|saisissez\s+(?:ici|votre)|votre\s+texte\s+ici|veuillez\s+r[ée]essayer|cette\s+page\s+n['’]existe|"
    r"страница\s+не\s+найдена|доступ\s+(?:запрещ[её]н|закрыт)|(?:пожалуйста[,\s]+)?включите\s+(?:java\s?script|cookies|скрипты)|(?:введите|вставьте)\s+(?:здесь|сюда|текст)|здесь\s+(?:будет|должен\s+быть)\s+текст|проверьте\s+адрес\s+(?:страницы|статьи)|"
    r"η\s+σελίδα\s+δεν\s+βρέθηκε|ενεργοποιήστε\s+(?:τη[νς]?\s+)?java\s?script|εισαγ[άα]γετε\s+εδώ|pagina\s+non\s+trovata|accesso\s+negato|abilita(?:re)?\s+java\s?script|página\s+não\s+encontrada|(?:ative|habilite)\s+o\s+java\s?script",
}
_WORDS_OF = lambda t: frozenset(t.split())
_THINGS = _THING[3:-1].split("|")
#: Words of which a sentence has at least one where the message matches; they spare most sentences the grammar.
_GATE: dict[str, frozenset[str]] = {
    "failed_thing": frozenset([*_THINGS, *(f"{t}s" for t in _THINGS)]),
    "server_error": _WORDS_OF("server gateway service access permission page file requests request forbidden unauthorized unauthorised connection nginx apache"),
    "permission": _WORDS_OF("you your log sign"),
    "went_wrong": _WORDS_OF("wrong error could problem try slow contact reload refresh back clear"),
    "robot_check": _WORDS_OF("browser human robot captcha moment seconds"),
    "redirect": _WORDS_OF("redirected"),
    "absent": _WORDS_OF("available unavailable missing requested entered looking"),
    "filler": _WORDS_OF("here box field space sample dummy placeholder filler example test replace supplied added provided written completed inserted filled announced determined blah soon construction tbd tba todo fixme"),
}
#: Words that a message in another language than English begins with.
_FIRST_WORDS = _WORDS_OF(
    "página pagina artículo articulo documento recurso acceso por active habilite activa habilita inserte escriba vuelva inténtelo intentelo seite artikel dokument datei zugriff bitte hier fügen fugen geben blindtext der versuchen "
    "page article document ressource accès acces veuillez merci insérez inserez saisissez votre cette страница доступ пожалуйста включите введите вставьте здесь проверьте η ενεργοποιήστε εισαγάγετε εισαγαγετε accesso abilita abilitare ative habilite"
)
#: Parts of words for messages whose words run together.
_PART_GATE: dict[str, tuple[str, ...]] = {"trace": ("traceback", "exception", "error", "warning", "notice", "uncaught", "trace", "segmentation"), "scripts": ("script", "cookie", "browser")}
_EVERY_GATE = frozenset().union(*_GATE.values())
_EVERY_PART = re.compile("|".join([*(p for ps in _PART_GATE.values() for p in ps), "asdf", "qwerty", "http", "status", "[45][0-9]{2}"]))
_ANY_LATIN_WORD = re.compile(r"[^\W_]+")
_STATUS_GATE = re.compile(r"[45]\d\d")


def _may_match(kind: str, low: str, words: list[str]) -> bool:
    if kind == "other_languages":
        return bool(words) and words[0] in _FIRST_WORDS
    if (gate := _GATE.get(kind)) is not None:
        return not gate.isdisjoint(words) or kind == "filler" and words[0].startswith(("asdf", "qwerty"))
    if (parts := _PART_GATE.get(kind)) is not None:
        return any(p in low for p in parts)
    if kind == "status":
        return _STATUS_GATE.search(low) is not None
    return kind != "status_line" or low.startswith(("error", "http", "status"))


_MESSAGE = [(k, re.compile(p, re.I)) for k, p in MESSAGES.items()]
#: Scripts without spaces: anywhere in the text (fixed values).
_UNSPACED = re.compile(
    r"(?:请|請|需要|必须|必須)?(?:启用|啟用|开启|打开|允许)\s*(?:java\s?script|cookie|脚本|腳本)|页面(?:不存在|未找到|无法(?:显示|访问))|頁面不存在|(?:找不到|未找到)(?:该|此|您(?:要|请求)的)?(?:页面|网页|文章|頁面)|访问被拒绝|(?:此处|这里|在此)(?:输入|填写|插入)|(?:请)?在此(?:处)?(?:输入|填写|插入)|"
    r"java\s?script\s*を有効に|クッキーを有効に|(?:ページ|記事|論文)(?:が|は)(?:見つかりません|表示できません|存在しません)|アクセスが拒否|ここに.{0,12}(?:入力|記入|挿入)(?:して|する)|お探しの(?:ページ|論文|記事)|"
    r"ไม่พบหน้า|(?:โปรด|กรุณา)เปิดใช้(?:งาน)?\s*java\s?script|(?:पृष्ठ|पेज)\s+नहीं\s+मिला|कृपया\s+java\s?script|(?:الصفحة|المقالة)\s+غير\s+موجودة|لم\s+يتم\s+العثور\s+على\s+(?:الصفحة|المقال)|(?:يرجى|الرجاء)\s+تفعيل|تفعيل\s+java\s?script|(?:ገጹ|ገጽ)\s+አልተገኘም|페이지를\s*찾을\s*수|자바스크립트를",
    re.I,
)
#: One word again and again.
_REPEATED = re.compile(r"\b([A-Za-z]{2,})(?:[\s,]+\1\b){4,}", re.I)
#: Words that make what stands next to them a subject of discussion.
_BEFORE = re.compile(r"(?:\b(?:slots?|tags?|tokens?|placeholders?|markers?|delimiters?|strings?|syntax|notation|macros?|variables?|phrases?|words?|literals?|escapes?|commands?|messages?|errors?|expressions?)\s+(?:such\s+as|like|called|named|written(?:\s+as)?|of\s+the\s+form)?|\b(?:writes?|wrote|written|denotes?|denote\b[^.!?]{0,50}\bby|fills?|filled|filling|escapes?|skips?|parses?|replaces?\s+each|marked|spelled|typed?|types|prints?|means?|stands?\s+for|the\s+(?:phrase|word|string|text|token|tag|message|sentence)))\s*[\"“‘'«`(]?\s*$", re.I)
_AFTER = re.compile(r"^\s*[\"”’'»`)]?\s*(?:slots?|tags?|tokens?|placeholders?|markers?|fields?|strings?|for\s+its\s+tag|for\s+(?:the|each|every)\s+\w+\s+(?:tag|slot)|syntax|served\s+as|is\s+(?:a|the)\s+(?:placeholder|template|tag|slot)|denotes?|means|stands?\s+for|messages?)\b", re.I)
_TUTORIAL = re.compile(r"\b(?:tutorial|how\s+to\s+write|template\s+(?:engine|language|syntax)s?|markup\s+language|this\s+guide|documentation|for\s+example,?\s+(?:the\s+)?(?:template|placeholder|syntax))\b", re.I)
_SENTENCES = re.compile(r"(?<=[.!?…。！？])[\"”’»)\]]*\s+|\n+|(?<=[。！？])")
_WORDS = re.compile(r"[A-Za-z]+")
_INVISIBLE = {c: None for c in [*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF, 0xAD]}


#: Characters around a hit in which a text about templates speaks of it.
NEAR = 250


def _latin_run(text: str, least: int = 6) -> int:
    """Where a run of ``least`` words of Latin filler begins, at least four of them different; -1 without one. A run in quotation marks within a sentence of other words is a quotation."""
    run: list[re.Match] = []
    for m in [*_WORDS.finditer(text), None]:
        if m and m.group().lower() in _LATIN:
            run.append(m)
            continue
        ws = [x.group().lower() for x in run]
        if len(ws) >= least and len(set(ws)) >= 4 and sum(len(x) > 3 for x in ws) >= 4:
            before, after = text[: run[0].start()].rstrip(" "), text[run[-1].end() :].lstrip(" .,;…")
            quoted = before[-1:] in _OPENING and after[:1] in _CLOSING and bool(before[-1:]) and bool(after[:1])
            if not (quoted or _BEFORE.search(text[max(0, run[0].start() - 90) : run[0].start()])):
                return run[0].start()
        run = []
    return -1


_OPENING, _CLOSING = "\"“„«‘'`", "\"”“»’'`"


def find_residue(text: str | None) -> list[tuple[str, int]]:
    """(kind, position) of every residue in the text; positions count in the text without code blocks and invisible characters.

    A hit that its context introduces or that stands near words on templates and their syntax is a mention. A text with two mentions or more, one in every 500
    characters, or with more than twice as many mentions as hits, explains such things, and its placeholders don't count. Null, empty and blank texts have none.
    """
    if not text or not text.strip():
        return []
    body = _CODE.sub(" ", text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_INVISIBLE)))
    hits, mentions = [], 0
    for kind, needs, rx in _PLACE:
        if not any(x in body for x in needs):
            continue
        for m in rx.finditer(body):
            if kind in rx.groupindex and not _names_a_field(kind, m.group(kind), body):
                continue
            before, after = body[max(0, m.start() - 90) : m.start()], body[m.end() : m.end() + 40]
            if _BEFORE.search(before) or _AFTER.search(after) or _TUTORIAL.search(body, max(0, m.start() - NEAR), m.end() + NEAR):
                mentions += 1
            else:
                hits.append((kind, m.start()))
    if hits and (mentions > 2 * len(hits) or mentions >= 2 and mentions * 500 >= len(body)):
        hits = []
    if (at := _latin_run(body)) >= 0:
        hits.append(("latin_filler", at))
    at = 0
    for m in [*_SENTENCES.finditer(body), None]:
        end = m.start() if m else len(body)
        raw = body[at:end]
        s = " ".join(raw.split()).strip(" \t\"“”‘’'«»(")
        if s:
            low = s.lower()
            words = _ANY_LATIN_WORD.findall(low)
            found = []
            if words and (words[0] in _FIRST_WORDS or not _EVERY_GATE.isdisjoint(words) or _EVERY_PART.search(low)):
                found = [(kind, at) for kind, rx in _MESSAGE if _may_match(kind, low, words) and rx.match(s)][:1]
            if not found and (r := _REPEATED.match(s)) and not _ANY_LATIN_WORD.search(s, r.end()):
                found = [("repeated_word", at)]
            if found and not _discussed(s) and not (body[:at].rstrip()[-1:] == ":" and _BEFORE.search(body[max(0, at - 90) : at].rstrip(" :"))):
                hits += found
        at = m.end() if m else end
    if not body.isascii() and (m2 := _UNSPACED.search(body)):
        hits.append(("unspaced", m2.start()))
    return hits


#: What the sentence goes on with if it reports on such messages rather than being one.
_REPORT = re.compile(r"\b(?:we|they|he|she|our)\s+(?:\w+ed|found|saw|show|see)\b|\bwere\s+\w+ed\s+(?:as|by|in|over|under|within|across|for|from|during|after|before|between|beyond)\b|\bin\s+(?:this|our|the)\s+(?:study|experiments?|corpus|collection)\b|\bserved\s+as\b", re.I)


def _discussed(sentence: str) -> bool:
    return bool(_REPORT.search(sentence))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds, n) of each document that holds residue: the kinds found, in order of name, and their number.

    Every row of ``docs`` is judged by its own whole text; rows that repeat come out repeatedly, null and blank texts never. Other columns are not read.
    """

    @full_frames
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find_residue(t) for t in b[text]]
            keep = [bool(f) for f in found]
            kinds = pd.Series([sorted({k for k, _ in f}) for f in found if f], dtype=object)
            yield pd.DataFrame({doc_id: b[doc_id][keep].reset_index(drop=True), "kinds": kinds, "n": pd.Series([len(f) for f in found if f], dtype="int32")})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInPandas(judge, f"`{doc_id}` {kind}, kinds array<string>, n int")


def without_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold residue."""
    return docs.join(residue(docs, doc_id, text).select(doc_id).distinct(), doc_id, "left_anti")
