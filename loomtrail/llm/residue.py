"""Problem 3: template residue, filler, error pages and script notices in messages.

Texts are masked (numbers, addresses, dates), and all whole texts are grouped by the exact hash of their masked form
across sources. A group is a notice or filler by strict phrase rules, at any count, or, if it is short and recurs widely
(in several messages of several sources), by looser signs in wordings that no phrase lists. Slots are found by their
syntax; a sign that may be a slot or a word (null, undefined, a rule of underscores) counts where it stands in a context
in which sure slots stand elsewhere in the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

# Phrases of notices, by language. All are compared with lower-cased units without outer punctuation.
ERROR_PHRASES = [
    r"page not found",
    r"(?:the )?(?:requested )?(?:url|page|resource|file|document) (?:was |could |can ?)?(?:not|n't) (?:be )?found(?: on this server)?",
    r"(?:0 ?-? ?)?the page you (?:were|are) looking for (?:could not be found|does ?n[o']t exist|is gone)",
    r"(?:this|the) page isn'?t (?:working|available)(?: right now)?",
    r"oops!? something went wrong(?: on our (?:side|end))?",
    r"something went wrong",
    r"(?:the )?connection (?:has )?(?:timed out|was reset|failed|refused)",
    r"access (?:to this (?:resource|page|site) has been (?:blocked|denied|restricted)(?: by the site owner)?|denied)",
    r"(?:checking|verifying) your browser before (?:you continue|accessing.*)",
    r"(?:please )?verify (?:that )?you are (?:a )?human(?: to (?:proceed|continue))?",
    r"(?:this )?(?:video|content|page|item|product) is (?:not|no longer|un)\s?available(?: in your (?:region|country))?",
    r"sorry,? this (?:content|page|item) is no longer available",
    r"database connection failed(?:: .{0,40})?",
    r"(?:gateway|request|server) time-?out(?: while contacting the upstream server)?",
    r"too many requests(?:\. please slow down)?",
    r"(?:we are|the site is) (?:currently )?down for (?:scheduled )?maintenance(?: and will be back (?:shortly|soon))?",
    r"fatal error: uncaught \w+(?: .{0,60})?",
    r"(?:an )?(?:unexpected|internal|unknown) (?:server )?error(?: has)?(?: occurred)?(?: while .{0,40})?",
    r"your session has expired(?:\. please sign in again)?",
    r"error:? access denied",
    r"lo sentimos,? este contenido ya no está disponible",
    r"p[aá]gina n[aã]?[oã]? ?encontrada|página no encontrada|página não encontrada",
    r"error interno del servidor",
    r"ocorreu um erro inesperado",
    r"страница не найдена",
    r"внутренняя ошибка сервера",
    r"accès refusé",
    r"page introuvable",
    r"une erreur est survenue(?:,? veuillez réessayer plus tard)?",
    r"die angeforderte seite existiert nicht mehr",
    r"seite nicht gefunden",
    r"zugriff verweigert",
    r"页面不存在",
    r"服务器内部错误[，,]请稍后再试",
]
#: What an HTTP status is said to mean; with a code of 4xx or 5xx it is an error page's message.
STATUS_PHRASES = (
    r"not found|forbidden|unauthori[sz]ed|bad request|bad gateway|gone|too busy|too many requests|(?:request|gateway)? ?time-?d? ?-?out|"
    r"(?:service )?(?:temporarily )?unavailable|internal server error|blocked by policy|login needed|origin unreachable|certificate invalid|upstream reset|"
    r"access denied|conflict|method not allowed|payment required|not acceptable|not implemented"
)
FILLER_PHRASES = [
    r"todo:? write (?:this|the) \w+",
    r"content pending|content (?:coming|to come)(?: soon)?|coming soon",
    r"to be (?:written|added|completed|done|filled in)",
    r"(?:your|insert|add|enter) (?:content|text|body copy|title|description)(?: here)?",
    r"(?:sample|dummy|placeholder|example|filler) (?:text|body|copy|content|paragraph)(?: goes here)?(?:,? do not publish)?(?:\. replace it with the real \w+)?",
    r"(?:this is )?an? (?:placeholder|sample|dummy) (?:paragraph|text)(?: for the (?:final )?\w+)?",
    r"this is a placeholder.{0,60}",
    r"enter a short (?:summary|description|text).{0,40}",
    r"description to be added(?: soon)?",
    r"insert body copy",
    r"heading (?:one|two|0)\. (?:body text ?)+",
    r"(?:0 )+(?:test ?)+",
    r"texte d'exemple à remplacer",
    r"texto de ejemplo,? pendiente de completar",
    r"texto de exemplo.{0,40}",
    r"hier steht später der eigentliche text",
    r"platzhalter(?:text)?.{0,40}",
    r"此处填写正文",
    r"здесь будет текст.{0,20}",
]
#: What short texts say that recur widely and are notices or fillers, whatever their exact words; stems of several languages.
RECURRING = {
    "error": r"\berr(?:or|eur|ore|ors)\b|fehler|ошибк|错误|erro\b|not found|non trouv|nicht (?:gefunden|verfügbar|erreichbar)|no encontrad|não encontrad|non trovat|introuvable|не найден|未找到|不存在"
    r"|unavailable|indisponible|no disponible|indisponível|недоступн|forbidden|denied|refusé|denegad|negad|verweigert|verboten|time(?:d )?-?out|try again|réessay|vuelva a intentar|tente novamente|bad gateway|overloaded|unreachable|out of service",
    "script": r"java ?script|noscript",
    "filler": r"lorem|ipsum|placeholder|platzhalter|dummy|sample text|texte d'exemple|texto de ejemplo|texto de exemplo|to be (?:added|written|done|completed)|coming soon|\btbd\b|\btodo\b|待补充|заглушка",
}
MOST_RECURRING_WORDS = 8
SCRIPT_WORDS = r"java ?script|\bscripts?\b|\bscripting\b|\bnoscript\b"
SCRIPT_ACTIONS = r"enable|activ|ative|aktivier|turn|switch|require|disabled|allow|need|включит|启用|habilit|must|unterstütz"
NOT_A_NOTICE = r"[\"“”„«»]|\bwithout\b|\bworks\b|\bjoke\b|\bwhich\b|\bbecause\b|\bsays\b|\breads\b|\bcalled\b"
DECORATION = re.compile(
    r"(?:\s*-\s*please try again in \d+ (?:seconds|minutes)|\s*\(code \d+\)|try reloading the page|if you think this is a mistake,? contact the administrator"
    r"|go back to the home page or use the search|request id[: ]\s*[\w-]+|reference number:?\s*[\w-]+|©\s*\d{4}|instructions are in your browser'?s help"
    r"|\(v\s?\d+\)|^\s*#+\s*notice\s*$|^\s*loading\s*(?:\.{3}|…)|^\s*[⚠!]️?)[.!]?",
    re.I | re.M,
)
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
FORMAT_TAGS = {"think", "tool_call", "tool_response", "response", "image", "observation", "video", "audio"}
HTML_TAGS = set("a abbr b big blockquote body br center code dd div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input li main nav ol option p pre s section select small span strong sub sup table tbody td th thead tr u ul".split())

_X = r"[A-Za-z][\w-]*(?:[ .][A-Za-z0-9][\w-]*){0,3}"
_SLOT = re.compile(
    rf"\{{\{{\s*{_X}\s*\}}\}}|\{{%-?=?\s*{_X}\s*-?%\}}|<%[=-]?\s*{_X}\s*%>|[$#]\{{\s*{_X}\s*\}}|(?<!\{{)\{{(?:\s*{_X}\s*|\d{{0,2}})\}}(?!\}})"
    rf"|\${_X}\$|%\({_X}\)[sdf]|(?<![\d%\w])%[sd](?!\w)|(?<![\d%\w])%{_X}%(?!\w)|@@{_X}@@|\[\[{_X}\]\]|\[(?:insert|enter|add) [^\[\]\n]{{1,40}}(?: here)?\]"
    rf"|\[(?!SIC\]|UNREADABLE\]|INAUDIBLE\])[A-Z][A-Z_ ]*[A-Z](?:[_ ]?\d)?\]|\[object Object\]|<<{_X}>>|<TBD>|\(TODO:? [^()\n]{{1,40}}\)|(?<!~)~{_X}~(?!~)|(?<!\w)__[A-Za-z](?:\w| (?!_))*?__(?!\w)|\bXX[A-Za-z](?:\w| (?!X))*?XX\b"
)
_MARKS = re.compile(r"[{}\"\n]")
_CLOSING = re.compile(r"</([A-Za-z][\w-]*)")
_ANGLE = re.compile(rf"<({_X})>")
_MAYBE = re.compile(r"\b(?:undefined|null|NaN|TBD)\b|(?<!_)_{3,}(?!_)|\$\d(?![\d.,]|\w)")
_SITE = re.compile(r"(?:#+ )?[A-ZÀ-Þ][\w'’-]*(?: (?:of |the |von )?[A-ZÀ-Þ0-9][\w'’-]*){0,4}")
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_MASK_URL = re.compile(r"(?:https?://|www\.)\S+")
_MASK_MAIL = re.compile(r"\b[\w.+-]+@[\w-]+\.\w[\w.]*")
_DIGIT = re.compile(r"\d")
_MASK_DATE = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
_RUNNING = re.compile(r"(?:heading (?:one|two|0)\. )?(?:body text ?)+|(?:0 )*(?:test ?)+")
_MASK_STATUS = re.compile(r"(?<![\d.,:])[45]\d\d(?![\d.,:]?\d)")
_MASK_NUM = re.compile(r"\d+(?:[.,:]\d+)*")
_ERROR = re.compile("|".join(f"(?:{p})" for p in ERROR_PHRASES))
_FILL = re.compile("|".join(f"(?:{p})" for p in FILLER_PHRASES))
_STATUS = re.compile(rf"(?:(?:http|error|status)?\s*(?:code\s*=?)?\s*#?\s*\b[45]\d\d\b\s*[-:|(\[]?\s*(?:message\s*=\s*)?(?:{STATUS_PHRASES})\s*[)\]]?)|(?:(?:{STATUS_PHRASES})\s*[\[(]\s*[45]\d\d\s*[\])])")


def mask(text: str) -> str:
    """The form that is hashed: lower case, addresses, dates and numbers masked (what may be an HTTP error in a way of its own), white space collapsed."""
    t = text.lower()
    if "://" in t or "www." in t:
        t = _MASK_URL.sub("@u", t)
    if "@" in t:
        t = _MASK_MAIL.sub("@u", t)
    if _DIGIT.search(t):
        t = _MASK_NUM.sub("0", _MASK_STATUS.sub("@s", _MASK_DATE.sub("@d", t)))
    return " ".join(t.split())


#: Literals of which a text holds one if a pattern can match in it: a cheap look before the dear one.
_SLOT_SIGNS = ("{", "$", "%", "@@", "[", "<<", "<TBD>", "(TODO", "~", "__", "XX", "undefined", "null", "NaN", "TBD")


def _mash(words: list[str], text: str) -> bool:
    """Letters struck at random: lower case only, hardly any vowel, long runs of consonants."""
    letters = "".join(words)
    if len(letters) < 8 or not re.fullmatch(r"[a-z\s]+", text):
        return False
    vowels = sum(letters.count(v) for v in "aeiouy")
    return (vowels / len(letters) < 0.34 and bool(re.search(r"[bcdfghjklmnpqrstvwxz]{4}", letters))) or bool(re.fullmatch(r"[asdfghjklqwer]+", letters) and re.search(r"q(?!u)|[fjkwq]{2}|[fjkwq][sdlr][fjkwq]", letters))


#: Literals of which a line holds one if DECORATION can match in it.
_DECORATED = ("please try again", "(code", "try reloading", "if you think", "go back to", "request id", "reference number", "©", "instructions are", "(v", "notice", "loading", "⚠", "!")
_SCRIPT, _ACTION, _MENTION = re.compile(SCRIPT_WORDS), re.compile(SCRIPT_ACTIONS), re.compile(NOT_A_NOTICE)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?。！])\s*")
_TAIL = re.compile(r"[\s\d.,]+$")
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_NAMED = re.compile(r"^\s*(?:summary|note|answer|text|content|description):\s*", re.I)
_LONG = 60  # words: no phrase but running filler is as long


def _unit_kind(u: str) -> str:
    """error, script, filler or other, of a unit without decoration; '' if nothing is left of it."""
    bare = u.strip(" \t.!…-–—*#>|:;,。！_~+=&\"'").strip()
    if not bare:
        return ""
    low = bare.lower()
    words = _WORD.findall(low)
    if len(words) <= _LONG:
        if _STATUS.fullmatch(low):
            return "error"
        masked = (_MASK_NUM.sub("0", low) if _DIGIT.search(low) else low).replace("’", "'")
        if _ERROR.fullmatch(masked) or ("0" in masked and _ERROR.fullmatch(re.sub(r"^(?:error )?0[ :-]*|[ :-]*0$", "", masked))):
            return "error"
        if len(words) <= 22 and "script" in low and _SCRIPT.search(low) and _ACTION.search(low) and not _MENTION.search(low):
            return "script"
        fill = (re.sub(r"\s+0$", "", masked) if masked.endswith("0") else masked).strip(" .-")
        if _FILL.fullmatch(fill) or (fill != masked and _FILL.fullmatch(masked)):
            return "filler"
    elif _RUNNING.fullmatch(_MASK_NUM.sub("0", low)):
        return "filler"
    if len(words) >= 3 and not LOREM.isdisjoint(words) and sum(w in LOREM for w in words) >= 0.8 * len(words):
        return "filler"
    if len(words) >= 3 and len(set(words)) <= 2:
        said = _TAIL.sub("", bare)  # a number may stand behind what is repeated
        if re.fullmatch(r"[A-Za-z\s.,;:/_-]+", said) and max(map(len, words)) <= 8 and not re.search(r"[A-ZÀ-Þ]\w+ [A-ZÀ-Þ]", said) and (len(words) >= 4 or len(set(words)) == 1):
            return "filler"
    return "filler" if _mash(words, bare) else "other"


def whole_kind(text: str) -> str:
    """error, script or filler if the text as a whole is such a notice, else ''. Lines are read one by one, and the first that is none ends it."""
    t = _TAGS.sub("\n", text) if "<" in text else text
    kinds: set[str] = set()
    first, named = None, False
    for line in t.splitlines():
        if not line.strip():
            continue
        low = line.lower()
        for u in DECORATION.sub("\n", line).split("\n") if any(x in low for x in _DECORATED) else (line,):
            if not named and u.strip():
                u, named = _NAMED.sub("", u), True
            if not u.strip():
                continue
            k = _unit_kind(u)
            if k == "other":
                # a unit may be several notices in a row
                parts = set()
                sentences = _SENTENCES.split(u)
                for x in sentences if len(sentences) > 1 else ():
                    parts.add(_unit_kind(x))
                    if "other" in parts:
                        break
                parts -= {""}
                if "other" in parts or not parts:
                    if first is None and not kinds and _SITE.fullmatch(u.strip()):
                        first = u  # the site's name over its notice
                        continue
                    return ""
                kinds |= parts
            elif k:
                if first is not None and not kinds and k == "filler":
                    return ""
                kinds.add(k)
            first = first or ""
    return min(kinds) if kinds else ""


def _context(t: str, start: int, end: int) -> str:
    before = re.findall(r"[^\W\d_]+|[^\w\s]", t[max(0, start - 60) : start].lower())[-1:]
    after = re.findall(r"[^\W\d_]+|[^\w\s]", t[end : end + 60].lower())[:1]
    return f"{(before or ['^'])[0]} {(after or ['$'])[0]}"


def read_slots(text: str) -> tuple[bool, list[str], list[str]]:
    """Whether the text holds a sure slot; the contexts of its sure slots; the contexts of what may be one."""
    signs = any(x in text for x in _SLOT_SIGNS)
    if not signs and "<" not in text:
        return False, [], []
    t = _CODE.sub(lambda m: " " * len(m.group()), text) if "`" in text else text
    sure, maybe = [], []
    marks = _MARKS.finditer(t) if signs and "{" in t else iter(())
    mark = next(marks, None)
    depth, quote, stop = 0, -1, -1  # open braces before a slot, and its last quote, brace or line end
    for m in _SLOT.finditer(t) if signs else ():
        s, e = m.span()
        while mark is not None and mark.start() < s:
            c = mark.group()
            if c == '"':
                quote = mark.start()
            else:
                stop = mark.start()
                depth += (c == "{") - (c == "}")
            mark = next(marks, None)
        if depth > 0 and quote <= stop:
            continue  # within braces of its own, as in a set or in code
        if s > 2 and e < len(t) and t[s - 1] in "\"“'‘" and t[e] in "\"”'’" and t[s - 2].isspace() and (t[s - 3].isalnum() or t[s - 3] == "_"):
            continue  # quoted by the sentence around it
        sure.append(_context(t, s, e))
    closed = set(_CLOSING.findall(t)) if "</" in t else set()
    for m in _ANGLE.finditer(t) if "<" in t else ():
        name = m.group(1)
        if name.lower() in FORMAT_TAGS or name.lower() in HTML_TAGS or name in closed or t[m.start() - 1 : m.start()] == "<":
            continue
        if re.match(r"[a-z][\w-]* [\w-]+ ?=", name):
            continue
        sure.append(_context(t, *m.span()))
    for m in _MAYBE.finditer(t) if signs else ():
        maybe.append(_context(t, *m.span()))
    whole = t.strip(" .!\n\t")
    if _MAYBE.fullmatch(whole):
        return True, ["^ $"], []
    return bool(sure), sure, maybe


_READ = "slot boolean, sure array<string>, maybe array<string>, h bigint, kind string, form string"


def _seen(messages: DataFrame) -> DataFrame:
    """(message_id, src, slot, sure, maybe, h, kind, form, text) of each text part that isn't empty. h is a hash of its masked form, kind what the strict rules say of it, form the masked form of a short one; all are null where there is a sure slot. text is kept where there is a kind or a form."""

    @F.pandas_udf(_READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for s in batches:
            rows = []
            for x in s:
                slot, sure, maybe = read_slots(x)
                if slot:
                    rows.append((slot, sure, maybe, None, None, None))
                    continue
                m = mask(x)
                got = known.get(m) if len(m) <= 400 else None
                if got is None:
                    kind = whole_kind(x)
                    got = (xxhash.xxh64_intdigest(m) - (1 << 63), kind or None, m if not kind and len(m.split(" ", MOST_RECURRING_WORDS)) <= MOST_RECURRING_WORDS else None)
                    if len(m) <= 400:
                        if len(known) >= 100_000:
                            known.clear()
                        known[m] = got
                rows.append((slot, sure, maybe, *got))
            yield pd.DataFrame(rows, columns=["slot", "sure", "maybe", "h", "kind", "form"])

    read = read.asNondeterministic()  # else it would be run once for the filter and once more for the columns
    parts = spread(messages.select("message_id", "name", "role", "content")).select("message_id", F.coalesce("name", "role", F.lit("")).alias("src"), F.explode("content").alias("p"))
    parts = parts.select("message_id", "src", F.col("p.text").alias("text")).where("text is not null and trim(text) <> ''")
    seen = parts.withColumn("r", read("text")).select("message_id", "src", "r.*", F.expr("case when r.kind is not null or r.form is not null then text end").alias("text"))
    return materialize(seen, "residue")


def _groups(seen: DataFrame, least_messages: int = 3, least_sources: int = 2) -> DataFrame:
    """(h, messages, sources, text, kind) of each group of one masked form across sources that is a notice or filler. Sources are counted in two steps, so that a hot form is no long list anywhere.

    The strict kind of a text is that of its group. A group without one is told by RECURRING, if its form has at most
    MOST_RECURRING_WORDS words and stands in least_messages messages or more, of least_sources sources or more.
    """
    by_source = seen.where("h is not null").groupBy("h", "src").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.min("form").alias("form"), F.min("text").alias("text"))
    groups = by_source.groupBy("h").agg(F.sum("n").alias("messages"), F.count("*").alias("sources"), F.max("kind").alias("kind"), F.min("form").alias("form"), F.min("text").alias("text"))
    loose = None
    for kind, signs in RECURRING.items():
        hit = F.col("form").rlike(f"(?i){signs}")
        loose = F.when(hit, kind) if loose is None else loose.when(hit, kind)
    # a tool's own report of a failure (code and message) is none, nor is a question
    own = F.col("text").rlike(r"^\s*[A-Z]+(?:_[A-Z]+)+\b") | F.col("text").rlike(r"[?？]\s*$")
    wide = (F.col("messages") >= least_messages) & (F.col("sources") >= least_sources) & ~own
    return groups.withColumn("kind", F.coalesce("kind", F.when(wide, loose))).where("kind is not null").select("h", "messages", "sources", "text", "kind")


def residue(messages: DataFrame, least_context: int = 2) -> DataFrame:
    """(message_id, reason) of the messages to exclude; reason is error, filler, script or slot (the first of them in this order).

    Null contents, null and empty texts are no cases. Every text part of a message is read as a whole; redelivered
    messages each get their row. An empty table gives none. Columns beyond message_id, role, name and content don't matter.
    """
    seen = _seen(messages)
    judged = _groups(seen).select("h", "kind")
    whole = seen.where("h is not null").select("message_id", "h").join(judged, "h").select("message_id", F.col("kind").alias("reason"))
    slots = seen.where("slot").select("message_id", F.lit("slot").alias("reason"))
    contexts = seen.where("slot").select(F.explode("sure").alias("c")).groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least_context)
    maybe = seen.where("not slot").select("message_id", F.explode("maybe").alias("c")).join(contexts, "c").select("message_id", F.lit("slot").alias("reason"))
    return whole.unionByName(slots).unionByName(maybe).groupBy("message_id").agg(F.min("reason").alias("reason"))


def stock_texts(messages: DataFrame, least_messages: int = 2) -> DataFrame:
    """(kind, text, messages, sources) of the notices and fillers that recur: a text of each group of one masked form, and in how many messages and sources it is met."""
    return _groups(_seen(messages)).where(F.col("messages") >= least_messages).select("kind", "text", "messages", "sources")


def residue_report(messages: DataFrame) -> DataFrame:
    """(source, reason, messages) over all messages; source is the tool's name, or the role."""
    src = messages.select("message_id", F.coalesce("name", "role", F.lit("")).alias("source"))
    return residue(messages).join(src, "message_id").groupBy("source", "reason").agg(F.count("*").alias("messages"))
