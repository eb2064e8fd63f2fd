"""Problem 8: texts cut at a field's limit or on their way.

Each text runs through an automaton with a stack: brackets, quotes and escapes of JSON, tags of markup, quotes and
brackets of prose. What is still open in JSON or markup at the end, a broken character, escape, entity or tag at the end,
and a written mark of a cut are evidence by themselves. What prose leaves open, and a missing terminator, are evidence
only against the baseline of the text's source: the share of its texts that leave something open, that end with a
terminator, the endings that recur there without one, and the length at which its texts pile up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread

TERMINATORS = ".!?。！？｡।؟‽"
CLOSERS = "\"'”’»)]}」』】*_"
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "image", "img", "input", "link", "meta", "source", "track", "wbr"}

_JSON = re.compile(r'\\.|["{}\[\]]', re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>")
_BRACKET_MARK = re.compile(
    r"(?:\[(?:…|\.{3}|\+?\s?[\d,.]+\s?(?:more\s)?(?:chars?|characters|words|bytes|more)|truncated|cut|more|continued|snip|abridged|text truncated)\]"
    r"|\((?:…|\.{3}|more|read more|truncated|continued|cut)\)|<(?:truncated|cut|more)>)$",
    re.I,
)
_DOTS = re.compile(r"(?:…|\.{3,}|(?:\. ){2}\.)$")
_BROKEN = re.compile(r"(?:\ufffd|[\ud800-\udfff]|\\u[0-9a-fA-F]{0,3}|(?<!\\)\\|&(?:#\d{0,6}|a|am|amp|l|lt|g|gt|q|qu|quo|quot|n|nb|nbs|nbsp|ap|apo|apos))$")
_PARTIAL_TAG = re.compile(r"<(?:/|/?[A-Za-z][\w-]*(?:\s[^<>]*)?)?$")
_SENTENCE = re.compile(rf"(?:[^\W\d_]{{3}}|\d|[)\"”»])[{re.escape(TERMINATORS)}][{re.escape(CLOSERS)}]*\s+\S|[。！？]\S")
_SEGMENTS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|[\r\n]+")
_LABEL = re.compile(r"(?:[A-ZÀ-Þ][\w'’]*(?:\s\w+)?:|[Ss]ee also)(?:[\s/,&]+(?:[A-ZÀ-Þ0-9][\w'’.-]*|of|von|de|the|and))+")
_TITLE = re.compile(r"(?:[A-ZÀ-Þ0-9(][\w'’.,&()-]*|of|von|the|de|la|and|on|for|in|&)(?:[\s_]+(?:[A-ZÀ-Þ0-9(][\w'’.,&()-]*|of|von|the|de|la|and|on|for|in|&)){0,8}")
_LIST_NUMBER = re.compile(r"(?:^|\n)\s*\d{1,3}[.)]?$")
_NAME = re.compile(r"\b[A-ZÀ-Þ][\w'’]*(?:\s[A-ZÀ-Þ][\w'’]*)*")
_LETTER = re.compile(r"[^\W_]")


def _json_open(t: str) -> int:
    """What is open at the end of a JSON text: 0 nothing, 1 something, -1 it isn't well nested."""
    stack: list[str] = []
    string = False
    for m in _JSON.finditer(t):
        c = m.group()
        if c[0] == "\\":
            continue
        if c == '"':
            string = not string
        elif not string:
            if c in "{[":
                stack.append(c)
            elif not stack or (stack.pop(), c) not in (("{", "}"), ("[", "]")):
                return -1
    return int(string or bool(stack))


def _markup_open(t: str) -> int:
    """1 if a tag other than a void one is open at the end, 0 if tags were closed, -1 if there is none."""
    stack: list[str] = []
    seen = -1
    for m in _TAG.finditer(t):
        name = m.group(2).lower()
        if m.group(3) or name in VOID_TAGS:
            continue
        if not m.group(1):
            stack.append(name)
        elif name in stack:
            seen = 0
            while stack and stack.pop() != name:
                pass
    return 1 if stack else seen


_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】"}
_NESTING = re.compile("[" + re.escape("".join(_OPENERS) + "".join(_OPENERS.values())) + '"]')


def _prose_open(t: str) -> bool:
    """Whether a bracket or quote is open at the end of prose. Apostrophes and single quotes don't count, a closing one without its opening (as behind the letters of a list) is passed over, and so is an inch mark behind a figure."""
    stack: list[str] = []
    for m in _NESTING.finditer(t):
        c = m.group()
        if c == '"':
            if stack and stack[-1] == c:
                stack.pop()
            elif c not in stack and not (m.start() and t[m.start() - 1].isdigit()):
                stack.append(c)
        elif c in _OPENERS:
            stack.append(_OPENERS[c])
        elif c in stack:
            while stack.pop() != c:
                pass
    return bool(stack)


def _last_word(t: str) -> str | None:
    """The last word of a text, apostrophes within it included, however long it is."""
    end = len(t)
    while end and not _LETTER.match(t, end - 1):
        end -= 1
    start = end
    while start and (_LETTER.match(t, start - 1) or (t[start - 1] in "'’" and start < end and start > 1 and _LETTER.match(t, start - 2))):
        start -= 1
    return t[start:end] or None


def _mask(s: str) -> str:
    return _NAME.sub("N", re.sub(r"\d+(?:[.,]\d+)*", "0", s))


def read_ending(text: str | None) -> tuple:
    """(state, form, n, last, prose, open) of one text.

    state: blank; complete or cut, where the structure decides; dots; open (no terminator) or done (terminated).
    form: the masked last segment (open) or last three words (dots). last: its last word. prose: it holds a sentence
    before the last segment. open: it is terminated, and leaves a quote or bracket of prose open.
    """
    if text is None or not text.strip():
        return "blank", None, None, None, False, False
    n, t = len(text), text.rstrip()
    body = t.lstrip("\ufeff \t\r\n")
    prose = bool(_SENTENCE.search(t))
    last = _last_word(t)
    if _BRACKET_MARK.search(t):
        return "cut", None, n, last, prose, False
    if _BROKEN.search(t) or (t.rfind("<") >= 0 and _PARTIAL_TAG.match(t, t.rfind("<"))):
        return "cut", None, n, last, prose, False
    dots = _DOTS.search(t)
    if body[0] in "{[" and len(body) > 1 and (body[1] in '"{[\n }]' or body[1].isdigit()):
        state = _json_open(body if not dots else body[: len(body) - len(dots.group())])
        if state >= 0:
            if state == 1:
                return "cut", None, n, last, prose, False
            if t[-1] in "}]":
                return "complete", None, n, last, prose, False
    if t[-1] in "}]" and '{"' in t and _json_open(t[t.index('{"') :]) == 0:
        return "complete", None, n, last, prose, False
    tags = _markup_open(t)
    if tags == 1:
        return "cut", None, n, last, prose, False
    if tags == 0 and t[-1] == ">":
        return "complete", None, n, last, prose, False
    if dots:
        words = t[: dots.start()].split()
        return "dots", _mask(" ".join(words[-3:])) + " " + dots.group().replace(" ", ""), n, last, prose, False
    end = t.rstrip(CLOSERS) or t
    if end[-1] in TERMINATORS:
        return ("cut" if _LIST_NUMBER.search(t) and "\n" in t.strip() else "done"), None, n, last, prose, _prose_open(t)
    segment = _SEGMENTS.split(t)[-1].strip()
    form = _mask(segment)
    if _LABEL.fullmatch(segment):
        form = "label"
    elif not prose and "\n" not in body and _TITLE.fullmatch(segment):
        form = "title"
    return "open", form, n, last, prose, False


_ENDING = "state string, form string, n int, last string, prose boolean, open boolean"


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, src (source, '' for null), h (a hash of the text) and the parts of read_ending() of each row."""

    @F.pandas_udf(_ENDING)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([read_ending(x) for x in s], columns=["state", "form", "n", "last", "prose", "open"])

    read = read.asNondeterministic()  # else a filter on its result would run it a second time
    e = spread(documents.select("doc_id", "source", "text")).withColumn("e", read("text"))
    return e.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.xxhash64("text").alias("h"), "e.*")


def cut_texts(documents: DataFrame, least_repeats: int = 3, dots_share: float = 0.03, open_share: float = 0.01, final_rate: float = 0.2, unclosed_share: float = 0.02) -> DataFrame:
    """(doc_id, source, evidence) of each text that was cut.

    A form of ending counts as natural if it recurs in least_repeats different texts, makes up dots_share of all endings
    on dots, or open_share of all endings without a terminator in prose, and isn't found at the limit of length mainly.
    In sources whose texts mostly lack terminators, a text is cut if its last word is broken off (never seen elsewhere,
    the beginning of a known word), or if it has the source's limit of length and its last word hardly ever ends a line.
    A terminated text that leaves a quote or bracket open is cut if at most unclosed_share of its source's are so.

    Null, empty and blank texts are no cases; a null source is a source of its own; repeated texts under other ids each
    get their row; an empty table gives none. Further columns don't matter.
    """
    known = materialize(endings(documents).where("state <> 'blank'"), "endings")
    source = known.groupBy("src").agg(F.avg((F.col("state") == "done").cast("double")).alias("done"), F.avg(F.when(F.col("state") == "done", F.col("open").cast("double"))).alias("unclosed"))
    # the length at which a source's texts pile up, with next to nothing beyond it; a window row is a source's length
    lens = known.groupBy("src", "n").agg(F.count("*").alias("c"))
    near = Window.partitionBy("src").orderBy("n").rangeBetween(-20, -1)
    beyond = Window.partitionBy("src").orderBy("n").rangeBetween(17, Window.unboundedFollowing)
    every = Window.partitionBy("src")
    limits = (
        lens.withColumn("around", F.coalesce(F.sum("c").over(near), F.lit(0)) / 20)
        .withColumn("over", F.coalesce(F.sum("c").over(beyond), F.lit(0)))
        .withColumn("total", F.sum("c").over(every))
        .where("c >= 2 and n >= 20 and c >= 3 * around and over <= 0.005 * total")
        .groupBy("src")
        .agg(F.max(F.struct("c", "n")).alias("m"))
        .select("src", F.col("m.n").alias("limit"))
    )
    source = materialize(source.join(limits, "src", "left").withColumn("is_prose", F.expr("done >= 0.5 and src <> ''")), "sources")  # read five times
    base = known.where("state in ('dots', 'open')").join(source, "src").withColumn("full", F.expr("coalesce(n between limit - 1 and limit, false)"))
    tail = base.withColumn("kind", F.expr("case when state = 'dots' then 'dots' when is_prose or src = '' and prose then 'open' end")).where("kind is not null")
    forms = tail.groupBy("kind", "form", "h").agg(F.max(F.col("full").cast("double")).alias("full")).groupBy("kind", "form").agg(F.count("*").alias("c"), F.avg("full").alias("full"))
    of_kind = forms.groupBy("kind").agg(F.sum("c").alias("all_c"))
    natural = (
        forms.where(F.col("c") >= least_repeats)
        .join(F.broadcast(of_kind), "kind")
        .where(F.expr(f"full < 0.3 and c >= case when kind = 'dots' then {dots_share} else {open_share} end * all_c"))
        .where("kind = 'dots' or form like '% %'")
        .select("kind", "form", F.lit(True).alias("natural"))
    )
    # at most 1 / dots_share + 1 / open_share rows: a bound that lets it be broadcast
    judged = tail.join(F.broadcast(natural), ["kind", "form"], "left").select(
        "doc_id",
        "src",
        F.expr(
            """case when natural then null
                    when kind = 'dots' then 'mark'
                    when form = 'label' then null
                    when form = 'title' and not full then null
                    else 'no terminator' end"""
        ).alias("evidence"),
    )
    # sources without terminators: words and line ends of these sources only, without the last word of each open text
    terse = documents.select(F.coalesce("source", F.lit("")).alias("src"), "text").join(source.where("not is_prose").select("src"), "src")
    bare = F.regexp_replace(F.lower("text"), r"\s*(?:…|\.{3}|\[[^\]\n]{1,20}\]|\([^)\n]{1,12}\))?\s*$", "")  # without the mark of a cut
    line = terse.where("text is not null").select("src", F.posexplode(F.reverse(F.split(bare, r"[\r\n]+| -> "))).alias("back", "line"))
    words = (
        line.select("src", "back", F.regexp_extract_all("line", F.lit(r"([\p{L}\p{N}]+)"), 1).alias("w"))
        .select("src", "back", F.posexplode("w").alias("at", "word"), F.size("w").alias("k"))
        .where("back > 0 or at < k - 1")
        .select("src", "word", F.expr("cast(at = k - 1 as bigint)").alias("final"))
        .groupBy("src", "word")
        .agg(F.count("*").alias("seen"), F.sum("final").alias("final"))
    )
    words = materialize(words, "words")
    ends = base.where("not is_prose and state = 'open' and not (src = '' and prose)").select("doc_id", "src", "full", F.lower("last").alias("word"))
    own = ends.join(words, ["src", "word"], "left")
    known_words = words.select("word").distinct()
    # beginnings of known words: only those of a few lengths are listed, and a longer one is compared with the words that share the greatest of them
    lengths = F.array(*[F.lit(n) for n in (*range(1, 9), *[1 << k for k in range(4, 31)])])
    heads = known_words.withColumn("n", F.explode(F.filter(lengths, lambda n: n < F.length("word")))).select(F.expr("left(word, n)").alias("key"), F.col("word").alias("whole"))
    lone = own.where("seen is null and word rlike '^\\\\p{L}+$'").join(known_words, "word", "left_anti")
    lone = lone.withColumn("key", F.left("word", F.array_max(F.filter(lengths, lambda n: n <= F.length("word")))))
    broken = lone.join(heads, (lone.key == heads.key) & F.startswith(heads.whole, lone.word) & (F.length(heads.whole) > F.length(lone.word)), "left_semi").select("doc_id", F.lit(True).alias("broken"))
    terse_cut = own.join(broken, "doc_id", "left").select(
        "doc_id",
        "src",
        F.expr(
            f"""case when broken then 'broken word'
                     when full and (seen is null or final < {final_rate} * seen) then 'at limit' end"""
        ).alias("evidence"),
    )
    unclosed = known.where("state = 'done' and open").join(source.where(F.col("unclosed") <= unclosed_share).select("src"), "src").select("doc_id", "src", F.lit("unclosed").alias("evidence"))
    sure = known.where("state = 'cut'").select("doc_id", "src", F.lit("structure").alias("evidence"))
    found = sure.unionByName(unclosed).unionByName(judged).unionByName(terse_cut).where("evidence is not null")
    return found.select("doc_id", F.expr("nullif(src, '')").alias("source"), "evidence")


def truncation_report(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share) for every source; blank texts count as documents that aren't cut."""
    n = documents.groupBy("source").agg(F.count("*").alias("documents"))
    c = cut_texts(documents).groupBy("source").agg(F.count("*").alias("cut"))
    return n.join(c.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("share")
    )
