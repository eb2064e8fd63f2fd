"""Scalar functions on text columns. All are built-in expressions, so they stay in the JVM.

Regular expressions use Unicode classes by name: Java's \\w and \\s are ASCII by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Beginnings of titles that name no entity, generic answers, markers of a failed tool, aliases of tools,
# tools that take an image, what a question calls the pictured thing, and the keywords of the domains in the order in
# which they are tried.
LIST_PREFIXES = ["list of ", "outline of ", "index of ", "timeline of "]
NAMESPACE_PREFIXES = ["template:", "category:", "file:", "user:", "help:", "portal:", "wikipedia:"]
GENERIC_ANSWERS = ["valid name", "one year", "unknown", "not known", "none", "various"]
ERROR_MARKERS = ["traceback", "tool execution failed", "tool_gateway_unavailable", "tool_gateway_error", "[json parse error]", "error executing"]
TOOL_ALIASES = {"local_search": "text_search", "local_image_search": "image_search", "lens_scan": "image_search", "ocr": "layout_parsing"}
IMAGE_TOOLS = ["crop", "layout_parsing", "sharpen", "super_resolution", "perspective_correct"]
PICTURED = ["entity", "place", "building", "person", "site"]
ANCHOR = "shown in the image"
DOMAIN_WORDS = [
    ("person", ["person", "biography", "birth date", "occupation", "born "]),
    ("building_place", ["building", "structure", "architecture", "museum", "church", "stadium", "zoo"]),
    ("organism", ["animal", "species", "taxobox", "plant", "fungus", "genus"]),
    ("location", ["location", "place", "settlement", "geography", "coordinates", "country"]),
]


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends; '' for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def fold(c: Column) -> Column:
    """Case folding; beyond lower() it only maps the sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalise(c: Column) -> Column:
    """Folded words with single blanks between: punctuation counts as blank."""
    return squeeze(F.regexp_replace(fold(c), r"[^\p{L}\p{M}\p{N}_\s]", " "))


def normalise_answer(c: Column) -> Column:
    """Folded, white space collapsed, punctuation kept; '' for null."""
    return fold(squeeze(F.coalesce(c, F.lit(""))))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("bigint")


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether a folded text contains one of the parts; false for null."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return F.coalesce(out, F.lit(False))


def valid_title(title: Column, allow_short: bool = False) -> Column:
    """Whether a title may name an entity: at least three characters unless short ones are allowed, no list, no namespace, no disambiguation; false for null."""
    low = F.trim(fold(title))
    ok = (F.length(title) >= (1 if allow_short else 3)) & ~starts_with_any(low, LIST_PREFIXES + NAMESPACE_PREFIXES) & ~F.contains(low, F.lit("(disambiguation)"))
    return F.coalesce(ok, F.lit(False))


def infer_domain(extract: Column, templates: Column | None = None) -> Column:
    """The first domain with a keyword in the template titles or the first 1,800 characters of the extract, else artifact."""
    text = fold(F.concat(F.coalesce(F.array_join(templates, " "), F.lit("")) if templates is not None else F.lit(""), F.lit(" "), F.left(F.coalesce(extract, F.lit("")), F.lit(1800))))
    out = None
    for name, words in DOMAIN_WORDS:
        hit = contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("artifact")


def is_error_observation(text: Column) -> Column:
    """Whether a tool result holds a marker of failure."""
    return contains_any(fold(text), ERROR_MARKERS)


# The form of an assistant turn.
TURN_FORMAT = r"(?s)^<think>.*?</think>\s*(?:<tool_call>.*?</tool_call>|<response>.*?</response>)\s*$"
THINK_ONLY = r"(?s)^<think>.*?</think>$"


def well_formed_turn(text: Column, calls: Column | None = None) -> Column:
    """Whether an assistant turn is a think block with one kind of action after it, or only a think block with exactly one structured call."""
    ok = F.coalesce(strip(text).rlike(TURN_FORMAT), F.lit(False))
    if calls is not None:
        ok = ok | ((F.coalesce(F.size(calls), F.lit(0)) == 1) & F.coalesce(strip(text).rlike(THINK_ONLY), F.lit(False)))
    return ok


def strict_turn(text: Column) -> Column:
    """A well-formed turn with a single action block."""
    return well_formed_turn(text) & (F.size(F.split(F.coalesce(text, F.lit("")), r"<tool_call>|<response>")) == 2)


def response_block(text: Column) -> Column:
    """The content of the first response block, without white space around; null if there is none."""
    m = r"(?is)<response>(.*?)</response>"
    return F.when(F.coalesce(text, F.lit("")).rlike(m), strip(F.regexp_extract(text, m, 1)))


def query_text(q: Column) -> Column:
    """A search query: white space collapsed, punctuation off the ends, at most 512 characters; null unless it has two characters and a letter or digit."""
    # fixed value: the punctuation that is taken off
    p = "[" + r"\\/|,;:!?()\[\]{}<>\"'`~" + "]+"
    s = F.regexp_replace(squeeze(F.coalesce(q, F.lit(""))), f"^{p}|{p}$", "")
    return F.when((F.length(s) >= 2) & s.rlike(r"[\p{L}\p{N}]"), F.left(s, F.lit(512)))


def search_key(q: Column, k: Column) -> Column:
    """Cache key of a search: SHA-256 of the folded query, a line feed and the number of results."""
    return F.sha2(F.concat(fold(q), F.lit("\n"), k.cast("string")), 256)


def url_key(url: Column) -> Column:
    """Cache key of an address: SHA-256 of it as it is, without white space at its ends."""
    return F.sha2(strip(url), 256)


def bytes_key(content: Column) -> Column:
    """Cache key of bytes: their SHA-256; null for null."""
    return F.sha2(content, 256)


def image_parts(text: Column) -> Column:
    """Ordered parts of a text around its image marks: array of (type, text). Empty pieces are dropped; an empty text is one empty text part."""
    chunks = F.split(F.coalesce(text, F.lit("")), "<image>")
    pieces = F.transform(
        chunks,
        lambda c, i: F.concat(
            F.when(i > 0, F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")),
            F.when(c != "", F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")),
        ),
    )
    flat = F.flatten(pieces)
    return F.when(F.size(flat) > 0, flat).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("text"))))


def parts_text(content: Column, sep: str = "\n") -> Column:
    """The texts of an array of content parts, joined; '' for null."""
    return F.coalesce(F.array_join(F.transform(F.filter(content, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), sep), F.lit(""))


def html_to_text(html: Column, limit: int = 12000) -> Column:
    """Lines of text of a page: scripts, styles and drawings dropped, tags cut, common entities decoded, blank lines left out, at most limit characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\x0B\f\r\x{a0}]*\n[\s\x{a0}]*", "\n")
    return F.left(strip(t), F.lit(limit))


def links(text: Column, pattern: str = r'<a\s[^>]*href="/wiki/([^"#]+)[^"]*"', limit: int = 500) -> Column:
    """Titles that a page links to, in order, each once, at most limit; underscores are blanks, invalid titles are dropped."""
    t = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    return F.slice(F.array_distinct(F.filter(t, lambda x: valid_title(x))), 1, limit)


def model_json(text: Column) -> Column:
    """The JSON object in a model's answer as text: the whole without a code fence, else the outermost braces; null if it is no object."""
    t = strip(F.regexp_replace(strip(text), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    ok = lambda c: c.startswith("{") & c.endswith("}") & F.try_parse_json(c).isNotNull()
    return F.when(ok(t), t).when(ok(braces), braces)


def tool_call_text(text: Column) -> Column:
    """What follows the first tool_call mark, up to its closing mark if there is one; null without a mark."""
    body = F.element_at(F.split(text, "<tool_call>", 2), 2)
    return F.when(F.contains(text, F.lit("<tool_call>")), strip(F.element_at(F.split(body, "</tool_call>", 2), 1)))


def json_kind(v: Column) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, VOID (a JSON null), BIGINT and so on; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def whole_json(text: Column) -> Column:
    """A text as a variant if it is one JSON value and nothing else, else null. The parser alone would take a prefix."""
    return F.when(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.try_parse_json(text))


def parse_tool_call(text: Column) -> Column:
    """(name, arguments, content) of an assistant text: the first call, its name without aliases, its arguments in normal form as JSON, and the text before it.

    The JSON value right behind the first mark counts, whatever follows it, so that a closing mark within a string ends
    nothing and a missing one is tolerated. Arguments may be an object, or a text that holds one; none are {}. If the JSON
    is cut, names no tool or has other arguments (null, too), all is content.
    """
    piece = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant")
    # a value is bound by a lambda, so that what several expressions need is worked out once
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    start = F.when(F.contains(text, F.lit("<tool_call>")), F.element_at(F.split(text, "<tool_call>", 2), 2))

    def parsed(fn: Column) -> Column:
        name0 = F.when(json_kind(piece(fn, "name")) == "STRING", F.try_variant_get(fn, "$.name", "string"))
        given = piece(fn, "arguments")
        object_ = F.when(given.isNull(), F.parse_json(F.lit("{}"))).otherwise(bind(json_kind(given), lambda k: F.when(k == "OBJECT", given).when(k == "STRING", whole_json(F.try_variant_get(fn, "$.arguments", "string")))))
        name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TOOL_ALIASES.items() for x in kv]), name0), name0)
        return bind(object_, lambda o: F.struct(name.alias("name"), F.when(json_kind(o) == "OBJECT", o).alias("args")))

    def normal(p: Column) -> Column:
        name, args = p["name"], p["args"]
        get = lambda k: F.to_json(piece(args, k))
        said = lambda k: bind(get(k), lambda x: F.when(~x.isin('""', "null", "0", "false", "[]", "{}"), x))
        extra = lambda key, c: F.coalesce(F.concat(F.lit(f',"{key}":'), c), F.lit(""))
        top_k = F.when(name == "text_search", F.coalesce(get("top_k"), get("topK")))
        search = F.concat(F.lit('{"q":'), F.coalesce(said("query"), get("q"), F.lit("null")), extra("hl", F.coalesce(said("hl"), said("lang"))), extra("top_k", top_k), F.lit("}"))
        image = F.concat(F.lit('{"url":'), F.coalesce(said("image"), get("url"), F.lit("null")), F.lit("}"))
        renamed = F.to_json(F.map_concat(F.map_filter(args.cast("map<string,variant>"), lambda k, _: k != "url"), F.create_map(F.lit("image"), piece(args, "url"))))
        out = F.when(name.isin("text_search", "web_search"), search).when(name == "image_search", image)
        out = out.when(name.isin(*IMAGE_TOOLS) & piece(args, "image").isNull() & piece(args, "url").isNotNull(), renamed).otherwise(F.to_json(args))
        ok = name.isNotNull() & args.isNotNull()
        return F.struct(F.when(ok, name).alias("name"), F.when(ok, out).alias("arguments"))

    def call(raw: Column) -> Column:
        fn = bind(piece(raw, "function"), lambda inner: F.when(json_kind(raw) == "OBJECT", F.when(inner.isNull(), raw).when(json_kind(inner) == "OBJECT", inner)))
        return bind(bind(fn, parsed), normal)

    clean = lambda c: strip(F.replace(c, F.lit("<|im_end|>"), F.lit("")))
    content = lambda c: clean(F.when(c["name"].isNotNull(), F.element_at(F.split(text, "<tool_call>", 2), 1)).otherwise(text))
    return bind(bind(F.try_parse_json(start), call), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), content(c).alias("content")))


def score_of(text: Column) -> Column:
    """The number after 'score:', within 0 and 1; 0 if there is none."""
    x = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)score\s*:\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def verdict_of(text: Column) -> Column:
    """1 if the text says 'correct: yes', else 0."""
    return F.coalesce(F.lower(F.regexp_extract(text, r"(?i)correct\s*:\s*(yes|no)\b", 1)) == "yes", F.lit(False)).cast("double")


def repair_anchor(text: Column) -> Column:
    """Of several articles before a pictured thing one stays, in the case of the first; behind the phrase that tells of the image, a glued word gets a comma and a blank before it."""
    # words with the white space behind them; word k is an article too many if it and the one before it are articles and a pictured thing follows the row of them
    pieces = F.split(text, r"(?<=\s)(?=\S)")
    bare = F.transform(pieces, lambda w: F.lower(F.rtrim(F.regexp_replace(w, r"\s+", " "))))
    rest = F.transform(bare, lambda w, i: (w == "the") & F.regexp_replace(F.array_join(F.slice(bare, i + 1, F.size(bare)), " "), "^(?:the )+", "").rlike("^(?:" + "|".join(PICTURED) + f") {ANCHOR}"))
    row = F.arrays_zip(pieces.alias("w"), rest.alias("the"))
    at = lambda i, d: F.coalesce(F.get(rest, i + d), F.lit(False))
    kept = F.transform(row, lambda r, i: F.when(at(i, 0) & (i > 0) & at(i, -1), "").when(at(i, 0) & at(i, 1), F.when(r["w"].rlike("^[A-Z]"), "The ").otherwise("the ")).otherwise(r["w"]))
    parts = F.split(F.array_join(kept, ""), f"(?i)(?<={ANCHOR})")
    return strip(F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[A-Za-z]"), F.concat(F.lit(", "), p)).otherwise(p)), ""))


def scrub(text: Column, limit: int = 500) -> Column:
    """A text for the log: data URIs as a mark of their length, anything else cut at limit."""
    return F.when(text.startswith("data:"), F.concat(F.lit("<data-uri:"), F.length(text).cast("string"), F.lit(" chars>"))).otherwise(F.left(text, F.lit(limit)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def endpoint(url: Column, suffix: str = "/chat/completions") -> Column:
    """An address without slashes at its end and with the suffix once."""
    u = F.regexp_replace(strip(url), "/+$", "")
    return F.when(u.endswith(suffix), u).otherwise(F.concat(u, F.lit(suffix)))
