import json
import random

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "out"),
    [("  Café,  Straße!  ", "café strasse"), ("a_b-c", "a_b c"), ("", ""), (None, None), ("...", "")],
)
def test_normalise(spark, text, out):
    assert one(spark, T.normalise(F.col("t")), t=text) == out


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("  \t", 0), ("two  words", 2), (" one", 1)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.col("t")), t=text) == n


@pytest.mark.parametrize(
    ("title", "ok"),
    [("Lake", True), ("ab", False), (None, False), ("List of lakes", False), ("Template:Box", False), ("Mercury (disambiguation)", False), ("Listing", True)],
)
def test_valid_title(spark, title, ok):
    assert one(spark, T.valid_title(F.col("t")), t=title) is ok
    if title == "ab":
        assert one(spark, T.valid_title(F.col("t"), True), t=title) is True


@pytest.mark.parametrize(
    ("turn", "ok", "strict"),
    [
        ("<think>a\nb</think>\n<response>x</response>", True, True),
        ("<think>a</think><tool_call>{}</tool_call>", True, True),
        ("<think>a</think><tool_call>1</tool_call><tool_call>2</tool_call>", True, False),
        ("<think>a</think><tool_call>1</tool_call><response>2</response>", False, False),
        ("no markup", False, False),
        (None, False, False),
    ],
)
def test_turn_format(spark, turn, ok, strict):
    assert one(spark, T.well_formed_turn(F.col("t")), t=turn) is ok
    assert one(spark, T.strict_turn(F.col("t")), t=turn) is strict


def test_structured_call_counts_as_format(spark):
    assert one(spark, T.well_formed_turn(F.col("t"), F.array(F.lit(1))), t="<think>x</think>") is True
    assert one(spark, T.well_formed_turn(F.col("t"), F.array(F.lit(1), F.lit(2))), t="<think>x</think>") is False


@pytest.mark.parametrize(
    ("q", "out"),
    [("  what   is this?? ", "what is this"), ("?", None), ("--", None), ("é1", "é1"), (None, None), ("x" * 600, "x" * 512)],
)
def test_query_text(spark, q, out):
    assert one(spark, T.query_text(F.col("t")), t=q) == out


def test_image_parts(spark):
    get = lambda x: [(p["type"], p["text"]) for p in one(spark, T.image_parts(F.col("t")), t=x)]
    assert get("a<image>b") == [("text", "a"), ("image", None), ("text", "b")]
    assert get("<image><image>q") == [("image", None), ("image", None), ("text", "q")]
    assert get("") == [("text", "")] and get(None) == [("text", "")]


def call(spark, text):
    r = one(spark, T.parse_tool_call(F.col("t")), t=text)
    return r["name"], None if r["arguments"] is None else json.loads(r["arguments"]), r["content"]


def test_first_of_two_calls(spark):
    c = '<tool_call>{"name": "%s", "arguments": {"image": "x"}}</tool_call>'
    assert call(spark, "<think>t</think>" + c % "crop" + c % "sharpen") == ("crop", {"image": "x"}, "<think>t</think>")


def test_missing_end_and_text_after_json(spark):
    assert call(spark, 'go <tool_call>{"name": "visit", "arguments": {"url": "u"}} and so on')[0] == "visit"
    assert call(spark, 'go <tool_call>{"name": "visit", "arguments": {"url": "u"}}')[:2] == ("visit", {"url": "u"})


def test_cut_json_stays_content(spark):
    text = 'go <tool_call>{"name": "visit", "arguments": {"url"'
    assert call(spark, text) == (None, None, text)


def test_aliases_and_arguments(spark):
    assert call(spark, '<tool_call>{"name": "local_search", "arguments": {"query": "a", "topK": 3, "lang": "de"}}</tool_call>')[:2] == ("text_search", {"q": "a", "hl": "de", "top_k": 3})
    assert call(spark, '<tool_call>{"name": "web_search", "arguments": {"q": "a", "top_k": 3}}</tool_call>')[:2] == ("web_search", {"q": "a"})
    assert call(spark, '<tool_call>{"name": "lens_scan", "arguments": {"image": "i", "x": 1}}</tool_call>')[:2] == ("image_search", {"url": "i"})


def test_calls_in_normal_form(spark):
    get = lambda x: call(spark, f"a <tool_call>{x}</tool_call>")[:2]
    assert get('{"name": "web_search", "arguments": {"q": "the </tool_call> tag"}}') == ("web_search", {"q": "the </tool_call> tag"})
    assert get('{"name": "crop", "arguments": {"url": "u", "x": [1, null]}}') == ("crop", {"image": "u", "x": [1, None]})
    assert get('{"name": "ocr", "arguments": {"url": "u", "image": "i"}}') == ("layout_parsing", {"url": "u", "image": "i"})
    assert get('{"name": "text_search", "arguments": {"topK": null}}') == ("text_search", {"q": None, "top_k": None})
    assert get('{"name": "image_search"}') == ("image_search", {"url": None})
    assert get('{"name": "visit", "arguments": "{\\"a\\": 1}"}') == ("visit", {"a": 1})
    for bad in ('{"name": "visit", "arguments": null}', '{"name": "visit", "arguments": "{\\"a\\": 1} x}"}', '{"name": 3}', '{"function": "visit"}', '{"name": "visit", "arguments": [1]}', "[]"):
        assert get(bad) == (None, None)


def plain_call(text):
    """A plain model of parse_tool_call."""
    try:
        v = json.JSONDecoder().raw_decode(text.split("<tool_call>", 1)[1].lstrip())[0]
        f = v.get("function", v)
        a = f.get("arguments", {})
        a = json.loads(a) if isinstance(a, str) else a
        if not isinstance(f["name"], str) or not isinstance(a, dict):
            return None, None
    except (ValueError, AttributeError, KeyError, TypeError):
        return None, None
    n = T.TOOL_ALIASES.get(f["name"], f["name"])
    if n == "image_search":
        a = {"url": a.get("image") or a.get("url")}
    elif n in ("text_search", "web_search"):
        top = {"top_k": a.get("top_k", a.get("topK"))} if n == "text_search" and ("top_k" in a or "topK" in a) else {}
        hl = a.get("hl") or a.get("lang")
        a = {"q": a.get("query") or a.get("q"), **({"hl": hl} if hl else {}), **top}
    elif n in T.IMAGE_TOOLS and "image" not in a and "url" in a:
        a = {k: x for k, x in a.items() if k != "url"} | {"image": a["url"]}
    return n, a


def test_calls_against_a_plain_model(spark):
    r = random.Random(5)
    values = ["", "x", None, 0, 3, False, True, [], [1], {"k": 1}, "</tool_call>"]
    texts = []
    for _ in range(400):
        keys = r.sample(["q", "query", "hl", "lang", "topK", "top_k", "image", "url", "x"], r.randint(0, 5))
        a = {k: r.choice(values) for k in keys}
        v = {"name": r.choice(["text_search", "local_search", "web_search", "lens_scan", "crop", "ocr", "visit", 5]), "arguments": r.choice([a, a, a, json.dumps(a), None, "no", [a]])}
        v = r.choice([v, v, {"function": v}])
        texts.append("go <tool_call>" + r.choice(["", " \n"]) + json.dumps(v)[: r.choice([None, None, None, -1])] + r.choice(["</tool_call>", "", " and } so on"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.parse_tool_call(F.col("t")).alias("c"))
    for row in df.collect():
        want = plain_call(texts[row["i"]])
        got = row["c"]["name"], None if row["c"]["arguments"] is None else json.loads(row["c"]["arguments"])
        assert got == want, texts[row["i"]]


def test_model_json(spark):
    get = lambda x: one(spark, T.model_json(F.col("t")), t=x)
    assert get('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert get('Sure: {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'
    assert get("[1]") is None and get("nothing") is None and get(None) is None


def test_scores_and_verdicts(spark):
    assert [one(spark, T.score_of(F.col("t")), t=x) for x in ("score: 0.7", "Score:7", "none", None)] == [0.7, 1.0, 0.0, 0.0]
    assert [one(spark, T.verdict_of(F.col("t")), t=x) for x in ("correct: YES", "correct: no", "yes", None)] == [1.0, 0.0, 0.0, 0.0]


def test_anchor_repair(spark):
    get = lambda x: one(spark, T.repair_anchor(F.col("t")), t=x)
    assert get("Is the the place shown in the imageold?") == "Is the place shown in the image, old?"
    assert get("The the entity shown in the image is") == "The entity shown in the image is"
    assert get("of the\n THE the Person SHOWN in the Imagewas") == "of the Person SHOWN in the Image, was" and get("the the house") == "the the house" and get(None) in (None, "")


def test_html_and_links(spark):
    page = '<html><script>x()</script><body> <p>One &amp; two</p>\n\n<style>b{}</style><a class="x" href="/wiki/Big_Lake#top">lake</a><a href="/wiki/Big_Lake">l</a><a href="/wiki/File:X.png">f</a></body></html>'
    assert one(spark, T.html_to_text(F.col("t")), t=page).split("\n") == ["One & two", "lake", "l", "f"]
    assert one(spark, T.links(F.col("t")), t=page) == ["Big Lake"]


def test_scrub_and_endpoint(spark):
    assert one(spark, T.scrub(F.col("t")), t="data:abc") == "<data-uri:8 chars>"
    assert len(one(spark, T.scrub(F.col("t")), t="x" * 900)) == 500
    assert one(spark, T.endpoint(F.col("t")), t="http://h/v1/") == "http://h/v1/chat/completions"
    assert one(spark, T.endpoint(F.col("t")), t="http://h/v1/chat/completions") == "http://h/v1/chat/completions"


def test_domain(spark):
    assert one(spark, T.infer_domain(F.col("t")), t="A stadium for animals") == "building_place"
    assert one(spark, T.infer_domain(F.col("t")), t="x" * 1800 + "museum") == "artifact"
    assert one(spark, T.infer_domain(F.lit(None), F.array(F.lit("Taxobox"))), t="x") == "organism"
