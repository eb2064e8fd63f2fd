import pytest

from loomtrail.llm import residue as R

SCHEMA = "message_id bigint, role string, name string, content array<struct<type:string,text:string>>, h int, text string, reason string"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Page not found\n\nIf you think this is a mistake, contact the administrator.", "error"),
        ("<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>", "error"),
        ("Error 403 (blocked by policy)", "error"),
        ("upstream reset [502]\n", "error"),
        ("Too many requests. Please slow down. (code 429)", "error"),
        ("Loading... Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.\n© 2020", "script"),
        ("Kofell Herald\nYou need to enable JavaScript to run this app.", "script"),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        ("Summary: Dolore magna aliqua enim", "filler"),
        ("TODO write this turn 3", "filler"),
        ("asdf asdf asdf asdf", "filler"),
        ("kk jkadsdf wrffesswedlss kfwwrqd", "filler"),
        ("...content pending...", "filler"),
        ("tbd tbd tbd 4", "filler"),
        ("lorem dolor " * 400, "filler"),
        ("The mill of Ana was sold in 1700. " * 400, ""),
        ('The poster reads "PAGE NOT FOUND" because it advertises a play.', ""),
        ('It says "please enable scripts" on the painted sign, a joke by Ana Berg.', ""),
        ("The site works without JavaScript, which is why the register could be read.", ""),
        ("The tower was built in 1700.\nPlease enable JavaScript.", ""),
        ("Room 404 of the mill is closed for repairs until winter.", ""),
        ("PAGE_READ_ERROR: all configured page readers failed: direct: timeout after 20 s", ""),
        ("Canal Lock 450", ""),
        ("每年春天大约有20名游客来到这里。每年春天大约有30名游客来到这里。", ""),
        ("1862", ""),
    ],
)
def test_whole_texts(text, kind):
    assert R.whole_kind(text) == kind


@pytest.mark.parametrize(
    ("text", "slot"),
    [
        ("Dear {{ name }}, the dock lies in X.", True),
        ("The image shows {0}.", True),
        ("built by ${owner} in 1700", True),
        ("near %(place)s was", True),
        ("According to [insert title here], it", True),
        ("Searching for [object Object] gives 3 results", True),
        ("shows <your place here>.", True),
        ("~year~", True),
        ("undefined", True),
        ("According to __IMAGE URL__, it", True),
        ("near XXsource_titleXX was", True),
        ("the XXL shirt and the XXth century", False),
        ("a slot such as `{{ name }}` is replaced", False),
        ("the shell command echo $HOME, printed by", False),
        ("The set {1, 2, {num}} lists", False),
        ("signed as [unreadable], probably in 1900 [2]", False),
        ("The caption reads <b>Nurfell</b>, 1900.", False),
        ("<think>x</think>\n<response>y</response> <image>", False),
        ('{"title": "Gimouth", "year": 1900, "rooms": [1, 2]}', False),
    ],
)
def test_slots(text, slot):
    assert R.read_slots(text)[0] is slot


def rows(*texts):
    return [(k, "tool", "visit", t if isinstance(t, list) or t is None else [("text", t)], 0, "x", "y") for k, t in enumerate(texts)]


def test_mask():
    assert R.mask("Error 404 on 2020-01-02 at https://x.y/z, 1,500 times") == "error @s on @d at @u 0 times"
    assert R.mask("gone [410]") != R.mask("gone [123]") and R.mask("Lock 1") == R.mask("lock  22")


def test_messages(spark):
    df = spark.createDataFrame(
        rows("The image shows {{x}}.", "The image shows {{y}}.", "The image shows null.", "The answer was left null by him.", None, [], [("text", None), ("image", None)], "", [("text", "Good text."), ("text", "Page not found")], "Page not found", "Page not found", "word " * 50_000 + "{{x}}", "Real words stand here. " * 8000),
        SCHEMA,
    )
    got = {r["message_id"]: r["reason"] for r in R.residue(df).collect()}
    assert got == {0: "slot", 1: "slot", 2: "slot", 8: "error", 9: "error", 10: "error", 11: "slot"}
    assert R.residue(df.limit(0)).count() == 0
    assert {(r["source"], r["reason"]): r["messages"] for r in R.residue_report(df).collect()} == {("visit", "slot"): 4, ("visit", "error"): 3}


def test_every_text_is_classified(spark):
    """Notices and filler without any usual word and with many different ones."""
    texts = ["kq ewrfwkeqrlfdefqearr djwsjja srk f  kladrw es", "Minim sit sed aliqua ullamco labore nisi minim adipiscing elit.", "Database connection failed: too many clients\nTry reloading the page."]
    df = spark.createDataFrame(rows(*texts, "The low mill of Kofell lost nine stones after the long flood."), SCHEMA)
    assert {r["message_id"]: r["reason"] for r in R.residue(df).collect()} == {0: "filler", 1: "filler", 2: "error"}


def test_slots_in_linear_time():
    import time

    def seconds(n):
        begin = time.perf_counter()
        assert R.read_slots("a {{ name }} and " * n)[0]
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(16_000) < 40 * seconds(1_000)


HELD_OUT = ["Service vorübergehend nicht erreichbar", "Resource is out of service", "Pagina non trovata", "Interner Serverfehler", "Texte d'exemple numéro 3", "Dummy caption"]


def test_wordings_that_no_phrase_lists_are_told_by_recurrence(spark):
    """Short notices in other words count where they recur in several messages of several sources, not where they stand once or in one source; what recurs without signs of a notice doesn't."""
    assert not any(R.whole_kind(x) for x in HELD_OUT)
    out = []
    for text in HELD_OUT + ["The mill is closed", "INVALID_QUERY: error in the query", "Who made this error?"]:
        out += [(len(out) + k, "tool", ("visit", "crop", None)[k % 3], [("text", text)], 0, "x", "y") for k in range(6)]
    once = [(900, "tool", "visit", [("text", "Seite momentan nicht erreichbar")], 0, "x", "y")] + [(901 + k, "tool", "visit", [("text", "Network unreachable")], 0, "x", "y") for k in range(6)]
    got = {r["message_id"] for r in R.residue(spark.createDataFrame(out + once, SCHEMA)).collect()}
    assert got == set(range(6 * len(HELD_OUT)))
