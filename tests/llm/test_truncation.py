import random

import pytest

from loomtrail.llm import truncation as T

SCHEMA = "doc_id bigint, text string, source string, state int, h int, limit int"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "blank"), (" \n", "blank"), ("A full stop.", "done"), ('He said "yes."', "done"), ("Is it?", "done"), ("没有。", "done"),
        ('{"a": [1, 2]}', "complete"), ('{"a": [1, 2', "cut"), ('{"a": "x', "cut"), ("<think>a</think>\n<response>b</response>", "complete"), ("<think>a", "cut"),
        ("<think>a</think>\n<respo", "cut"), ("text [truncated]", "cut"), ("text (more)", "cut"), ("text[+478 chars]", "cut"), ("tex […]", "cut"), ("bro�", "cut"), ("esc \\u00", "cut"),
        ("a list\n4.", "cut"), ("the roof was cop…", "dots"), ("No stop here", "open"), ("<|startoftext|> and </s> are ordinary.", "done"), ("R&D", "open"),
    ],
)
def test_states(text, state):
    assert T.read_ending(text)[0] == state


def test_a_tag_cut_in_a_long_attribute():
    assert T.read_ending('See <img src="data:' + "A" * 5000)[0] == "cut" and T.read_ending("a < b, and c > d.")[0] == "done"


@pytest.mark.parametrize(
    ("text", "left_open"),
    [
        ('He said "yes. Then he went.', True), ("The mill (built by the guild. It fell.", True), ("«La torre cayó.", True), ('He said "yes."', False), ("a) first. b) second.", False),
        ("It's the miller's dog.", False), ('A 5" pipe.', False), ("[see (a)] It fell.", False), ("「没有。", True),
    ],
)
def test_prose_left_open(text, left_open):
    assert T.read_ending(text)[:1] + T.read_ending(text)[-1:] == ("done", left_open)


def test_unclosed_prose_against_its_source(spark):
    """Where hardly any text leaves a quote open, one that does was cut; where many do, it is their habit."""
    rows = [(k, f"The mill of {chr(97 + k % 26)} was sold in spring.", "neat", 0, 0, 0) for k in range(100)] + [(500, 'He said "no. It was sold.', "neat", 0, 0, 0)]
    rows += [(1000 + k, f'He said "no {k}. It was sold.' if k % 3 else f"It was sold {k}.", "loose", 0, 0, 0) for k in range(60)]
    assert {r["doc_id"] for r in T.cut_texts(spark.createDataFrame(rows, SCHEMA)).collect()} == {500}


def test_a_word_of_a_million_letters(spark):
    """Beginnings of very long words are found, and no list of all beginnings is made."""
    long_word = "abcdefghij" * 100_000
    lines = [f"Upper mill {k}\n{w}\nOpen in winter" for k, w in enumerate(["lighthouse", long_word, *("gate" + "s" * (k % 9) for k in range(20))])]
    rows = [(k, t, "ocr", 0, 0, 0) for k, t in enumerate(lines)]
    rows += [(100, "Lower gate\nOld lightho", "ocr", 0, 0, 0), (101, "Lower gate\nOld " + long_word[:700_001], "ocr", 0, 0, 0), (102, "Lower gate\nOld zzz", "ocr", 0, 0, 0), (103, "Lower gate\nOld lighthx", "ocr", 0, 0, 0)]
    got = {r["doc_id"]: r["evidence"] for r in T.cut_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {100: "broken word", 101: "broken word"}


def corpus(seed=0, n=1500):
    r = random.Random(seed)
    words = "tower lake stone river gate roof wall king mill path north winter metres letters".split()
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(4, 9))).capitalize() + "."
    rows, cut = [], set()
    for k in range(n):
        kind = r.random()
        if kind < 0.25:
            t, s = "\n".join(r.choice(["Upper mill", "No. " + str(r.randint(1, 99)), "Lower gate", "Open in winter"]) for _ in range(r.randint(1, 12))), "ocr"
            if len(t) > 60:
                t = t[:60]
                cut.add(k)
        else:
            t, s = " ".join(sentence() for _ in range(r.randint(1, 8))), "prose"
            if kind < 0.30:
                t += r.choice([" Photo: Ana Berg / Kofell", " See also Nurford"])
            elif kind < 0.33:
                t = t[:-1] + ": the rest is legend…"
            elif kind < 0.40:
                t = t[: max(8, len(t) - r.randint(3, 12))].rstrip(". ")
                t = t + r.choice(["", "…", " [truncated]"])
                cut.add(k)
        rows.append((k, t, s, 0, 0, 0))
    return rows, cut


def test_found(spark):
    rows, cut = corpus()
    rows += [(9000, None, "prose", 0, 0, 0), (9001, "", None, 0, 0, 0), (9002, "\t", "prose", 0, 0, 0), (9003, "word " * 100_000 + "end", "prose", 0, 0, 0), (9004, "One.", None, 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"] for r in T.cut_texts(df).collect()}
    assert 9003 in got and not got & {9000, 9001, 9002, 9004}
    got -= {9003}
    assert len(got & cut) / len(got) > 0.95 and len(got & cut) / len(cut) > 0.9
    rep = {r["source"]: r for r in T.truncation_report(df).collect()}
    assert sum(r["documents"] for r in rep.values()) == len(rows) and rep[None]["cut"] == 0 and 0 < rep["prose"]["share"] < 0.3
    assert T.cut_texts(df.limit(0)).count() == 0


def test_repeated_texts_keep_their_rows(spark):
    df = spark.createDataFrame([(k, "The roof of the tower was cop", "prose", 0, 0, 0) for k in range(4)] + [(10 + k, "A full sentence here.", "prose", 0, 0, 0) for k in range(20)], SCHEMA)
    assert {r["doc_id"] for r in T.cut_texts(df).collect()} == {0, 1, 2, 3}
