import random

import numpy as np
import pytest

from loomtrail.llm import overlap as O
from loomtrail.llm.fmindex import RunIndex

SCHEMA = "traj_id bigint, split string, dataset string, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>, final_answer string, key int, h int, body string"


def test_index_against_scan():
    r = np.random.default_rng(0)
    for _ in range(150):
        n = int(r.integers(0, 60))
        s = r.integers(0, 4, n) * 3 + 1
        x = RunIndex(s)
        for _ in range(8):
            m = int(r.integers(1, 5))
            p = r.integers(0, 5, m) * 3 + 1
            lo, hi = np.array([0]), np.array([x.n])
            for c in x.dense(p)[::-1]:
                lo, hi = x.step(lo, hi, np.array([c]))
            x = RunIndex.unpack(x.pack())
            got = sorted(x.locate(lo, hi)[1]) if hi[0] > lo[0] else []
            assert got == [i for i in range(n) if i + m <= n and (s[i : i + m] == p).all()]


def test_index_is_compressed():
    copies = np.tile(np.random.default_rng(1).integers(0, 1000, 300), 40)
    assert RunIndex(copies).runs < len(copies) / 20
    texts = [" ".join(f"w{v}" for v in np.random.default_rng(k % 9).integers(0, 500, 60)) + f" end{k}" for k in range(3000)]
    packed = O.head_shard(texts)[0]
    assert len(packed) < 2 * sum(len(t.split()) for t in texts)  # bytes a word, against 8 for the whole suffix array alone


def row(k, split, q, tool, a, ds="d"):
    return (k, split, ds, [("user", [("image", None), ("text", q)]), ("assistant", None), ("tool", [("text", tool)])], a, 1, 1, "b")


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(["lake", "tower", "stone", "river", "map", "gate", "roof", "wall", "king", "mill"]) + str(r.randint(0, 40)) for _ in range(n))


Q = "In which year was the tower next to the lake completed?"


def found(spark, rows):
    return sorted((r["train_id"], r["eval_id"]) for r in O.overlaps(spark.createDataFrame(rows, SCHEMA)).collect())


def test_same_and_edited(spark):
    t = text(1)
    edited = " ".join(w.upper() if k % 9 else "other" for k, w in enumerate(t.split()))
    rows = [
        row(1, "train", Q, t, "1,234"),
        row(2, "test", "Hello! " + Q, edited, "Answer: 1234."),
        row(3, "probe", Q.replace("tower", "gate"), t, "1234"),
        row(4, "validation", Q, t, "99"),
        row(5, "test", Q, text(2), "1234"),
        row(6, None, Q, t, "1234"),
        row(7, "train", Q, t, "1 234"),
    ]
    assert found(spark, rows) == [(1, 2), (7, 2)]


def test_null_and_empty(spark):
    none = (1, "train", None, None, None, 1, 1, "b")
    rows = [none, (2, "test", None, None, None, 1, 1, "b"), (3, "test", None, [], "x", 1, 1, "b"), (4, "train", None, [("user", None)], "", 1, 1, "b")]
    assert found(spark, rows) == [(1, 2), (4, 2)]
    assert O.overlaps(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_hot_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "EVAL_WORDS", 600)
    monkeypatch.setattr(O, "TRAIN_WORDS", 840)
    monkeypatch.setattr(O, "HEAD_WORDS", 5)
    evals, trains, g = [[1, 2, 3, 4, 5, 6, 7]] * 3, [[1, 2, 3, 4, 5, 6, 9]] * 4, np.zeros(4, dtype=int)
    whole = O.match_share(evals, trains, g[:3], g)
    monkeypatch.setattr(O, "OCCURRENCES", 3)
    assert len(whole) == 12 and O.match_share(evals, trains, g[:3], g).equals(whole)
    kinds = [text(k) for k in range(3)]
    rows, kind = [], {}
    for k in range(60):
        w = kinds[k % 3].split()
        w[k % len(w)] = "changed"
        kind[k] = k % 3
        rows.append(row(k, "train" if k < 40 else "test", Q, " ".join(w), "x"))
    assert found(spark, rows) == sorted((a, b) for a in range(40) for b in range(40, 60) if kind[a] == kind[b])


def test_report(spark):
    t = text(1)
    df = spark.createDataFrame([row(1, "train", Q, t, "x"), row(2, "test", Q, t, "x", "s"), row(3, "test", Q, text(5), "x", "s"), row(4, "probe", Q, t, "y", None)], SCHEMA)
    assert {(r["split"], r["dataset"]): (r["records"], r["overlapping"], r["pairs"]) for r in O.overlap_report(df).collect()} == {("test", "s"): (2, 1, 1), ("probe", None): (1, 0, 0)}


@pytest.mark.parametrize(("a", "b"), [("The answer is Oak.", "oak"), ("Final answer: 12,000 m", "12000 m"), ("Based on the page that was read, it is oak", "Oak"), ("oak, as stated in the second source.", "oak")])
def test_answers(a, b):
    assert O.answer_core(a) == O.answer_core(b)


def test_edited_questions_and_answers(spark):
    """One letter changed, left out, put in or swapped in a long word of question or answer: at least nine in ten pairs are found, and no other."""
    r = random.Random(4)
    names = ["lighthouse", "monastery", "cathedral", "windmill", "aqueduct", "observatory", "brewery", "orchard"]
    rows, want = [], set()
    for k in range(80):
        q = f"In which year was the {names[k % 8]} of Kar{chr(97 + k % 26)}{chr(97 + k // 26)}fellion next to the {names[k // 8 % 8]} completed by its owner?"
        t = text(k)
        words, a = q.split(), f"guild of masons {names[k % 8]} {k}"
        at = r.choice([i for i, w in enumerate(words) if w.isalpha() and len(w) >= 6])
        w, c = list(words[at]), r.randrange(1, len(words[at]) - 1)
        kind = r.choice(["change", "drop", "add", "swap"])
        w[c : c + 2] = {"change": ["x", w[c + 1]], "drop": [w[c + 1]], "add": ["x", w[c], w[c + 1]], "swap": [w[c + 1], w[c]]}[kind]
        rows.append(row(k, "train", q, t, a))
        if k % 2:
            words[at] = "".join(w)
            rows.append(row(1000 + k, "test", " ".join(words), t, a))
        else:
            rows.append(row(1000 + k, "test", q, t, a.replace(names[k % 8], names[k % 8][:3] + "x" + names[k % 8][3:])))
        want.add((k, 1000 + k))
        rows.append(row(2000 + k, "test", q, t, f"guild of masons {names[k % 8]} {k + 100}"))
    got = set(found(spark, rows))
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_heads_against_all_pairs():
    """The index finds every pair that plain comparison of all heads finds."""
    r = random.Random(8)
    base = [[r.choice(["lake", "tower", "windmill", "orchard", "of", "the", "in", "harbour"]) + r.choice(["", "s", "ing"]) for _ in range(r.randint(1, 30))] for _ in range(40)]

    def edit(h):
        h = list(h)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(h))
            h[i : i + 1] = r.choice([[h[i]], [h[i] + "x"], [h[i][1:] or "a"], [h[i][1:2] + h[i][:1] + h[i][2:]]])
        return h

    evals, trains = [edit(h) for h in base for _ in range(2)], [edit(h) for h in base for _ in range(2)]
    shard = O.head_shard([" ".join(h) for h in evals])
    t, e = O.head_matches(RunIndex.unpack(shard[0]), *shard[1:], [" ".join(h) for h in trains])
    # equal heads are indexed once each in the operator; here the first of them stands for all
    one = {tuple(h): k for k, h in reversed(list(enumerate(evals)))}
    got = {(a, one[tuple(evals[b])]) for a, b in zip(t.tolist(), e.tolist())}
    assert got == {(a, one[tuple(y)]) for a, x in enumerate(trains) for y in evals if O.same_head(x, y)} and got


def test_copies_stay_together(spark):
    """Copies of one text give one row between representatives and a row of membership each."""
    t = text(3)
    rows = [row(k, "train" if k < 30 else "test", Q, t, "oak") for k in range(50)]
    pairs, members = O.text_pairs(spark.createDataFrame(rows, SCHEMA))
    assert pairs.count() == 1 and members.count() == 50 and len(found(spark, rows)) == 600
