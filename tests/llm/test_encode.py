import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrail.llm import bpe, encode, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no tokenizer files")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def ref(enc):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_reference(enc, ref, text):
    assert enc.ids(text) == ref.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40), st.text(max_size=20), st.data())
def test_append_and_edit(enc, ref, a, b, data):
    assert enc.encoded_ids(enc.append(enc.encode(a), b)) == ref.encode_ordinary(a + b)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(i, len(a)))
    e = enc.edit(enc.encode(a), i, j, b)
    assert e.text == a[:i] + b + a[j:] and enc.encoded_ids(e) == ref.encode_ordinary(e.text)


def test_texts_of_corpus(spark, enc, ref, data_dir):
    d = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(d).collect()}
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    assert got == {k: ref.encode_ordinary(t or "") for k, t in texts.items()}


def test_odd_texts(spark, ref):
    long = "ab" * 200_000 + " " * 5000
    rows = [(1, None, 9), (2, "", 9), (3, " ", 9), (4, "<|endoftext|>", 9), (5, long, 9), (None, "x", 9), (4, "<|endoftext|>", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode.encode_corpus(df).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [x[0] for x in got] == [1, 2, 3, 4, 4, 5, None]
    assert got[0][1] == got[1][1] == [] and got[3][1] == ref.encode_ordinary("<|endoftext|>") and got[5][1] == ref.encode_ordinary(long)
    assert encode.encode_corpus(df.limit(0)).count() == 0


TARGETS = "source string, target_share double, max_repeats int, tokens int"


def docs(spark, n=4000, seed=0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        s = r.choices(["big", "mid", "tiny", "other", None], [60, 30, 1, 5, 4])[0]
        rows.append((k, " ".join(["word"] * r.randint(1, 60)), s, r.choice(["en", "de", "EN", None, "xx-YY"]), r.choice(["A Bridge", "Lake B", None]), k))
    rows += [(n, None, "big", "en", None, 0), (n + 1, "", "big", "en", None, 0), (n + 2, " ", "mid", None, "", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, page_title string, copies int")


def test_mix_shares(spark):
    t = spark.createDataFrame([("big", 0.4, 1, 1), ("mid", 0.3, 2, 1), ("tiny", 0.2, 3, 1), ("none", 0.1, 1, 1)], TARGETS)
    d = docs(spark)
    m = mixing.mix(d, t).toPandas()
    caps = {"big": 1, "mid": 2, "tiny": 3}
    assert set(m.source) == set(caps) and all((m[m.source == s].copies <= c).all() for s, c in caps.items())
    rep = {r["source"]: r for r in mixing.mix_report(d, t).collect()}
    assert rep["none"]["tokens"] == 0 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1.0)
    assert rep["tiny"]["most_copies"] == 3 and rep["tiny"]["actual_share"] < 0.2
    assert rep["big"]["tokens"] / rep["mid"]["tokens"] == pytest.approx(4 / 3, rel=0.05)
    assert mixing.mix(d, t).exceptAll(mixing.mix(d, t)).count() == 0


def test_mix_exact(spark):
    t = spark.createDataFrame([("big", 0.5, 1, 1), ("mid", 0.4, 1, 1), ("tiny", 0.1, 2, 1)], TARGETS)
    for r in mixing.mix_report(docs(spark), t, "exact").collect():
        assert r["actual_share"] == pytest.approx(r["target_share"], abs=0.02)


def test_mix_empty_and_faulty(spark):
    t = spark.createDataFrame([("big", 1.0, None, 1)], TARGETS)
    assert mixing.mix(docs(spark).limit(0), t).count() == 0
    assert mixing.mix(docs(spark, 50), t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, 50), t.union(t))


def test_amounts():
    have, goal = {"a": 100.0, "b": 10.0, "c": 0.0}, {"a": 0.5, "b": 0.4, "c": 0.1}
    assert mixing.amounts(have, goal, {"a": 1, "b": 2, "c": None}) == {"a": 55.0, "b": 20.0, "c": 0.0}
    assert mixing.amounts(have, goal, {"a": 1, "b": 2, "c": None}, fill=True) == {"a": 90.0, "b": 20.0, "c": 0.0}
    assert mixing.amounts(have, goal, {"a": 1, "b": 2, "c": None}, "exact") == {"a": 25.0, "b": 20.0, "c": 0.0}
