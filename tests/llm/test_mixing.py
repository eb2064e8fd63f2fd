import numpy as np
import pandas as pd
import pytest

from loomtrail.llm import mixing as M

DOCS = "doc_id bigint, text string, lang string, source string, page_title string, tokens int, w int, n_chars bigint"
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def documents(spark, n=600):
    rows = [(k, "the old mill of Kofell stands near the lake. " * (1 + k % 5), ["en", "de-AT", None, "xx1"][k % 4], ["web", "ocr", None, "notes"][min(3, k % 7)], ["Canal Lock 7", "Old Canal", None, "Lake Pir"][k % 4], 0, 0, 0) for k in range(n)]
    rows += [(n, None, "en", "web", None, 0, 0, 0), (n + 1, "", "en", "web", None, 0, 0, 0), (n + 2, "x", "en", "unlisted", None, 0, 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark, *rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TARGETS)


def test_shares_and_caps(spark):
    t = targets(spark, ("web", 0.5, None), ("ocr", 0.3, 2), ("notes", 0.2, None), ("none such", 0.0, 1))
    got = {r["source"]: r for r in M.mix_report(documents(spark), t).collect()}
    assert got["none such"]["tokens"] == 0 and got["ocr"]["most_copies"] <= 2
    exact = {r["source"]: r["actual_share"] for r in M.mix_report(documents(spark), t, total="exact").collect()}
    assert abs(exact["web"] - 0.5) < 0.03 and abs(exact["ocr"] - 0.3) < 0.03
    ids = {r["doc_id"] for r in M.mix(documents(spark), t).collect()}
    assert ids and not ids & {600, 601, 602}
    assert M.mix(documents(spark).limit(0), t).count() == 0


def test_margins(spark):
    t = targets(spark, ("web", 0.4, None), ("ocr", 0.3, None), ("notes", 0.3, None))
    got = M.margin_report(documents(spark), t).collect()
    assert {r["margin"] for r in got} == {"source", "lang", "topic"} and all(r["rounds"] >= 1 for r in got)
    for m in ("source", "lang", "topic"):
        assert abs(sum(r["actual_share"] for r in got if r["margin"] == m) - 1) < 1e-6
        assert all(abs(r["residual"]) < 0.01 for r in got if r["margin"] == m)
    assert {r["value"] for r in got if r["margin"] == "topic"} == {"canal", "lake", "none"}


def test_topics_come_from_the_titles(spark):
    assert M.topics(documents(spark))[:2] == ["canal", "lake"] or M.topics(documents(spark))[0] == "canal"
    rows = spark.createDataFrame([("The Old Canal",), (None,), ("Mill",), ("LAKE 4",)], "t string")
    assert [r[0] for r in rows.select(M.topic(rows.t, ["lake", "canal"])).collect()] == ["canal", "none", "other", "lake"]


def test_rake_meets_margins_that_fit():
    cells = pd.DataFrame([(s, x, t, 100.0 * (1 + i)) for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in ("en", "de") for t in "uv")], columns=["source", "lang", "topic", "tokens"])
    w, rounds = M.rake(cells, {"a": 900.0, "b": 900.0}, {"a": None, "b": None})
    made = w * cells["tokens"].to_numpy()
    assert abs(made[:4].sum() - 900) < 1e-3 and 1 <= rounds <= 100
    en = cells["lang"].to_numpy() == "en"
    assert abs(made[en].sum() / made.sum() - cells["tokens"][en].sum() / cells["tokens"].sum()) < 1e-3
    assert np.all(M.rake(cells, {"a": 9000.0, "b": 10.0}, {"a": 2, "b": 2})[0] <= 2 + 1e-9)


def test_bad_targets(spark):
    with pytest.raises(ValueError):
        M.mix(documents(spark), targets(spark, ("web", 0.5, None), ("web", 0.5, 1)))
