import random

import numpy as np

import pytest

from loomtrail.llm import related as R

TRAJ = "traj_id bigint, messages array<struct<role:string,content:array<struct<type:string,text:string>>,tool_calls:array<struct<type:string,id:string,function:struct<name:string,arguments:string>>>>>, page string, name string"
PAGE = "page_id bigint, title string, url string, aliases array<string>, name string"


def traj(k, *texts, args=()):
    return (k, [("tool", [("text", t) for t in texts], [("function", "c", ("visit", a)) for a in args])], "x", "y")


def pages(spark, *names):
    return spark.createDataFrame([(k, t, f"https://w/wiki/{u}", a, "n") for k, (t, u, a) in enumerate(names)], PAGE)


def groups(spark, t, p, h=None):
    return sorted(tuple(r) for r in R.related_groups(spark.createDataFrame(t, TRAJ), p, h).collect())


def test_spellings(spark):
    p = pages(spark, ("Río Gol (mayor)", "R%C3%ADo_Gol_%28mayor%29", ["Old Gol & Sons"]), ("Lake Pir", "Lake_Pir", None), ("LAKE  PIR ", "Lake_Pir", None), ("Lake Pir Mill", "Lake_Pir_Mill", None))
    t = [
        traj(1, "1. rio_gol_(mayor) - x"),
        traj(2, args=['{"url": "https://w/wiki/R%C3%ADo_Gol_%28mayor%29?oldid=1#History"}']),
        traj(3, "the OLD GOL &amp; SONS, closed"),
        traj(4, "Lake Pir is here"),
        traj(5, args=['{"q": "lake pir height"}']),
        traj(6, "the Lake Pir Mill is another page"),
        traj(7, "Lake Pirate"),
        traj(8, None, args=["broken {"]),
        (9, None, "x", "y"),
    ]
    assert groups(spark, t, p) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_hubs_relate_nothing_but_hide_what_they_hold(spark):
    p, h = pages(spark, ("Gol", "Gol", [])), pages(spark, ("Republic of Gol", "Republic_of_Gol", ["Big Land"]))
    t = [traj(1, "in the Republic of Gol"), traj(2, "in the Republic of Gol"), traj(3, "Big Land"), traj(4, "Big Land"), traj(5, "Gol"), traj(6, "gol")]
    assert groups(spark, t, p, h) == [(5, 5), (6, 5)]


def test_empty(spark):
    p = pages(spark, ("Lake Pir", "Lake_Pir", None))
    assert groups(spark, [], p) == [] and groups(spark, [traj(1, "x")], p.limit(0)) == [] and groups(spark, [traj(1, "Lake Pir")], p) == []


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    e = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(1000, 1000 + k) for k in range(200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5), (3000, 3001)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in e:
        up[find(a)] = find(b)
    got = {x["v"]: x["root"] for x in R.components(spark.createDataFrame(e, "a bigint, b bigint"), seed).collect()}
    nodes = {x for p in e if p[0] != p[1] for x in p}
    label = {x: got.get(x, x) for x in nodes}
    assert all(x not in got for x in set(got.values()))
    for a in nodes:
        assert (label[a] == label[find(a)]) or find(a) not in nodes
    assert len({label[x] for x in nodes}) == len({find(x) for x in nodes})


def test_split_proportions(spark):
    r = random.Random(1)
    rows, k = [], 0
    for g in range(3000):
        for _ in range(1 if r.random() < 0.8 else r.randint(2, 20)):
            rows.append((k, g))
            k += 1
    rows += [(k + j, 99_999) for j in range(len(rows) // 2)]
    d = R.assign_splits(spark.createDataFrame(rows, "traj_id bigint, group_id bigint")).toPandas()
    assert len(d) == len(rows) and (d.groupby("group_id")["split"].nunique() == 1).all()
    share = d["split"].value_counts(normalize=True)
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["test"] == pytest.approx(0.1, abs=0.01)


def test_splits_of_all(spark):
    p = pages(spark, ("Lake Pir", "Lake_Pir", None))
    df = spark.createDataFrame([traj(1, "Lake Pir"), traj(2, "Lake Pir"), traj(3, "x")], TRAJ)
    assert {(r["traj_id"], r["group_id"]) for r in R.related_splits(df, p, None).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_hot_names_and_many_filters_change_nothing(spark, monkeypatch):
    """With every name taken as hot, and with the names cut into many filters, the mentions are the same."""
    pages = spark.createDataFrame([(k, f"Lake {chr(97 + k)}ol", f"u/Lake_{chr(97 + k)}ol", [f"Old {chr(97 + k)}ol"], "n") for k in range(12)], PAGE)
    trajs = spark.createDataFrame([traj(k, f"Near Lake {chr(97 + k % 12)}ol, not Lake {chr(97 + k * 5 % 12)}ol. Lake aol") for k in range(40)], TRAJ)
    names = R.page_names(pages, None)
    found = lambda: sorted(tuple(r) for r in R.mentions(trajs, names).collect())
    plain = found()
    assert plain
    monkeypatch.setattr(R, "HOT_PLACES", 3)
    assert found() == plain
    monkeypatch.setattr(R, "MAX_BLOOM_BITS", 7)
    assert found() == plain


def test_ngram_hashes_are_name_hashes():
    words = "a lake of the old mill a lake of".split()
    flat = np.array([R._token_hash(w, {}) for w in words], dtype=np.uint64)
    cache = {}
    for n in (1, 2, 5, 9):
        assert R.ngram_hashes(flat, n, cache).tolist() == [R._name_hash(words[k : k + n], {}) for k in range(len(words) - n + 1)]
