import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.operators import agentlog as A
from loomtrail.operators import graph as N
from loomtrail.operators import images as I
from loomtrail.operators import retrieval as R
from loomtrail.operators import similarity as S
from loomtrail.operators import statistics as P
from loomtrail.operators import temporal as X
from loomtrail.sources import jsonl


@pytest.mark.parametrize("n", [1, 2, 20, 21, 100])
def test_nearest_rank(spark, n):
    df = spark.createDataFrame([("g", k) for k in range(n)] + [("g", None)], "g string, v bigint")
    r = P.profile(df, "g", "v").first()
    assert (r["p95"], r["low"], r["high"], r["n"]) == (min(n - 1, int(n * 0.95)), 0, n - 1, n) and r["median"] == (n - 1) / 2


def test_split_sizes(spark):
    df = spark.range(777)
    for ratio in (0.0, 0.02, 0.5):
        got = {r["split"]: r["count"] for r in P.split_rows(df, "id", ratio).groupBy("split").count().collect()}
        assert got.get("validation", 0) == int(777 * ratio) and sum(got.values()) == 777
    with pytest.raises(ValueError):
        P.split_rows(df, "id", 1.0)


def test_advantage(spark):
    rows = [(1, float(k), k == 0, 5) for k in range(8)] + [(2, 3.0, False, 0)]
    df = spark.createDataFrame(rows, "g int, r double, fatal boolean, tokens int")
    got = {(r["g"], r["r"]): r["advantage"] for r in P.leave_one_out(df, "g", "r", "fatal").collect()}
    assert got[1, 7.0] == pytest.approx(4.0) and got[1, 0.0] == 0.0 and got[2, 3.0] == 0.0
    assert {(r["g"], r["r"]): r["advantage"] for r in P.leave_one_out(df, "g", "r", None, "tokens").collect()}[1, 7.0] == pytest.approx(20.0)


def test_hops(spark):
    u = spark.createDataFrame([(0.0,), (0.39,), (0.41,), (0.81,)], "u double")
    assert [r[0] for r in u.select(P.hop_count(F.col("u"))).collect()] == [2, 2, 3, 4]
    assert {r[0] for r in u.select(P.hop_count(F.col("u"), 4, 4)).collect()} == {4}
    with pytest.raises(ValueError):
        P.hop_count(F.lit(0.1), 5, 6)


def links(spark, *pairs):
    return spark.createDataFrame([(a, b, "r", k) for k, (a, b) in enumerate(pairs)], "src string, dst string, relation string, pos int")


def test_paths_and_walks(spark):
    e = links(spark, ("aaa", "bbb"), ("bbb", "ccc"), ("bbb", "aaa"), ("ccc", "ddd"), ("aaa", "ccc"))
    s = spark.createDataFrame([("aaa",)], "title string")
    assert {tuple(r["path"]) for r in N.paths(s, e, 2).collect()} == {("aaa", "bbb", "ccc"), ("aaa", "ccc", "ddd")}
    assert {tuple(r["path"]) for r in N.paths(s, e, 2, fan_out=1).collect()} == {("aaa", "bbb", "ccc")}
    w = N.walks(s, e, "x", 3, 3).first()
    assert len(set(w["path"])) == len(w["path"]) and w["complete"] == (len(w["path"]) == 4)
    dead = N.walks(s, links(spark, ("aaa", "bbb")), "x", 2, 2).first()
    assert dead["path"] == ["aaa", "bbb"] and dead["complete"] is False


def test_edges_first_of_each_title(spark):
    df = spark.createDataFrame([("aaa", [("bbb", ""), ("bbb", "x"), ("Category:z", "y"), ("ccc", None)])], "title string, outgoing array<struct<title:string,relation:string>>")
    assert sorted((r["dst"], r["relation"], r["pos"]) for r in N.edges(df).collect()) == [("bbb", "linked from the article", 0), ("ccc", "linked from the article", 3)]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[5] = v[6] = v[7]
    v[9] = 0
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(999, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in S.top_k(df.where("vec_id < 20"), df, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q in set(range(20)) - {9}:
        s = np.round(u @ u[q], 9)
        order = [k for k in sorted(range(300), key=lambda k: (-s[k], k)) if k not in (q, 9)][:4]
        assert [x for _, x in sorted(got[q])] == order
    assert 9 not in got


def test_best_candidate_first_wins(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1), (2, 0, 0.2), (3, 0, None)], "s int, p int, score double")
    assert [tuple(r) for r in S.best_candidate(df, "s", "p", "score").collect()] == [(1, 0, 0.5)]


def test_fallback(spark):
    df = spark.createDataFrame([(None, "", "c"), (None, None, None)], "a string, b string, c string")
    f = lambda pin=None: [tuple(r[0]) for r in df.select(R.fallback([(x, F.col(x), F.lit("boom")) for x in "abc"], pin)).collect()]
    assert f()[0] == ("c", "c", None) and f()[1][2] == "all configured page readers failed: a: boom; b: boom; c: boom"
    assert f("a")[0] == (None, None, "all configured page readers failed: a: boom")


def test_cache(spark):
    c = spark.createDataFrame([("n", "k", "old", 1.0), ("n", "k", "new", 2.0), ("n", "j", "x", 0.0)], "namespace string, cache_key string, value string, updated_at double")
    last = R.latest(c, ["namespace", "cache_key"])
    assert {r["value"] for r in last.collect()} == {"new", "x"}
    assert {r["value"] for r in R.live(last, F.lit(10.0), 8.0).collect()} == {"new"}
    up = R.upsert(last, c.limit(0).union(spark.createDataFrame([("n", "j", "y", 5.0)], c.schema)), ["namespace", "cache_key"])
    assert {r["value"] for r in up.collect()} == {"new", "y"}
    asked = spark.createDataFrame([("n", "k"), ("n", "z")], "namespace string, cache_key string")
    assert {(r["cache_key"], r["value"], r["hit"]) for r in R.lookup(asked, last, ["namespace", "cache_key"], "value", F.lit("made")).collect()} == {("k", "new", True), ("z", "made", False)}


def test_rss_and_listing(spark):
    xml = "<rss><channel><item><title>A &amp; B</title><link>u</link><description>&lt;b&gt;x&lt;/b&gt;  y</description></item></channel></rss>"
    r = spark.createDataFrame([(xml,)], "x string").select(R.rss_items(F.col("x"))).first()[0]
    assert [tuple(i) for i in r] == [("A & B", "u", "x y")]
    items = spark.createDataFrame([(1, "q", 1, None, "l", "s"), (1, "q", 2, "T", "m", "t")], "k int, query string, rank int, title string, link string, snippet string")
    assert R.result_list(items, "k", "query").first()["listing"] == "Search results for: q\n1. Untitled\n   l\n   s\n2. T\n   m\n   t"


def test_retries(spark):
    df = spark.createDataFrame([(1, 1, False, True), (1, 2, True, True), (2, 1, False, False), (2, 2, True, True), (3, 1, False, True), (3, 2, False, True), (3, 3, True, True)], "c int, n int, ok boolean, again boolean")
    assert {r["c"]: (r["attempts"], r["succeeded"]) for r in R.retries(df, "c", ["n"], "ok", "again").collect()} == {1: (2, True), 2: (1, False), 3: (2, False)}


def resolved(spark, ref, images, natural=False):
    df = spark.createDataFrame([(ref, images)], "r string, i array<string>")
    return tuple(df.select(I.resolve(F.col("r"), F.col("i"), natural)).first()[0])


def test_image_references(spark):
    two = ["file:///a/one.png", "https://h/two.jpg"]
    assert resolved(spark, "image_0", two) == (two[0], None) and resolved(spark, "img_1", two) == (two[0], None) and resolved(spark, "img_2", two) == (two[1], None)
    assert resolved(spark, "two.jpg", two) == (two[1], None) and resolved(spark, "two", two) == (two[1], None)
    assert resolved(spark, "sandbox:/x", two) == (two[0], None) and resolved(spark, "data:x", two) == ("data:x", None)
    assert resolved(spark, "picture", two)[1] == "ambiguous image reference" and resolved(spark, "whatever", two[:1]) == (two[0], None)
    assert resolved(spark, "x", [])[1] == "no image to resolve"
    for name in ("latestimage", "latest_image", "Latest image", "the new image", "photo_", "img_9"):
        assert resolved(spark, name, two, True) == (name, None)
    assert resolved(spark, "The Uploaded Photo 2.png", two, True) == (two[1], None) and resolved(spark, "an image-1", two, True) == (two[0], None) and resolved(spark, "input_image 2", two) == (two[1], None)
    assert tuple(spark.createDataFrame([("Art-7", two, ["art-1", "art-7"])], "r string, i array<string>, d array<string>").select(I.resolve(F.col("r"), F.col("i"), True, F.col("d"))).first()[0]) == (two[1], None)
    assert resolved(spark, "latest image", two, True) == (two[1], None) and resolved(spark, "no idea", two, True) == ("no idea", None)


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    L = F.lit
    assert tuple(one(I.crop(L(-5), L(2), L(10), L(100), L(50), L(20)))) == (0, 2, 10, 20, None)
    assert one(I.crop(L(60), L(0), L(10), L(10), L(50), L(20)))["error"] == "empty crop"
    assert tuple(one(I.upscale(L(10), L(5), L(9.0)))) == (40, 20) and tuple(one(I.upscale(L(10), L(5), L(None).cast("double")))) == (20, 10)
    assert one(I.rotation(L(-90.0))) == -20.0 and one(I.sharpen_strength(L(9.0))) == 5.0
    assert one(I.restoration(L("blur"))) == "sharpen"
    assert bytes(one(I.data_bytes(I.data_uri(L(b"abc"), L("image/png"))))) == b"abc" and one(I.data_bytes(L("http://x"))) is None
    df = spark.createDataFrame([([],), (["artifact://x"],), (["a", ""],), (["a"],)], "i array<string>")
    assert [r[0] for r in df.select(I.list_error(F.col("i"))).collect()] == ["images must be a non-empty list", "contains a runtime-only artifact URI", "an image must be a path or address", None]


def test_fold_events(spark):
    rows = [("r", 1, "message_delta", "a", None, None, None), ("r", 2, "message_delta", "b", None, None, None), ("r", 3, "tool_started", None, "crop", "c1", None), ("r", 4, "tool_finished", None, "crop", "c1", "out"), ("r", 5, "tool_started", None, "crop", "c2", None), ("r", 6, "message_delta", " end ", None, None, None), ("s", 1, "message_delta", "  ", None, None, None), ("r", 7, "noise", None, None, None, None)]
    df = spark.createDataFrame(rows, "run string, seq int, type string, delta string, name string, call_id string, result string")
    got = [(r["role"], r["text"], r["call_id"]) for r in A.fold_events(df, "run", "seq").orderBy("run", "pos").collect()]
    assert got == [("assistant", "ab", "c1"), ("tool", "out", "c1"), ("assistant", "", "c2"), ("assistant", "end", None)]


def test_run_health(spark):
    rows = [(1, "{'tools/call_frequency': '1.5', 'tools/failure_frequency': '0.5', 'reward': '0.1'}"), (2, "noise"), (3, "x {'tools/call_frequency': 0.0, 'tools/failure_frequency': 0} y")]
    lines = spark.createDataFrame(rows, "line_no int, line string")
    assert A.run_health(A.last_metrics(lines)).first()["problem"] == "no tool was executed"
    assert A.run_health(A.last_metrics(lines.where("line_no < 3"))).first()["problem"] == "tools fail too often"
    assert A.run_health(A.last_metrics(lines.where("line_no < 3")), 0.5).first()["problem"] is None
    assert A.last_metrics(lines.where("line_no = 2")).count() == 0
    ok = spark.range(1).select(A.batch_problem(F.lit(8), F.lit(1), F.lit(4), F.lit(32), F.lit(8)), A.batch_problem(F.lit(8), F.lit(1), F.lit(4), F.lit(30)))
    assert tuple(ok.first()) == (None, "global batch is not world size x per-device batch x accumulation")


def test_asof_and_range(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "k int, t int, v string")
    assert {(r["k"], r["t"]): r["v"] for r in X.asof(a, b, "k", "t", "t", ["v"]).collect()} == {(1, 5): "y", (1, 1): None, (2, 9): None}
    r = spark.createDataFrame([(0, 4, "p"), (3, 30, "q")], "lo int, hi int, n string")
    assert {(x["t"], x["n"]) for x in X.range_join(a, "t", r, "lo", "hi", 4).collect()} == {(5, "q"), (1, "p"), (9, "q")}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n[1]\n')
    good = tmp_path / "g.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in jsonl.read_records(spark, str(good), "a int").collect()] == [1, 2]
    c = jsonl.read_checked(spark, str(p), "a int")
    assert [(r["line_no"], r["error"]) for r in c.orderBy("line_no").collect()] == [(1, None), (3, None), (4, "invalid JSON"), (5, "each row must be an object")]
    assert (jsonl.first_error(c).first()["line_no"], jsonl.first_error(c).first()["error"]) == (4, "invalid JSON")
    arr = tmp_path / "x.json"
    arr.write_text(json.dumps([{"a": 7}, {"a": 8}]))
    assert [r["a"] for r in jsonl.read_records(spark, str(arr), "a int").collect()] == [7, 8]
    arr.write_text('{"a": 1}')
    with pytest.raises(Exception, match="must contain a list"):
        jsonl.read_records(spark, str(arr), "a int").collect()
    assert jsonl.write_jsonl(spark.range(5), str(tmp_path / "out")) == 5
    audit = spark.createDataFrame([("accepted", ["t1", "t2"]), ("rejected", ["t3"])], "status string, trajectories array<string>")
    assert jsonl.write_audit(audit, str(tmp_path / "audit")) == {"audit": 2, "accepted": 1, "sft": 2, "rl": 1}
    assert jsonl.write_splits(P.split_rows(spark.range(50), "id", 0.1), str(tmp_path / "s")) == {"train": 45, "validation": 5}
