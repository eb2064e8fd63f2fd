from pyspark.sql import functions as F

from loomtrail.functions import text as T
from loomtrail.operators import gates as G
from loomtrail.operators import graph as N
from loomtrail.operators import retrieval as R
from loomtrail.operators import validation as V
from loomtrail.sources import adapters, jsonl

PARTS = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def test_tools(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,), ([],), (["a", None],), (["a", "b", "a"],), (["", "x"],)], "n array<string>")
    got = [r[0] for r in df.select(V.tools_error(F.col("n"))).collect()]
    assert got == [None, "tools must be a non-empty list", "tools must be a non-empty list", "tools[1] has no function name", "tools[2] duplicates tool a", "tools[0] has no function name"]


def test_rl_rows(spark):
    user = lambda *parts: [("user", [(p, None if p == "image" else "q") for p in parts])]
    rows = [(user("image", "text"), ["i.png"], ["oak", "old oak tree"]), ([], ["i.png"], ["x"]), (user("text"), [], ["x"]), (user("image"), ["i.png"], ["x", " "]), (user("image"), ["i.png"], None), (user("image", "image"), ["i.png"], ["x"]), (None, None, None)]
    df = spark.createDataFrame(rows, f"p {PARTS}, i array<string>, a array<string>")
    got = [tuple(r) for r in df.select(V.rl_error(F.col("p"), F.col("i"), F.col("a")), V.answer_words(F.col("a"))).collect()]
    assert got[0] == (None, 3) and got[-1][1] == 0
    assert [g[0] for g in got[1:]] == ["prompt must be a non-empty message list", "images must be a non-empty list", "answer must contain at least one non-empty string", "answer must contain at least one non-empty string", "image placeholder count 2 does not match images count 1", "prompt must be a non-empty message list"]


def test_missing_images(spark):
    rows = spark.createDataFrame([(1, ["file:///a.png", "https://x/y.png", "b.png"]), (2, None), (3, [None])], "k int, i array<string>")
    files = spark.createDataFrame([("/a.png",)], "path string")
    assert [tuple(r) for r in V.missing_images(rows, "k", "i", files, "path").collect()] == [(1, "b.png")]


def test_strict_quality(spark):
    said = {k: F.lit(True) for k in G.VERDICTS}
    df = spark.createDataFrame([("Which image shows Lake Pir?", ["lake  PIR!"], "oak"), ("Which image is oak?", None, "Oak"), ("Which image?", ["Lake Pir"], "oak"), (None, None, None)], "q string, h array<string>, a string")
    assert [r[0] for r in df.select(G.quality(F.col("q"), F.col("h"), F.col("a"), said | {"no_alias_leakage": F.lit(True)})).collect()] == [False, False, True, True]
    assert [r[0] for r in df.select(G.quality(F.col("q"), F.col("h"), F.col("a"), {k: v for k, v in said.items() if k != "nontrivial"})).collect()] == [False] * 4


def test_leaks_in_parts_equal_brute_force(spark, monkeypatch):
    texts = [(k, f"The {a} of {b}, near  the Lake") for k, (a, b) in enumerate((a, b) for a in ["oak mill", "Art", "party"] for b in ["Kofell", "art", "Mill"])] + [(99, None), (98, "")]
    names = [("art",), ("Art!",), ("the lake",), ("oak mill of kofell",), (None,), ("?",)]
    df, n = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(names, "n string")
    want = {(k, x) for k, t in texts if t for (x,) in names if x and x != "?" and x.lower().strip("!") in " ".join(t.lower().replace(",", " ").split())}
    assert {tuple(r) for r in G.leaks(df, "k", "t", n, "n").collect()} == want
    monkeypatch.setattr(G, "MOST_NAME_BYTES", 10)
    assert {tuple(r) for r in G.leaks(df, "k", "t", n, "n").collect()} == want
    assert G.leaks(df, "k", "t", n.limit(0), "n").count() == 0


def test_term_search_in_blocks(spark, monkeypatch):
    q = spark.createDataFrame([(k, f"of the mill {k % 3}") for k in range(7)] + [(50, None)], "q bigint, t string")
    d = spark.createDataFrame([(k, f"The mill of {k % 5} and {k % 3}") for k in range(40)] + [(90, None)], "d bigint, t string")
    one = sorted(tuple(r) for r in R.term_search(q, d, 4, "q", "t", "d", "t").collect())
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert one == sorted(tuple(r) for r in R.term_search(q, d, 4, "q", "t", "d", "t").collect()) and len(one) == 28
    assert R.term_search(q.limit(0), d, 4, "q", "t", "d", "t").count() == 0


def test_pages_and_seeds(spark):
    long = "x" * 300
    rows = [(long, 60, True, False, "u", ["Infobox mill"]), (long, 60, True, True, "u", ["Infobox"]), (long, 60, True, False, None, ["Infobox"]), (long, 60, True, False, "u", ["Stub"]), (long, 60, None, False, "u", ["Infobox"]), ("x", 60, True, False, "u", ["Infobox"]), (long, 20_000, True, None, "u", ["Infobox"])]
    df = spark.createDataFrame(rows, "e string, i bigint, x boolean, d boolean, u string, t array<string>")
    c = [F.col(k) for k in "eixdut"]
    assert [r[0] for r in df.select(N.page_ok(*c)).collect()] == [True] + [False] * 6
    assert [r[0] for r in df.select(N.page_ok(*c[:4])).collect()] == [True, False, True, True, False, False, False]
    b = N.seed_batches(spark.range(1000).select(F.col("id").cast("string").alias("t")), "t", "s", 64)
    sizes = {r["batch"]: r["count"] for r in b.groupBy("batch").count().collect()}
    assert sizes == {k: 64 if k < 15 else 40 for k in range(16)}


def test_lines_of_many_blocks(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(f'{{"a": {k}}}\n' for k in range(1, 5001)) + '{"a": 1} x}\n[1]\n"s"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = jsonl.read_lines(spark, str(p))
        assert lines.rdd.getNumPartitions() >= 1 and lines.select("line_no").distinct().count() == 5003
        c = jsonl.read_checked(spark, str(p), "a int")
        assert c.where("row.a <> line_no and error is null").count() == 0
        assert {(r["line_no"], r["error"]) for r in c.where("error is not null").collect()} == {(5001, "invalid JSON"), (5002, "each row must be an object"), (5003, "each row must be an object")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_writer_counts(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("train", 2), ("validation", 3), ("train", -1)], "split string, v int")
    assert jsonl.write_splits(df, str(tmp_path / "s"), rejected=F.col("v") < 0) == {"train": 2, "validation": 1, "rejected": 1}
    rows = spark.createDataFrame([("accepted", ["a", "b"]), ("rejected", ["c"])], "status string, trajectories array<string>")
    assert jsonl.write_audit(rows, str(tmp_path / "a")) == {"audit": 2, "accepted": 1, "sft": 2, "rl": 1}


def test_keys_and_retries(spark):
    r = spark.range(1).select(T.url_key(F.lit(" https://x/y ")), T.url_key(F.lit("https://x/y")), T.bytes_key(F.lit(b"ab")), F.sha2(F.lit("ab"), 256)).first()
    assert r[0] == r[1] and r[2] == r[3]
    assert adapters.http_failure(429).retryable and not adapters.http_failure(429, spare_busy=True).retryable and adapters.http_failure(503, spare_busy=True).retryable
