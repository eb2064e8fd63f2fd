from pyspark.sql import functions as F

from loomtrail.sources import adapters as A


def service():
    """Echoes, but fails as the request says: busy:n fails n times, bad always."""
    seen = {}

    def call(x):
        seen[x] = seen.get(x, 0) + 1
        if x.startswith("busy") and seen[x] <= int(x[-1]):
            raise A.http_failure(503, "busy", 0.0)
        if x == "bad":
            raise A.http_failure(404)
        if x == "judge":
            return "correct: yes"
        return x.upper()

    return call


def test_fetch(spark):
    df = spark.createDataFrame([("a",), ("busy2",), ("busy9",), ("bad",), ("",), (None,)], "q string").coalesce(1)
    got = {r["q"]: (r["reply"], r["attempts"], r["code"], r["retryable"]) for r in A.fetch(df, "q", service, 4, 0.0).collect()}
    assert got == {"a": ("A", 1, None, None), "busy2": ("BUSY2", 3, None, None), "busy9": (None, 4, "HTTP_503", True), "bad": (None, 1, "HTTP_404", False), "": (None, 0, "EMPTY_REQUEST", False), None: (None, 0, "EMPTY_REQUEST", False)}


def test_pauses():
    def always(_):
        raise A.http_failure(429)

    def told(_):
        raise A.http_failure(500, after=3.0)

    for call, linear, want in ((always, False, [4.0, 8.0, 8.0]), (always, True, [4.0, 8.0, 8.0]), (told, False, [3.0] * 3)):
        pauses = []
        assert A.with_retry(call, 4, 4.0, 8.0, linear, pauses.append)("x")[1] == 4 and pauses == want


def test_judge_sees_only_what_is_open(spark):
    df = spark.createDataFrame([(1, True, "bad"), (2, False, "judge"), (3, None, "bad"), (4, False, "no")], "k int, same boolean, p string")
    assert {r["k"]: r["verdict"] for r in A.judged(df, "k", F.col("same"), F.col("p"), service).collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("z")
    A.register(spark)
    got = sorted((r["file"][-5:], r["line_no"], r["line"]) for r in spark.read.format("numbered_lines").load(str(tmp_path)).collect())
    assert got == [("a.txt", 1, "x"), ("a.txt", 2, ""), ("a.txt", 3, "y"), ("b.txt", 1, "z")]
