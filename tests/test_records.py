import json

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import records as D
from loomtrail.sources import runs


def one(spark, c, schema=None, row=None):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(c.alias("r")).first()["r"]


MESSAGES = "m array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def test_prompts(spark):
    m = [("user", [("image", None), ("text", "a")]), ("assistant", [("text", "x"), ("text", "y")]), ("user", [("text", "b")]), ("assistant", None)]
    assert one(spark, D.question_text(F.col("m")), MESSAGES, (m,)) == "a\nb"
    assert one(spark, D.question_text(F.col("m"), F.lit("q")), MESSAGES, (m,)) == "q" and one(spark, D.question_text(F.col("m"), F.lit("")), MESSAGES, (m,)) == "a\nb"
    assert one(spark, D.last_assistant_text(F.col("m")), MESSAGES, (m,)) == "xy" and one(spark, D.last_assistant_text(F.col("m")), MESSAGES, ([],)) == ""
    assert one(spark, D.reference_text(F.array(F.lit("a"), F.lit("b")))) == "a | b"


def test_responses(spark):
    get = lambda x: one(spark, D.response_text(F.lit(x)))
    assert get('{"output_text": "a"}') == "a" and get('{"output": [{"content": [{"text": "b"}]}]}') == "b" and get('{"choices": [{"message": {"content": "c"}}]}') == "c" and get("{}") is None


def test_requests_and_modes(spark):
    schema = "p array<struct<type:string,text:string,uri:string>>"
    get = lambda p: one(spark, D.request_problem(F.col("p")), schema, (p,))
    assert get([("text", "hi", None), ("image", None, "https://x")]) is None
    assert get([]) == "input must be a non-empty list" and get([("audio", "x", None)]) == "input has an unknown part"
    assert get([("text", " ", None)]) == "a text part is empty" and get([("image", None, "x.png")]) == "an image has no usable address"
    r = one(spark, D.mode_list(F.lit(" text, IMAGE,text,video,"), ["text", "image"]))
    assert (r["modes"], r["unknown"]) == (["text", "image"], ["video"])


def test_envelope(spark):
    none = F.lit(None).cast("struct<code:string,message:string,retryable:boolean>")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit("t").alias("text")))
    e = one(spark, D.envelope(F.lit("c"), F.lit("crop"), parts, none, F.array(F.lit("u"))))
    assert e["ok"] and [p["type"] for p in e["content"]] == ["text", "image"]
    e = one(spark, D.envelope(F.lit("c"), F.lit("crop"), parts, D.failure(F.lit("X"), F.lit("m"), F.lit(None).cast("boolean")), F.lit(None).cast("array<string>")))
    assert not e["ok"] and tuple(e["error"]) == ("X", "m", False)


def test_scrub_json(spark):
    deep = {"a": ["data:xyz"] * 30, "b": {"c": "x" * 900, "d": [1, None]}}
    r = json.loads(one(spark, D.scrub_json(F.lit(json.dumps(deep)))))
    assert r["a"] == ["<data-uri:8 chars>"] * 20 and len(r["b"]["c"]) == 500 and r["b"]["d"] == [1, None]
    assert one(spark, D.scrub_json(F.lit("no json" * 200))) == ("no json" * 200)[:500] and one(spark, D.scrub_json(F.lit(None).cast("string"))) is None


def test_zip_and_config(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, a string"), spark.createDataFrame([(1, "p")], "pos int, b string")
    assert {r["pos"]: r["error"] for r in D.zip_positions(a, b, ["pos"]).collect()} == {1: None, 2: "lengths differ"}
    df = spark.createDataFrame([("", "p", "own", "q")], "a string, pa string, b string, pb string")
    assert tuple(df.select(*D.inherit({"a": ("a", "pa"), "b": ("b", "pb")})).first()) == ("p", "own")
    assert one(spark, D.upload_ttl(F.lit(9))) == 60 and one(spark, D.has_scheme(F.lit("img_1"))) is False


def test_registry(spark):
    r = D.Registry()
    r.add("twice", lambda df: df.union(df))
    assert r.run("twice", spark.range(2)).count() == 4 and r.names() == ["twice"]
    with pytest.raises(ValueError):
        r.add("twice", lambda df: df)
    with pytest.raises(KeyError, match="twice"):
        r.run("none", spark.range(1))


def test_run_files(spark, tmp_path):
    c = tmp_path / "contract.json"
    c.write_text('{\n"version": "1", "maxTurns": 50, "toolTimeoutMs": 5, "tools": ["a", "b"]}')
    assert runs.read_contract(spark, str(c)).first()["problem"] is None
    c.write_text('{"version": "1", "maxTurns": 50, "toolTimeoutMs": 5, "tools": ["a", "a"]}')
    assert runs.read_contract(spark, str(c)).first()["problem"] == "tools must be unique"
    for n in (1, 3, 2):
        d = tmp_path / "run" / f"checkpoint-{n}"
        d.mkdir(parents=True)
        (d / "trainer_state.json").write_text("{}")
    assert "/checkpoint-3/" in runs.last_checkpoint(spark, str(tmp_path / "run")).first()["path"]
    s = tmp_path / "s.jsonl"
    s.write_text('{"a": 1}\n{"a": 2}\n')
    assert runs.load_split(spark, str(s), "a int, b string", ["a"]).count() == 2
    with pytest.raises(ValueError, match="lacks b"):
        runs.load_split(spark, str(s), "a int, b string", ["a", "b"])
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.png").write_bytes(b"12345")
    assert runs.read_images(spark, str(tmp_path / "img"), 4).first()["problem"] == "image exceeds the size limit"
