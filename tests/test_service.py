from pyspark.sql import functions as F

from quern.plans import service


def test_ladder(spark):
    rows = [("playwright", False, False, False, False, "patchright (stealth)"), (None, True, False, False, False, "camoufox"), ("camoufox", False, False, False, False, "camoufox + HTTP/1.1"), ("camoufox", False, True, False, False, None), ("playwright", False, False, True, False, None), ("playwright", False, False, True, True, "camoufox")]
    df = spark.createDataFrame(rows, "e string, s boolean, p boolean, pin boolean, h boolean, want string")
    for r in df.select(service.next_step(F.col("e"), F.col("s"), F.col("p"), F.col("pin"), F.col("h")).alias("x"), "want").collect():
        assert r["x"] == r["want"]


def test_prompt_loses_words_inside_words(spark):
    assert spark.range(1).select(service.prompt_query(F.lit("Find all the weather from Oslo")).alias("x")).first()["x"] == "wea r oslo"


def test_failure_text(spark):
    x = spark.range(1).select(service.failure_text(F.lit("empty"), F.array(F.lit("no text")), F.lit("Try.")).alias("x"), service.failure_text(F.lit("ok"), F.array(), F.lit("a")).alias("y")).first()
    assert x["x"] == "No usable content (empty): no text. Try." and x["y"] is None


def test_images_and_fields(spark):
    images = spark.createDataFrame([(1, "a", 10), (1, "b", 0), (1, "c", 50)], "page_id int, url string, hint int")
    assert {r["url"] for r in service.probed_images(images, 2).collect()} == {"b", "c"}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert {(r["k"], r["previous"], r["current"]) for r in service.field_changes(old, new, "k", "v").collect()} == {("a", 1, None), ("c", None, 3)}


def test_extracted_and_counts(spark):
    items = spark.createDataFrame([("j", 1, True, "b"), ("j", 0, True, "a"), ("k", 0, False, None)], "job string, ix int, success boolean, data string")
    got = {r["job"]: (r["success"], r["data"]) for r in service.extracted(items, "job").collect()}
    assert got["j"] == (True, ["a", "b"]) and got["k"][0] is False
    assert tuple(service.batch_counts(items).first()) == (3, 2, 1)
