"""The gate by keywords finds exactly those that a text contains."""

import random
import re

from quern.llm import license_scan


def test_keywords_are_those_of_the_text(spark):
    rng = random.Random(2)
    known = sorted({r[2] for r in license_scan.rules()})
    texts = [" ".join(rng.choice([*known, "plain", "words", "copy", "cc", "free"]) for _ in range(rng.randrange(0, 6))) for _ in range(300)] + known
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    for r in rows.select("t", license_scan.keywords(F.col("t")).alias("k")).collect():
        assert sorted(r["k"]) == [w for w in known if w in r["t"]]


def test_every_sentence_holds_its_keyword():
    """A literal keyword stands in its pattern, spaces and escapes aside, so the rule can fire."""
    for label, keyword, pattern in license_scan.SENTENCES:
        plain = re.sub(r"\\s\+?", " ", pattern).replace("\\.", ".").replace("\\", "").replace(",?", ",")
        assert keyword in plain or keyword in re.sub(r"[()?:]|\|[^)]*", "", plain), (label, keyword)
