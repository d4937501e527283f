import pytest
from pyspark.sql import functions as F

from quern.functions import detect, quality, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'string' if not isinstance(v, (list, dict, int, bool, float)) else {list: 'array<string>', dict: 'map<string,string>', int: 'int', bool: 'boolean', float: 'double'}[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.org/p?utm_source=x&b=2&a=1#f", "https://a.org/p?a=1&b=2"),
        ("https://A.org/p/?fbclid=1", "https://A.org/p/"),
        ("https://a.org/p?UTM_X=1&ref=2&q=a+b", "https://a.org/p?q=a+b"),
        ("https://a.org", "https://a.org"),
        ("https://a.org/?x", "https://a.org/?x="),
        ("https://a.org/?q=~%2A", "https://a.org/?q=~%2A"),
    ],
)
def test_dedupe_key(spark, url, want):
    key = one(spark, urls.dedupe_key(F.col("u")), u=url)
    assert key == want
    assert one(spark, urls.dedupe_key(F.col("u")), u=key) == key


def test_tracking_keeps_order_and_fragment(spark):
    assert one(spark, urls.strip_tracking(F.col("u")), u="https://a.org/?b=2&gclid=9&a=1#top") == "https://a.org/?b=2&a=1#top"
    assert one(spark, urls.normalise(F.col("u"), F.col("c")), u="https://a.org/x#y", c="https://b.org/?utm_term=1") == "https://b.org/"


def test_cache_address(spark):
    assert one(spark, urls.cache_address(F.col("u")), u="https://a.org/p//?b=1&a=2&b=3&ref=1#f") == "https://a.org/p?b=1&b=3&a=2"
    assert one(spark, urls.cache_address(F.col("u")), u="https://a.org") == "https://a.org/"


def test_hosts(spark):
    assert one(spark, urls.registrable_domain(F.col("u")), u="https://u:p@WWW.A.org:80/x") == "a.org"
    assert one(spark, urls.registrable_domain(F.col("u")), u="mailto:x") is None
    assert one(spark, urls.valid(F.col("u")), u="ftp://a") is False


@pytest.mark.parametrize(("address", "want"), [("10.1.2.3", True), ("8.8.8.8", False), ("172.31.0.1", True), ("172.32.0.1", False), ("300.1.1.1", False), ("x", False)])
def test_blocked(spark, address, want):
    assert one(spark, urls.is_blocked_ipv4(F.col("a")), a=address) is want


def test_markdown_text(spark):
    md = "# Head\n\nSee [the docs](http://a) and ![i](b).\n\n```py\nx\n```\n| a | b |\n| - | - |\n| 1 | 2 |\n"
    counts = {k: one(spark, c, m=md) for k, c in text.structure(F.col("m")).items()}
    assert counts == {"headings": 1, "code_blocks": 1, "tables": 1, "images": 1, "links": 1}
    assert one(spark, text.tokens(F.col("m"), True), m="## A [B c](u) ![d](e) É_1") == ["a", "b", "c", "é_1"]


def test_word_spacing(spark):
    assert one(spark, text.word_spacing(F.col("m")), m="word " * 49) is None
    assert one(spark, text.word_spacing(F.col("m")), m="word " * 60) == 1.0
    assert one(spark, text.word_spacing(F.col("m")), m="word " * 50 + "a" * 40 + " " + "b" * 40) == pytest.approx(1 - (2 / 52) / 0.05)


def test_small_text_functions(spark):
    assert one(spark, text.clean_whitespace(F.col("m")), m="a  \n\n\n\nb\t\n c \n") == "a\n\nb\n c"
    assert one(spark, text.human_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.pdf_date(F.col("m")), m="D:20240131120500Z") == "2024-01-31T12:05:00"
    assert one(spark, text.with_year(F.col("m"), F.lit(2026)), m="latest news") == "latest news 2026"
    assert one(spark, text.with_year(F.col("m"), F.lit(2026)), m="latest news 2024") == "latest news 2024"
    assert one(spark, text.fenced_json(F.col("m")), m='x\n```json\n{"a": 1}\n```').strip() == '{"a": 1}'
    assert one(spark, text.fenced_json(F.col("m")), m="nothing") is None
    assert one(spark, text.us_date(F.col("m")), m="2024-02-09") == "2/9/2024"
    assert one(spark, text.us_date(F.col("m")), m="x") is None
    table = spark.sql("select array(array('a', 'b'), array('1|2'), array('x', 'y', 'z')) as t").select(text.markdown_table(F.col("t")).alias("x")).first()["x"]
    assert table == "| a | b |\n| --- | --- |\n| 1\\|2 |  |\n| x | y |"


def test_detectors(spark):
    assert one(spark, detect.framework(F.col("h")), h='<DIV id="app"></div>') == "react"
    assert one(spark, detect.cdn(F.col("h")), h={"CF-Ray": "x"}) == "cloudflare"
    assert one(spark, detect.cdn(F.col("h")), h={"Server": "AkamaiGHost"}) == "akamai"
    assert one(spark, detect.needs_js(F.col("h"), F.length("h")), h="<body><script>" + "x" * 900 + "</script>" + "w " * 80 + "</body>") is True
    assert one(spark, detect.needs_js(F.col("h"), F.length("h")), h="<body>" + "word " * 200 + "</body>") is False
    assert one(spark, detect.content_grade(F.col("h"), F.lit("")), h="\x01" * 300) == "HARD"
    assert one(spark, detect.content_grade(F.col("h"), F.lit("a b")), h="x" * 300) == "SOFT"


def verdict(spark, status=200, html="<html>x</html>", md="", url="https://a.org/x", links=0, pdf=False):
    df = spark.createDataFrame([(status, html, md, url, links, pdf)], "s int, h string, m string, u string, l int, p boolean")
    return df.select(quality.verdict(F.col("s"), F.col("h"), F.col("m"), F.col("u"), F.col("l"), F.col("p")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("case", "want"),
    [
        ({"status": 403}, "bot_challenge"), ({"status": 404, "md": "w " * 90}, "error_status"), ({"html": None}, "empty"), ({"html": None, "md": "a"}, "ok"),
        ({"html": "\x01" * 50, "md": "w " * 90}, "bot_challenge"), ({"html": "captcha"}, "captcha"), ({"html": "captcha just a moment"}, "bot_challenge"),
        ({"html": "access denied", "md": "a b"}, "bot_challenge"), ({"md": ""}, "empty"), ({"md": "a b"}, "thin"), ({"md": "a b", "links": 5}, "ok"),
        ({"html": "data-reactroot", "md": "a"}, "js_shell"), ({"html": "please login", "md": "a"}, "paywall"), ({"md": "w " * 60}, "ok"),
        ({"pdf": True}, "empty"), ({"pdf": True, "md": "a"}, "thin"), ({"pdf": True, "md": ("a" * 40 + " ") * 60}, "garbled_pdf"),
        ({"md": "w " * 60 + " ".join(f"[x-{i}](/x/alpha-beta-gamma{'abcdef'[i]})" for i in range(6))}, "tarpit"),
        ({"md": "w " * 60 + " ".join(f"[Alpha beta gamma{'abcdef'[i]}](/x/alpha-beta-gamma{'abcdef'[i]})" for i in range(6))}, "ok"),
    ],
)
def test_verdicts(spark, case, want):
    assert verdict(spark, **case) == want


def test_score_never_contradicts_verdict(spark):
    for v, most in quality.CEILING.items():
        assert one(spark, quality.score(F.lit(v), F.lit(1000), F.lit(0), F.lit(1.0)), a="x") <= most
        assert one(spark, quality.advice(F.lit(v)), a="x")
    assert one(spark, quality.score(F.lit("ok"), F.lit(150), F.lit(0), F.lit(None).cast("double")), a="x") == 72


def test_composite(spark):
    none = F.lit(None).cast("double")
    assert one(spark, quality.composite(F.lit(False), F.lit(1.0), none, none, none, none, none, none), a="x") == 0
    assert one(spark, quality.composite(F.lit(True), none, none, none, none, none, none, none), a="x") == 50
    assert one(spark, quality.composite(F.lit(True), F.lit(1.0), F.lit(0.5), none, none, none, none, none), a="x") == 77.3


def test_change_status(spark):
    rows = [(None, "a", False, False, "new"), ("a", "a", False, True, "same"), ("b", "a", False, True, "changed"), (None, "a", False, True, "changed"), ("a", "a", True, True, "removed")]
    df = spark.createDataFrame(rows, "p string, c string, f boolean, s boolean, want string")
    assert all(r["x"] == r["want"] for r in df.select(quality.change_status(F.col("p"), F.col("c"), F.col("f"), F.col("s")).alias("x"), "want").collect())
