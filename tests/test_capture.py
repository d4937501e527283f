"""Text as laid out, and bounded requests for metadata."""

import asyncio
import time

import pytest

from quern.operators.dom import parse
from quern.operators.rendered import captured, gold, inner_text
from quern.sources import enrich


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div>a</div><div>b</div>", "a\nb"), ("<p>a</p><p>b</p>", "a\n\nb"), ("a <b> b</b>  c\n d", "a b c d"), ("a<br>b <br> c", "a\nb\nc"), ("<p>a</p>x<div><p>b</p></div>", "a\n\nx\n\nb"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("a<span style='white-space: pre'>  x  </span>b", "a  x  b"), ("<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>", "1\t2\n3"), ("<ul><li>a<li>b</ul>", "a\nb"), ("a<script>x</script><style>y</style><noscript>z</noscript>b", "ab"),
        ("a<i hidden>x</i><i style='display:none'>y</i><i style='visibility:hidden'>z<u style='visibility:visible'>w</u></i>", "aw"), ("<span style='display:block'>a</span>b<div style='display:inline'>c</div>", "a\nbc"), ("&amp; &nbsp;x", "& \xa0x"), ("", ""), ("<h1> T </h1> <p> x </p> ", "T\n\nx"),
    ],
)
def test_inner_text(html, text):
    assert inner_text(parse(f"<body>{html}</body>")) == text


def test_containers_and_counts(spark):
    html = "<body><nav><a>n</a></nav><div id='content'>c</div><article>first<img><h2>x</h2></article><article>second</article><pre><code>k</code></pre></body>"
    assert gold(parse(html)) == ("first\nx", "n\nc\nfirst\nx\nsecond\nk", [1, 0, 2, 1, 1])
    assert gold(parse(html.replace("article", "section")))[0] == "c" and gold(parse("plain"))[0] == "plain"
    rows = captured(spark.createDataFrame([(1, html), (2, None), (3, "")], "case_id long, html string")).orderBy("case_id").collect()
    assert [(r.gold_text, r.links) for r in rows] == [("first\nx", 1), (None, None), ("", 0)]


def test_bounds_of_requests():
    now, most, times = 0, 0, {}

    async def fetch(method, url):
        nonlocal now, most
        now += 1
        most = max(most, now)
        times.setdefault(url.split("/")[0], []).append(time.monotonic())
        await asyncio.sleep(0.02 if "slow" not in url else 5)
        now -= 1
        if "bad" in url:
            raise ValueError("no host")
        return (405 if method == "HEAD" and "head" in url else 200), {"Content-Length": "x" if "odd" in url else "12", "CONTENT-TYPE": "a/b ; c=d"}

    rows = [(f"h{k % 3}", f"h{k % 3}/{k}") for k in range(12)] + [("s", "s/slow"), ("b", "b/bad"), ("m", "m/head"), ("o", "o/odd")]
    got = {r[0]: r[1:] for r in asyncio.run(enrich._all(fetch, rows, 4, 0.05, 0.3))}
    assert most <= 4 and len(got) == 16
    assert all(b - a >= 0.045 for v in times.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False) if len(v) == 4)
    assert got["h0/0"] == ("a/b", 12, None, None) and got["s/slow"][3] == "timeout" and got["b/bad"][3] == "no host" and got["m/head"][1] == 12 and got["o/odd"][1] is None


def test_results_keep_their_rows(spark):
    async def fetch(method, url):
        if url.endswith("2"):
            raise ValueError("gone")
        return 200, {"content-type": "t"}

    rows = spark.createDataFrame([(1, "http://a/1", "web"), (2, "http://a/2", "web"), (3, "http://a/1", "news"), (4, "http://a/1", "web"), (5, None, "web")], "i int, url string, source_type string")
    found, dead = enrich.enriched(rows, fetch)
    assert sorted((r.i, r.metadata and r.metadata.content_type) for r in found.collect()) == [(1, "t"), (2, None), (3, None), (4, "t"), (5, None)]
    assert [tuple(r) for r in dead.collect()] == [("http://a/2", "gone")]
