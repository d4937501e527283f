"""Frames in place, regions open."""

import pytest

from quern.operators.dom import parse
from quern.operators.embedded import opened, wanted_frames, with_frames
from quern.operators.markdown import convert


def spliced(spark, html, stored, **more):
    pages = spark.createDataFrame([(1, "http://a.org/p", html)], "page_id long, url string, html string")
    (row,) = with_frames(pages, spark.createDataFrame(stored, "url string, html string"), **more).collect()
    return row.html, row.n_frames


def test_frames_in_their_places(spark):
    stored = [("http://a.org/one", "<html><head><title>no</title></head><body><p>one &amp; <b>more</b></p></body></html>"), ("http://b.org/two", "two"), ("http://a.org/empty", "<body> </body>")]
    html = '<p>x</p><iframe src="/one"></iframe><p>y</p><iframe src="http://b.org/two"></iframe><iframe src="/one"></iframe><iframe src="/empty"></iframe><iframe src="/gone"></iframe>'
    one = '<div data-frame-src="http://a.org/one"><p><em>[Embedded content from a.org]</em></p><div><p>one &amp; <b>more</b></p></div></div>'
    rest = '<iframe src="/empty"></iframe><iframe src="/gone"></iframe>'
    assert spliced(spark, html, stored) == (f'<p>x</p>{one}<p>y</p><iframe src="http://b.org/two"></iframe>{one}{rest}', 2)
    two = '<div data-frame-src="http://b.org/two"><p><em>[Embedded content from b.org]</em></p><div>two</div></div>'
    assert spliced(spark, html, stored, same_origin=False) == (f"<p>x</p>{one}<p>y</p>{two}{one}{rest}", 3)


def test_frames_within_frames_to_a_depth(spark):
    stored = [("http://a.org/1", '<p>1</p><iframe src="/2"></iframe>'), ("http://a.org/2", '<p>2</p><iframe src="/1"></iframe>')]
    for depth in (1, 2, 3):
        html, _ = spliced(spark, '<iframe src="/1"></iframe>', stored, depth=depth)
        assert html.count("[Embedded") == depth and html.count("<iframe") == 1


@pytest.mark.parametrize(
    "tag, taken",
    [
        ('<iframe src="/x">', True), ("<iframe>", False), ('<iframe src="">', False), ('<iframe src="about:blank">', False), ('<iframe src="javascript:x()">', False), ('<iframe src="/x" width="5">', False), ('<iframe src="/x" width="6" height="100%">', True),
        ('<iframe src="/x" style="width: 1px">', False), ('<iframe src="/x" style="display: none">', False), ('<iframe src="/x" hidden>', False), ('<iframe src="https://ad.doubleclick.net/x">', False), ('<iframe src="https://notdoubleclick.net/x">', True), ('<iframe src="http://[bad">', False),
    ],
)
def test_which_frames(tag, taken):
    assert bool(wanted_frames(parse(tag), "http://a.org/", False)) == taken


def test_the_last_ten(spark):
    frames = wanted_frames(parse("".join(f'<iframe src="/{k}"></iframe>' for k in range(15))), "http://a.org/", True)
    assert [k for k, _ in frames] == list(range(5, 15))
    assert spliced(spark, None, [("u", "h")]) == (None, 0)


@pytest.mark.parametrize(
    "html, count, said",
    [
        ("<details><summary>s</summary>body</details>", 1, None), ("<details open>x</details>", 0, None), ("<nav><details>x</details></nav>", 0, None), ('<div role="menu"><details>x</details></div>', 0, None), ('<div class="Site-Nav x"><details>x</details></div>', 0, None),
        ('<button aria-expanded="false" aria-controls="p">b</button><div id="p" hidden class="box collapse" style="color:red; display: none">panel words</div>', 1, "panel words"), ('<button aria-expanded="false">b</button><div id="p" hidden>x</div>', 0, None),
        ('<button type="submit" aria-expanded="false" aria-controls="p">b</button><div id="p" hidden>x</div>', 0, None), ('<a aria-expanded="true" aria-controls="p">b</a>', 0, None), ('<a aria-expanded="false" aria-controls="later">b</a>', 1, None),
        ('<a aria-expanded="false" aria-controls="p q">b</a><p id="p" style="display:none">one</p><p id="q" aria-hidden="true">two</p>', 1, "two"), ("plain", 0, None), ("", 0, None),
    ],
)
def test_regions(html, count, said):
    made, n = opened(html)
    assert n == count and (count or made == html) and opened(made)[1] == 0
    if said:
        assert said in convert(made)[0] and "hidden" not in made and "none" not in made


def test_null_page():
    assert opened(None) == (None, 0)
