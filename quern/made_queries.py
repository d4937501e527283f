"""Queries over pages that are made from page numbers, so that SQL can say what each operator must return.

The stored pages have one shape without tables, images, headings below the first or
structured data; these have all of that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators import pages as page_ops
from quern.operators import passages
from quern.operators.dom import parse
from quern.operators.extract import link_index, result_page, robots_rules
from quern.operators.markdown import convert, heading_named, sections
from quern.registry import query, table

BASE = "https://made.example/p"


def _made(spark, d, html: str):
    """Pages whose html is ``html`` with ``{n}`` for the page's number."""
    parts = html.split("{n}")
    n = F.col("page_id").cast("string")
    whole: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        whole += [n, F.lit(part)]
    return table(spark, d, "pages").select("page_id", F.lit(BASE).alias("url"), F.concat(*whole).alias("html"))


def _converted(spark, d, html: str, column: str = "markdown", **options):
    """(page_id, markdown) by a conversion with options."""
    return page_ops.per_row(_made(spark, d, html), ["html", "url"], lambda h, u: convert(h, u, **options)[0], column, "string", ["page_id"])


RICH = (
    '<html lang="en"><head><title>T {n}</title><meta name="description" content="D {n}"><meta property="og:title" content="O {n}"><meta property="og:image" content="/o{n}.png">'
    '<meta name="theme-color" content="#112233"><link rel="canonical" href="/c{n}"><link rel="icon" href="/i{n}.ico"><meta name="keywords" content="a, b">'
    '<script type="application/ld+json">{"@graph": [{"@type": "A", "n": {n}, "timezone": "Europe/Paris"}, {"b": [1]}]}</script><script type="application/ld+json">{bad</script>'
    '<script id="__NEXT_DATA__" type="application/json">{"p": {n}}</script>'
    "<style>:root{--primary: #abcdef; --gap: 2px} .x{background:url('/bg{n}.png')} h1{font-family: 'Lora', serif}</style></head>"
    '<body><header><a href="/home">Home</a><img class="logo" src="/logo{n}.svg"></header><main><h1>Title {n}</h1><h2>Part <i>one</i></h2><p>alpha beta gamma delta <b>bold {n}</b> <a href="/a{n}" title="t">A {n}</a></p>'
    '<div><a href="/home">Again</a></div><table><tr><th>h</th><th>k</th></tr><tr><td>{n}</td><td>x|y</td></tr></table><ul><li>one</li><li>two<ol><li>deep</li></ol></li></ul><pre><code class="language-py">x = {n}</code></pre>'
    '<blockquote><p>said</p></blockquote><img src="/i{n}.png" alt="I" width="300" srcset="/w{n}.png 600w, /v{n}.png 2x"><img src="/pixel.gif"><a href="javascript:go(\'/js{n}\')">J</a><a href="mailto:a@b">m</a><a href="#x">f</a></main>'
    '<div itemscope itemtype="https://schema.org/Offer"><span itemprop="name">N {n}</span><span itemprop="name">M</span><div itemprop="seller" itemscope><meta itemprop="id" content="{n}"></div></div><footer>f</footer></body></html>'
)


def _rich(spark, d, *formats):
    return page_ops.features(_made(spark, d, RICH), *formats)


@query(r"""SELECT page_id, '# Title ' || page_id || chr(10) || chr(10) || '## Part *one*' || chr(10) || chr(10) || 'alpha beta gamma delta **bold ' || page_id || '** [A ' || page_id || '](https://made.example/a' || page_id || ' "t")' || chr(10) || chr(10)
 || '[Again](https://made.example/home)' || chr(10) || chr(10) || '| h | k |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | x\|y |' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '  1. deep' || chr(10) || chr(10)
 || '```py' || chr(10) || 'x = ' || page_id || chr(10) || '```' || chr(10) || chr(10) || '> said' || chr(10) || chr(10) || '![I](https://made.example/i' || page_id || '.png)![](https://made.example/pixel.gif)[m](mailto:a@b)[f](https://made.example/p#x)' AS markdown FROM pages""")
def made_markdown(spark, d):
    """Headings, emphasis, links, tables, lists, code, quotes and images."""
    return _rich(spark, d, "markdown").select("page_id", "markdown")


@query("""SELECT page_id, 'T ' || page_id AS title, 'D ' || page_id AS description, 'en' AS language, 'O ' || page_id AS og_title, '/o' || page_id || '.png' AS og_image, '/c' || page_id AS canonical_url, 'a, b' AS keywords, 'Europe/Paris' AS timezone FROM pages""")
def made_metadata(spark, d):
    return _rich(spark, d, "metadata").select("page_id", *(F.col(f"metadata.{c}").alias(c) for c in ("title", "description", "language", "og_title", "og_image", "canonical_url", "keywords", "timezone")))


@query("""SELECT page_id, '{"@type": "A", "n": ' || page_id || ', "timezone": "Europe/Paris"};{"b": [1]}' AS json_ld, '{"p": ' || page_id || '}' AS next_data, 'O ' || page_id AS og_title,
 '{"properties": {"name": ["N ' || page_id || '", "M"], "seller": {"properties": {"id": "' || page_id || '"}}}, "type": "https://schema.org/Offer"}' AS microdata FROM pages""")
def made_structured(spark, d):
    """JSON-LD with a graph and a broken block, next data, OpenGraph, nested microdata."""
    found = _rich(spark, d, "json_ld", "next_data", "opengraph", "microdata")
    return found.select("page_id", F.array_join("json_ld", ";").alias("json_ld"), "next_data", F.element_at("opengraph", "og:title").alias("og_title"), F.array_join("microdata", ";").alias("microdata"))


_IMAGES = """(SELECT page_id, unnest(['bg' || page_id || '.png', 'i' || page_id || '.png', 'logo' || page_id || '.svg', 'v' || page_id || '.png', 'w' || page_id || '.png']) AS f FROM pages)"""


@query(f"SELECT page_id, 'https://made.example/' || f AS image FROM {_IMAGES}")
def made_images(spark, d):
    """Images of src, srcset and styles, without tracking pixels."""
    return _rich(spark, d, "images").select("page_id", F.explode("images").alias("image"))


@query(f"SELECT page_id, 'https://made.example/' || f AS image, (CASE left(f, 1) WHEN 'i' THEN 300 WHEN 'w' THEN 600 ELSE 0 END)::BIGINT AS width FROM {_IMAGES} WHERE left(f, 2) <> 'bg' UNION ALL SELECT page_id, 'https://made.example/pixel.gif', 0::BIGINT FROM pages")
def made_image_widths(spark, d):
    return _rich(spark, d, "image_widths").select("page_id", F.explode("image_widths").alias("image", "width")).select("page_id", "image", F.col("width").cast("long").alias("width"))


@query("""SELECT page_id, 'https://made.example/' || p AS url, t AS text, c AS context, h AS heading, false AS chrome FROM (SELECT page_id, unnest(['home', 'a' || page_id, 'js' || page_id]) AS p, unnest(['Again', 'A ' || page_id, 'J']) AS t,
 unnest(['Again', 'alpha beta gamma delta bold ' || page_id || ' A ' || page_id, 'J']) AS c, unnest(['Part one', 'Part one', 'k']) AS h FROM pages)""")
def made_link_details(spark, d):
    """A link seen in the header and the content, one in a paragraph, and an address inside a script."""
    found = _rich(spark, d, "link_details").select("page_id", F.explode("link_details").alias("l")).select("page_id", "l.*")
    return found


@query("""SELECT page_id, 'light' AS color_scheme, 'https://made.example/logo' || page_id || '.svg' AS logo, 'Lora' AS font, '#112233' AS primary_color, '2px' AS gap, 'https://made.example/i' || page_id || '.ico' AS favicon, 'https://made.example/o' || page_id || '.png' AS og_image FROM pages""")
def made_branding(spark, d):
    """The theme's colour stands in for a variable; the logo is an image of that class."""
    b = _rich(spark, d, "branding").select("page_id", "branding")
    get = lambda path: F.get_json_object("branding", path)
    return b.select(
        "page_id", get("$.color_scheme").alias("color_scheme"), get("$.logo").alias("logo"), get("$.fonts[0]").alias("font"), get("$.colors.primary").alias("primary_color"),
        get("$.spacing['--gap']").alias("gap"), get("$.images.favicon").alias("favicon"), get("$.images.ogImage").alias("og_image"),
    )


CLEAN = "<html><head><script>x</script></head><body><nav>n</nav><main><h1>T {n}</h1><style>y</style><p>a &amp; b</p></main><footer>f</footer></body></html>"


@query("SELECT page_id, '<main><h1>T ' || page_id || '</h1><p>a &amp; b</p></main>' AS clean_html, 'n T ' || page_id || ' a & b f' AS visible_text FROM pages")
def made_clean_html(spark, d):
    return page_ops.features(_made(spark, d, CLEAN), "clean_html", "visible_text").select("page_id", "clean_html", "visible_text")


THREE = "<body><main>" + "".join(f"<h2>{t} {{n}}</h2><p>{t} {'word ' * 30}{t.lower()}</p>" for t in ("Install", "Usage", "License")) + "</main></body>"


@query("SELECT page_id, unnest(['Install ' || page_id, 'Usage ' || page_id, 'License ' || page_id]) AS heading, unnest([1, 2, 3])::BIGINT AS i FROM pages")
def made_sections(spark, d):
    """The headings of a page's sections."""
    heads = page_ops.per_row(_made(spark, d, THREE), ["html"], lambda h: [run[0].text(" ", True) for run in sections(parse(h).find("main"))], "heads", "array<string>", ["page_id"])
    return heads.select("page_id", F.posexplode("heads").alias("i", "heading")).select("page_id", "heading", (F.col("i") + 1).cast("long").alias("i"))


@query("""SELECT page_id, 'Usage ' || page_id AS heading, '{"applied": true, "reason": null, "sections_kept": 1, "sections_total": 3}' AS outcome FROM pages""")
def made_query_filter(spark, d):
    """Of three sections the one that the query names."""
    both = page_ops.per_row(_made(spark, d, THREE), ["html", "page_id"], lambda h, n: [(r := convert(h, None, query=f"usage {n}"))[0].split("\n")[0].removeprefix("## "), json.dumps(r[1], sort_keys=True)], "r", "array<string>", ["page_id"])
    return both.select("page_id", F.col("r")[0].alias("heading"), F.col("r")[1].alias("outcome"))


PICKED = "<body><article><p>kept words of page {n}</p><p class='x'>one {n}</p><div id='y'>two</div></article></body>"


@query("SELECT page_id, 'one ' || page_id || chr(10) || chr(10) || 'two' AS included, 'kept words of page ' || page_id AS excluded FROM pages")
def made_include_exclude(spark, d):
    a = _converted(spark, d, PICKED, "included", include=[".x", "#y"])
    b = _converted(spark, d, PICKED, "excluded", exclude=[".x", "#y"])
    return a.join(b, "page_id")


@query("SELECT page_id, 'inner text ' || page_id AS expanded FROM pages")
def made_attributes(spark, d):
    """Markup that an element with a hyphen holds in an attribute."""
    return _converted(spark, d, "<body><my-card data-body='<p>inner text {n}</p>'></my-card></body>", "expanded")


@query("SELECT page_id, '# Essay' || chr(10) || chr(10) || 'about ' || page_id || ' ' || trim(repeat('word ', 60)) AS markdown FROM pages")
def made_layout_table(spark, d):
    """A page in one cell of a table, its title an image."""
    return _converted(spark, d, "<body><table><tr><td><img alt='Essay' src='t.gif'></td></tr><tr><td><a href='x'>n</a></td><td><p>about {n} " + "word " * 60 + "</p></td></tr></table></body>")


MKDOCS = (
    "<body><div class='md-content'><article><h1>Guide {n}<a class='headerlink' href='#g'>¶</a></h1><p>some words to read here</p><div class='admonition warning'><p class='admonition-title'>Mind</p><p>hot {n}</p></div>"
    "<div class='highlight language-py'><table class='highlighttable'><tr><td class='linenos'>1</td><td class='code'><code>x = {n}</code></td></tr></table></div>"
    "<div class='tabbed-set'><div class='tabbed-labels'><label>A</label></div><div class='tabbed-content'><div class='tabbed-block'><p>first</p></div><div class='tabbed-block'><p>second</p></div></div></div></article></div></body>"
)


@query("""SELECT page_id, '# Guide ' || page_id || chr(10) || chr(10) || 'some words to read here' || chr(10) || chr(10) || '> **Mind:** hot ' || page_id || chr(10) || chr(10) || '```py' || chr(10) || 'x = ' || page_id || chr(10) || '```' || chr(10) || chr(10)
 || '#### A' || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || '#### Tab 2' || chr(10) || chr(10) || 'second' AS markdown FROM pages""")
def made_mkdocs(spark, d):
    """Permalinks, an admonition, numbered code and tabs."""
    return _converted(spark, d, MKDOCS)


@query("SELECT page_id, '1. one ' || page_id || chr(10) || '   1. deep' || chr(10) || '   2. deeper' || chr(10) || '2. two' || chr(10) || chr(10) || 'end of the page here' AS markdown FROM pages")
def made_numbered(spark, d):
    """Paragraphs that carry list levels."""
    return _converted(spark, d, "<body><main><p data-list-level='1'>one {n}</p><p data-list-level='2'>deep</p><p data-list-level='2'>deeper</p><p data-list-level='1'>two</p><p>end of the page here</p></main></body>")


@query("SELECT page_id, '# Post ' || page_id || chr(10) || chr(10) || 'the words of the post' AS markdown FROM pages")
def made_wordpress(spark, d):
    """The title moves into the content; sharing, pagers and ratings go."""
    return _converted(spark, d, "<body class='wp-theme'><header class='entry-header'><h1 class='entry-title'>Post {n}</h1></header><main><p>the words of the post</p><div class='sharedaddy'>share</div><div class='nav-links'>next</div><div class='star-rating'>5</div></main></body>")


@query("SELECT page_id, 'Prose of page ' || page_id || ', ' || trim(repeat('with words, and more words, ', 30)) AS markdown FROM pages")
def made_readable(spark, d):
    """No main element and a heavy list of links beside the prose: the readable part is taken."""
    return _converted(spark, d, "<body><div class='links'>" + "<a href='/x'>link of the day here</a> " * 20 + "</div><div class='story'><p>Prose of page {n}, " + "with words, and more words, " * 30 + "</p></div></body>")


@query("SELECT page_id, page_id % 3 = 0 AS hidden FROM pages")
def made_disclosure(spark, d):
    """Every third page hides a panel behind a collapsed button."""
    p = _made(spark, d, "<body><button aria-expanded='false' aria-controls='p'>more</button><div id='p' HIDE>text {n}</div></body>")
    p = p.withColumn("html", F.replace("html", F.lit("HIDE"), F.when(F.col("page_id") % 3 == 0, "hidden").otherwise("")))
    return page_ops.features(p, "hidden_disclosure").select("page_id", F.col("hidden_disclosure").alias("hidden"))


@query("SELECT page_id, unnest(['https://a.org/' || page_id, 'https://b.org/']) AS url, unnest(['A ' || page_id, 'B']) AS title, unnest(['says ' || page_id, '']) AS snippet FROM pages")
def made_search_results(spark, d):
    """A plain result page with a redirect address and a row without a snippet."""
    html = "<table><tr><td><a class='result-link' href='/l/?uddg=https%3A%2F%2Fa.org%2F{n}&x=1'>A {n}</a></td></tr><tr><td class='result-snippet'>says {n}</td></tr><tr><td><a class='result-link' href='https://b.org/'>B</a></td></tr><tr><td>-</td></tr></table>"
    rows = page_ops.per_row(_made(spark, d, html), ["html"], lambda h: [json.dumps(r) for r in result_page(h)], "rows", "array<string>", ["page_id"])
    return rows.select("page_id", F.explode("rows").alias("r")).select("page_id", *(F.get_json_object("r", f"$.{k}").alias(k) for k in ("url", "title", "snippet")))


@query("""SELECT page_id, '["/a/b"]' AS allow, '["/a", "/p' || page_id || '"]' AS disallow, (page_id % 5)::DOUBLE AS delay, 0.5::DOUBLE AS rate, 's.xml' AS sitemap FROM pages""")
def made_robots(spark, d):
    """Groups for all and for another agent, comments, a delay and a rate."""
    text = "User-agent: *\nDisallow: /a # x\nAllow: /a/b\nDisallow: /p{n}\nCrawl-delay: DELAY\nRequest-rate: 1/2\nRequest-rate: 1/0\nSitemap: s.xml\n\nUser-agent: z\nDisallow: /z\nSitemap: s.xml"
    p = _made(spark, d, text).withColumn("html", F.replace("html", F.lit("DELAY"), (F.col("page_id") % 5).cast("string")))
    rules = page_ops.per_row(p, ["html"], lambda h: json.dumps(robots_rules(h)), "rules", "string", ["page_id"])
    get = lambda k: F.get_json_object("rules", f"$.{k}")
    listed = lambda k: F.concat(F.lit('["'), F.array_join(F.from_json(get(k), "array<string>"), '", "'), F.lit('"]'))
    return rules.select("page_id", listed("allow").alias("allow"), listed("disallow").alias("disallow"), get("crawl_delay").cast("double").alias("delay"), get("request_rate").cast("double").alias("rate"), get("sitemaps[0]").alias("sitemap"))


GUIDE = "# Guide\n\nintro {n}\n\n## Opt `x`\n\nthe option text {n}\n\n```\n# no heading\n```\n\n### Deep\n\ninner\n\n## Other\n\n"


@query("SELECT page_id, '## Opt `x`' || chr(10) || chr(10) || 'the option text ' || page_id || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || 'inner' AS section, '### Deep' || chr(10) || chr(10) || 'inner' AS deep FROM pages")
def made_section(spark, d):
    """A section by its anchor and one by its heading; fenced code holds no headings."""
    p = _made(spark, d, GUIDE + "filler words here " * 60)
    both = page_ops.per_row(p, ["html"], lambda h: [passages.section(h, "#opt-x"), passages.section(h, "Deep")], "r", "array<string>", ["page_id"])
    return both.select("page_id", F.col("r")[0].alias("section"), F.col("r")[1].alias("deep"))


@query("SELECT page_id, '[…]' || chr(10) || chr(10) || '## Opt' || chr(10) || chr(10) || 'the option text ' || page_id AS bounded, 'query_ranked' AS how FROM pages")
def made_bound_ranked(spark, d):
    """Of a text over the limit the section that the query names, with a mark for what is left out."""
    p = _made(spark, d, "# A\n\nintro of the text\n\n## Opt\n\nthe option text {n}\n\n## Other\n\n" + "filler words here " * 60)
    both = page_ops.per_row(p, ["html"], lambda h: list(passages.bound(h, 60, "what is opt")), "r", "array<string>", ["page_id"])
    return both.select("page_id", F.col("r")[0].alias("bounded"), F.col("r")[1].alias("how"))


@query("""SELECT page_id, (i + 1)::BIGINT AS i, CASE i WHEN 0 THEN '# A' || chr(10) || chr(10) || 'short ' || page_id ELSE '| h |' || chr(10) || '| --- |' || chr(10) || rtrim(repeat('| ' || repeat('x', 96) || ' |' || chr(10), CASE i WHEN 5 THEN 4 ELSE 14 END), chr(10)) END AS block,
 CASE i WHEN 0 THEN 'A' ELSE 'B' END AS heading FROM (SELECT page_id, unnest([0, 2, 3, 4, 5]) AS i FROM pages) UNION ALL SELECT page_id, 2, '# B' || chr(10) || chr(10) || 'before', 'B' FROM pages""")
def made_blocks(spark, d):
    """A short section whole, and a long one in pieces that repeat the table's header."""
    p = _made(spark, d, "# A\n\nshort {n}\n\n# B\n\nbefore\n\n| h |\n| --- |\n" + "\n".join("| " + "x" * 96 + " |" for _ in range(46)))
    rows = page_ops.per_row(p.withColumn("html", F.concat("html", F.lit("\n\n" + " " * 4))), ["html"], lambda h: [json.dumps(b) for b in passages.blocks(h)], "b", "array<string>", ["page_id"])
    return rows.select("page_id", F.posexplode("b").alias("i", "b")).select("page_id", (F.col("i") + 1).cast("long").alias("i"), F.get_json_object("b", "$[0]").alias("block"), F.get_json_object("b", "$[1]").alias("heading"))


@query("SELECT page_id, page_id % 2 = 0 AS named FROM pages")
def made_heading_named(spark, d):
    """Every second page's query holds the heading's words in a row."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "how to get started today").otherwise("started to get").alias("asked"))
    return page_ops.per_row(p, ["asked"], lambda q: str(heading_named("Get *Started*", q.split())).lower(), "named", "string", ["page_id"]).select("page_id", (F.col("named") == "true").alias("named"))


@query("SELECT page_id, '--- previous' || chr(10) || '+++ current' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+' || page_id || chr(10) AS diff FROM pages")
def made_diff(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("a\n"), F.col("page_id").cast("string"), F.lit("\n")).alias("new"))
    return page_ops.per_row(p, ["new"], lambda n: passages.unified_diff("a\nb\n", n), "diff", "string", ["page_id"])


@query(r"""WITH w AS (SELECT c.conv_id, c.turn, list_transform(regexp_extract_all(c.text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS a, list_transform(regexp_extract_all(n.text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS b FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
t AS (SELECT conv_id, turn, a, b, list_transform(a, lambda x: list_transform(b, lambda y: x = y)) AS same FROM w),
r AS (SELECT conv_id, turn, len(a) AS n, len(b) AS m, list_reduce(list_prepend(list_transform(range(len(b) + 1), lambda x: 0::BIGINT), list_transform(range(1, len(a) + 1), lambda i: list_prepend(0::BIGINT, list_transform(same[i], lambda s: s::BIGINT)))),
  lambda p, s: list_transform(range(1, len(p) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND s[k] = 1 THEN p[k - 1] + 1 ELSE p[k] END)))) AS last FROM t)
SELECT conv_id, turn, CASE WHEN n + m > 0 AND last[m + 1] > 0 THEN round(2 * last[m + 1]::DOUBLE / (n + m), 9) ELSE 0 END AS rouge_l FROM r""")
def reply_rouge_l(spark, d):
    """Each reply against the next one of its conversation."""
    c = table(spark, d, "conversations")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    found = page_ops.per_row(pairs, ["text", "next"], lambda a, b: passages.rouge_l(passages.words(a), passages.words(b)), "rouge_l", "double", ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.round("rouge_l", 9).alias("rouge_l"))


@query("SELECT page_id, page_id % 2 = 0 AS link_index FROM pages")
def made_link_index(spark, d):
    """Every second page has more links outside its chrome than an index needs."""
    html = F.when(F.col("page_id") % 2 == 0, F.lit("<body><ul>" + "".join(f"<li><a href='/l{k}'>link {k}</a></li>" for k in range(40)) + "</ul></body>")).otherwise(F.lit("<body><nav>" + "".join(f"<a href='/l{k}'>link {k}</a>" for k in range(40)) + "</nav><p>prose</p></body>"))
    p = table(spark, d, "pages").select("page_id", F.lit(BASE).alias("url"), html.alias("html"))
    return page_ops.per_row(p, ["html", "url"], lambda h, u: str(link_index(parse(h), u)).lower(), "r", "string", ["page_id"]).select("page_id", (F.col("r") == "true").alias("link_index"))

