"""Text and markdown functions on columns: built-in expressions only (STR-*, AGG-07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: What stands between words; splitting is far cheaper in Spark than extracting matches.
BETWEEN = r"[^\p{L}\p{N}_]+"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"(?<!!)\[[^\]]*\]\([^)]*\)"


def strip_markdown(text: Column) -> Column:
    """Images out, links to their text, no fences and heading marks."""
    text = F.regexp_replace(text, IMAGE, " ")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"```[^\n]*", " ")
    return F.regexp_replace(text, r"(?m)^\s{0,3}#{1,6}\s+", "")


def tokens(text: Column, markdown: bool = False) -> Column:
    """Words in lower case."""
    text = strip_markdown(text) if markdown else text
    return F.transform(F.array_remove(F.split(text, BETWEEN), ""), F.lower)


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, r"\s+"), "")))


def hit_rate(text: Column, needles: Column) -> Column:
    """Share of the needles found in the text, any case; null without needles."""
    found = F.filter(needles, lambda n: F.contains(F.lower(text), F.lower(n)))
    return F.when(F.size(needles) > 0, F.size(found) / F.size(needles))


def absent_rate(text: Column, needles: Column) -> Column:
    return F.when(F.size(needles) > 0, 1 - hit_rate(text, needles))


def structure(markdown: Column) -> dict[str, Column]:
    """Counts of headings, code blocks, table rows beyond two, images and links."""
    count = lambda p: F.coalesce(F.regexp_count(markdown, F.lit(p)), F.lit(0))
    rows = count(r"(?m)^\s{0,3}\|.*\|\s*$")
    return {
        "headings": count(r"(?m)^\s{0,3}#{1,6}\s+\S"),
        "code_blocks": F.floor(count(r"(?m)^\s{0,3}```") / 2).cast("int"),
        "tables": F.greatest(rows - 2, F.lit(0)),
        "images": count(IMAGE),
        "links": count(LINK),
    }


def link_density(links: Column, words: Column) -> Column:
    return F.when(words > 0, links * 1000.0 / words).otherwise(0.0)


def word_spacing(markdown: Column) -> Column:
    """1 for clean spacing down to 0 at 5 % of fused words; null under 50 words."""
    words = tokens(markdown, True)
    fused = F.size(F.filter(words, lambda t: t.rlike("^[a-z]{31,}$")))
    return F.when(F.size(words) >= 50, F.greatest(F.lit(0.0), 1 - fused / F.size(words) / 0.05))


def char_coverage(extracted: Column, reference: Column) -> Column:
    return F.when(reference > 0, F.least(F.lit(1.0), extracted / reference)).otherwise(0.0)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def clean_whitespace(markdown: Column) -> Column:
    """Lines without trailing space, one blank line at most, none at the ends."""
    text = F.regexp_replace(markdown, r"\r\n|[\r\x0B\f\x1C-\x1E\x85  ]", "\n")
    text = F.regexp_replace(text, r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def head(markdown: Column, most: int) -> Column:
    """The first ``most`` characters, up to a line's end if that keeps over four fifths."""
    cut = F.substring(markdown, 1, most)
    line = F.char_length(F.regexp_extract(cut, r"(?s)^(.*)\n", 1))
    return F.when(F.char_length(markdown) <= most, markdown).otherwise(F.when((line > 0.8 * most) & F.contains(cut, F.lit("\n")), F.substring(cut, F.lit(1), line)).otherwise(cut))


def bound_words(text: Column, most: int) -> Column:
    """At most ``most`` words: up to a sentence's end in the second half of what is kept, else with an ellipsis."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    kept = F.slice(words, 1, most)
    ends = F.filter(F.transform(kept, lambda w, i: F.when(w.rlike(r"[.!?]$"), i + 1)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(ends), F.lit(0))
    cut = F.when(last * 2 >= most, F.array_join(F.slice(kept, F.lit(1), F.greatest(last, F.lit(1))), " ")).otherwise(F.concat(F.array_join(kept, " "), F.lit("…")))
    return F.when(F.size(words) <= most, F.trim(text)).otherwise(cut)


def closed_references(html: Column) -> Column:
    """HTML in which references that lack their semicolon are text, as in XML; HTML's own rules take ``&amp`` for ``&amp;``."""
    return F.regexp_replace(html, "&(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))", "&amp;")


def summary_cut(text: Column, most: int = 500) -> Column:
    """At most ``most`` characters, up to the last full stop if there is one."""
    cut = F.substring(text, 1, most)
    stop = F.regexp_extract(cut, r"(?s)^(.*\.)", 1)
    return F.when(F.char_length(text) <= most, text).otherwise(F.when(stop != "", stop).otherwise(cut))


def content_hash(text: Column, url: Column | None = None) -> Column:
    """SHA-256 of address, two bars and text."""
    return F.sha2(F.concat(F.coalesce(url, F.lit("")) if url is not None else F.lit(""), F.lit("||"), text), 256)


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def human_size(size: Column) -> Column:
    """Bytes with one decimal in the largest fitting unit."""
    out = F.format_string("%.1f GB", F.bround(size / 1024.0**3, 1))
    for power, unit in ((2, "MB"), (1, "KB")):
        out = F.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def markdown_table(rows: Column) -> Column:
    """A 2-D array as a markdown table: bars escaped, ragged rows padded or cut to the first's width."""
    width = F.size(F.element_at(rows, 1))
    clean = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    fitted = lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: clean(F.get(r, i - 1)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(fitted(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n")).otherwise("")


def fenced_json(reply: Column) -> Column:
    """The JSON text of a reply: the reply itself, or what its first fence holds; null if neither parses."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    loose = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    parses = lambda c: F.try_parse_json(c).isNotNull()
    out = F.when(parses(loose) & (loose != ""), loose)
    out = F.when(parses(inner) & (inner != ""), inner).otherwise(out)
    return F.when(parses(reply), reply).otherwise(out)


def frontmatter(fields: dict[str, Column]) -> Column:
    """YAML front matter of the fields that are not null; quotes are escaped."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---"))


def domain_hit(urls: Column, domains: Column) -> Column:
    """Whether any URL's host is one of the domains or below it."""
    from quern.functions.urls import host

    return F.exists(urls, lambda u: F.exists(domains, lambda d: (host(u) == F.lower(d)) | host(u).endswith(F.concat(F.lit("."), F.lower(d)))))


def days_back(span: Column, today: Column) -> Column:
    """Start date of a day, week, month or year back."""
    days = F.when(span == "day", 1).when(span == "week", 7).when(span == "month", 30).when(span == "year", 365)
    return F.date_sub(today, days)


def us_date(day: Column) -> Column:
    return F.date_format(F.to_date(day.try_cast("date")), "M/d/yyyy")


def iso_instant(day: Column) -> Column:
    return F.concat(F.date_format(day.try_cast("date"), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` as ISO 8601; other text as it is."""
    p = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?"
    part = lambda k: F.regexp_extract(text, p, k)
    time = F.when(part(6) != "", F.concat(F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6))).otherwise(F.lit(""))
    return F.when(text.rlike(p), F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), time)).otherwise(text)


# Words that make a query one about the present.
TIMELY = [
    "latest", "recent", "newest", "current", "new", "now", "today", "best", "top", "alternative", "alternatives", "vs", "versus", "comparison", "compared",
    "download", "install", "release", "version", "update", "changelog", "review", "reviews", "ranking", "rankings", "guide", "tutorial",
]


def with_year(query: Column, year: Column) -> Column:
    """The query with the year after it, if it is about the present and names no year."""
    words = F.transform(F.regexp_extract_all(query, F.lit(WORD), F.lit(0)), F.lower)
    timely = F.arrays_overlap(words, F.array(*map(F.lit, TIMELY)))
    return F.when(timely & ~query.rlike(r"\b(?:19|20)\d{2}\b"), F.concat(query, F.lit(" "), year.cast("string"))).otherwise(query)


def is_base64(text: Column) -> Column:
    """Whether a text is one padded run of base64 of 252 digits or more."""
    return F.coalesce((F.char_length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]{252,}={0,2}$"), F.lit(False))


def filtered(fields: Column, change, binary: tuple[str, ...] = ("screenshot", "pdf", "image")) -> Column:
    """A map of texts with ``change`` over each value, but for base64 under the names of binary fields."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*binary) & is_base64(v), v).when(v == "", v).otherwise(change(v)))
