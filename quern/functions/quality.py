"""Quality verdict and score of a page from feature columns (PRD-01..04, PRD-18..21, AGG-09/10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import detect, text
from quern.functions.urls import authority, path

THIN, SATURATED, LINKS_FLOOR, FUSED = 50, 300, 50.0, 0.5
INDEX_LINKS = 5

# The most a score may be under a verdict.
CEILING = {"js_shell": 30, "paywall": 45, "thin": 45, "bot_challenge": 15, "captcha": 15, "error_status": 10, "garbled_pdf": 25, "empty": 0, "tarpit": 10}
# Verdicts without usable content.
HARD_FAIL = ["bot_challenge", "captcha", "error_status", "garbled_pdf", "empty", "infrastructure", "tarpit"]
# Verdicts that a stronger fetch may mend.
ESCALATE = ["bot_challenge", "js_shell", "empty"]
#: What to do about a verdict.
ADVICE = {
    "bot_challenge": "The site served an anti-bot challenge: use a stealth engine or a proxy.",
    "captcha": "A CAPTCHA stands before the page: enable solving or use another source.",
    "js_shell": "The content is rendered by scripts: wait longer.",
    "thin": "Little content was found: keep more of the page, wait longer, or sign in.",
    "paywall": "The page asks for a login or a subscription: supply a session.",
    "garbled_pdf": "Word spacing of the PDF is broken: read it again by OCR.",
    "empty": "Nothing could be extracted: wait longer or keep the whole page.",
    "error_status": "The server answered with an error: check the address.",
    "infrastructure": "The reader's own engine failed: try again.",
    "tarpit": "The page is a maze of generated links: do not retry.",
}
FALLBACK_ADVICE = "No clean content came back: read the reasons and try other settings."


def link_maze(markdown: Column, url: Column) -> Column:
    """(same_host, descendants, generated) of the links and images in the markdown, relative to the page."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(markdown, F.lit(r'!?\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), F.lit(1)).alias("words"),
        F.regexp_extract_all(markdown, F.lit(r'!?\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), F.lit(2)).alias("to"),
    )
    base = F.regexp_replace(path(url), "[^/]*$", "")
    own = F.regexp_replace(path(url), "/+$", "")

    def resolved(p: Column) -> Column:
        to = p["to"]
        at = F.when(authority(to) != "", path(to)).when(to.startswith("/"), path(to)).otherwise(F.concat(base, path(to)))
        return F.struct((authority(to) == "").alias("local"), authority(to).alias("host"), at.alias("path"), p["words"].alias("words"))

    here = F.filter(F.transform(pairs, resolved), lambda r: r["local"] | (r["host"] == authority(url)))
    below = F.filter(here, lambda r: F.regexp_replace(r["path"], "/+$", "").startswith(F.concat(own, F.lit("/"))))

    def generated(r: Column) -> Column:
        last = F.regexp_extract(F.regexp_replace(r["path"], "/+$", ""), r"([^/]*)$", 1)
        last = F.coalesce(F.try_url_decode(last), last)
        titled = F.contains(F.trim(r["words"]), F.lit(" ")) & (text.slugify(last) != "")
        authored = titled & ((text.slugify(r["words"]) == text.slugify(last)) | text.slugify(r["words"]).startswith(F.concat(text.slugify(last), F.lit("-"))))
        return (last != "") & (last.rlike(r"[^\x00-\x7F]") | (last.rlike(r"(?i)^[a-z]+(?:-[a-z]+){2,}") & ~authored))

    return F.struct(F.size(here).alias("same_host"), F.size(below).alias("descendants"), F.size(F.filter(below, generated)).alias("generated"))


def is_tarpit(markdown: Column, url: Column) -> Column:
    maze = link_maze(markdown, url)
    n, d, g = (maze[k] for k in ("same_host", "descendants", "generated"))
    return F.coalesce((n >= 5) & (d >= 0.8 * n) & (g >= 0.5 * d), F.lit(False))


def verdict(status: Column, html: Column, markdown: Column, url: Column, index_links: Column, is_pdf: Column | None = None, declared_index: bool = False) -> Column:
    """The first gate that a page fails, ``ok`` if none.  ``index_links``: content links with text."""
    words = text.word_count(markdown)
    spacing = text.word_spacing(markdown)
    few = words < THIN
    index = few & (index_links >= (1 if declared_index else INDEX_LINKS))
    low = detect
    pdf = F.when(words == 0, "empty").when(spacing < FUSED, "garbled_pdf").when(few, "thin").otherwise("ok")
    page = (
        F.when(status.isin(403, 429, 503), "bot_challenge")
        .when(status >= 400, "error_status")
        .when(F.coalesce(html, F.lit("")) == "", F.when(words == 0, "empty").otherwise("ok"))
        .when(low.non_printable_share(html) > 0.30, "bot_challenge")
        .when(low.captcha(html) & few, F.when(low.challenge(html), "bot_challenge").otherwise("captcha"))
        .when((low.challenge(html) | low.denied(html)) & few, "bot_challenge")
        .when((words == 0) & ~index, "empty")
        .when(few & ~index & low.framework(html).isNotNull(), "js_shell")
        .when(few & ~index & low.login(html), "paywall")
        .when(few & ~index, "thin")
        .when(is_tarpit(markdown, url), "tarpit")
        .otherwise("ok")
    )
    return page if is_pdf is None else F.when(is_pdf, pdf).otherwise(page)


def score(verdict_: Column, words: Column, links: Column, spacing: Column, index: Column | None = None) -> Column:
    """0 to 100 by length, spacing and links, not above the verdict's ceiling."""
    index = F.lit(False) if index is None else index
    length = F.when(index, 1.0).otherwise(F.least(F.lit(1.0), words / SATURATED))
    clean = F.when(index, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - text.link_density(links, words) / LINKS_FLOOR))
    blend = F.bround(100 * (0.55 * length + 0.30 * F.coalesce(spacing, F.lit(1.0)) + 0.15 * clean)).cast("int")
    return F.least(blend, F.coalesce(F.element_at(_constant(CEILING), verdict_), F.lit(100)))


def _constant(d: dict) -> Column:
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v))))


def usable(verdict_: Column) -> Column:
    return ~verdict_.isin(HARD_FAIL)


def advice(verdict_: Column) -> Column:
    return F.when(verdict_ != "ok", F.coalesce(F.element_at(_constant(ADVICE), verdict_), F.lit(FALLBACK_ADVICE)))


def recovered(main: Column, whole: Column) -> Column:
    """The main content, or the whole page if that is three times as long and the main content is thin."""
    m, w = text.word_count(main), text.word_count(whole)
    return F.when((m < THIN) & (w >= F.greatest(F.lit(THIN), 3 * m)), whole).otherwise(main)


def expected(markdown: Column, expect: Column, selected: Column | None = None) -> Column:
    """Digits: at least so many words; else the text, any case, or a selector's match."""
    found = F.contains(F.lower(markdown), F.lower(expect))
    if selected is not None:
        found = found | selected
    return F.when(expect.rlike(r"^\d+$"), text.word_count(markdown) >= expect.try_cast("int")).otherwise(found)


def overlaid(success: Column, error: Column, advice_: Column, expect: Column, met: Column) -> Column:
    """(success, error, suggestion) after a caller's assertion: a success without the asserted content is a failure."""
    missed = expect.isNotNull() & ~F.coalesce(met, F.lit(False)) & success
    said = F.concat(F.lit("The page loaded without the content asked for: "), expect, F.lit("."))
    return F.struct((success & ~missed).alias("success"), F.when(missed, said).otherwise(error).alias("error"), F.when(missed, F.concat(said, F.lit(" Wait longer, use a stronger engine, or check the assertion."))).otherwise(advice_).alias("suggestion"))


def composite(success: Column, coverage: Column, f1: Column, noise: Column, hit: Column, absent: Column, density: Column, spacing: Column) -> Column:
    """Weighted mean of the signals that are there, 0 for failures, 50 without signals."""
    parts = [(0.30, coverage), (0.25, f1), (0.15, hit), (0.15, 1 - noise), (0.10, absent), (0.05, F.when(density.isNotNull(), F.greatest(F.lit(0.0), 1 - density / 50.0))), (0.10, spacing)]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(~success, 0.0).when(total == 0, 50.0).otherwise(F.bround(100 * value / total, 1))


def change_status(previous: Column, current: Column, failed: Column, seen: Column) -> Column:
    """new, same, changed or removed."""
    return F.when(failed & seen, "removed").when(~seen, "new").when(F.coalesce(previous == current, F.lit(False)), "same").otherwise("changed")
