"""What a browser would open, from stored pages: frames put in place (PRJ-34), closed regions opened (PRJ-35).

Frames are a join of pages with stored pages by address: each page says which frames it
has, in its own order; their bodies come back beside it and take the frames' places.
Deeper frames are put into the stored pages first, a level at a time.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dom import Document, Node, markup, parse
from quern.scratch import materialize

#: Frames of a page that are put in place: the last so many.
MOST = 10
# Hosts whose frames are left out (advertising, counting, CAPTCHA).
AD_HOSTS = (
    "doubleclick.net", "googlesyndication.com", "amazon-adsystem.com", "adnxs.com", "adsrvr.org", "moatads.com", "taboola.com", "outbrain.com",
    "google-analytics.com", "googletagmanager.com", "analytics.google.com", "connect.facebook.net", "bat.bing.com", "sc-static.net", "hotjar.com", "clarity.ms",
    "recaptcha.net", "hcaptcha.com", "challenges.cloudflare.com",
)
#: What marks navigation: names, roles, and words of classes.
NAV_ROLES = ("navigation", "menubar", "menu")
_NAV_CLASS = re.compile(r"\b(?:hamburger|mobile-nav|site-nav|main-nav|primary-nav|mega-menu|dropdown-nav|nav-menu|menu-toggle|topnav|global-nav)\b")
_FRAMES = "page_id long, url string, html string, k int, frame string"


def _tiny(frame: Node) -> bool:
    """Whether a frame says, by attribute or style, that it is at most five points wide or high."""
    style = re.sub(r"\s", "", frame.get("style") or "").lower()
    for side in ("width", "height"):
        said = re.search(rf"(?:^|;){side}:(\d+(?:\.\d+)?)px", style) or re.fullmatch(r"\s*(\d+(?:\.\d+)?)(?:px)?\s*", frame.get(side) or "")
        if said and float(said[1]) <= 5:
            return True
    return "display:none" in style or "hidden" in frame.attrs


def wanted_frames(doc: Document, url: str, same_origin: bool) -> list[tuple[int, str]]:
    """(place among the page's frames, address) of those to put in place."""
    own, out = urlsplit(url or ""), []
    for k, frame in enumerate(doc.find_all("iframe")):
        src = (frame.get("src") or "").strip()
        try:
            at = urljoin(url or "", src)
            parts = urlsplit(at)
        except ValueError:
            continue
        host = (parts.hostname or "").lower()
        if not src or parts.scheme not in ("http", "https") or _tiny(frame) or any(host == h or host.endswith(f".{h}") for h in AD_HOSTS):
            continue
        if not same_origin or (parts.scheme, parts.netloc.lower()) == (own.scheme, own.netloc.lower()):
            out.append((k, at))
    return out[-MOST:]


def _asked(same_origin: bool):
    """A row a frame, the page's html with its first row; pages without frames have one row."""

    def ask(batches):
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                frames = wanted_frames(parse(html), url, same_origin) if html and "<iframe" in html.lower() else []
                rows.append((page, url, html, -1, None))
                rows += [(page, url, None, k, at) for k, at in frames]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FRAMES.split(", ")])

    return ask


def _spliced(batches):
    for batch in batches:
        made = []
        for html, held in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not held:
                made.append((html, 0))
                continue
            doc, done = parse(html), 0
            frames = doc.find_all("iframe")
            for x in held:
                body = parse(x["body"])
                body = body.find("body") or body
                if not markup_of(body).strip():
                    continue
                box = Node("div", {"data-frame-src": x["frame"]})
                note, said = Node("p"), Node("em")
                said.append(f"[Embedded content from {urlsplit(x['frame']).hostname}]")
                note.append(said)
                inner = Node("div")
                for child in list(body.children):
                    inner.append(child)
                box.append(note)
                box.append(inner)
                at = frames[x["k"]]
                box.parent = at.parent
                at.parent.children = [box if c is at else c for c in at.parent.children]
                done += 1
            made.append((markup_of(doc), done))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["page_id", "url", "html", "n_frames"])


def markup_of(node: Node) -> str:
    return "".join(markup(c) for c in node.children)


def with_frames(pages: DataFrame, stored: DataFrame, same_origin: bool = True, depth: int = 1) -> DataFrame:
    """Pages (page_id, url, html) with stored frames (url, html) in place of their iframes, and ``n_frames``, how many.

    A frame that is not stored, or has nothing in its body, stays as it is; frames within frames are put in place to
    ``depth`` levels.  Of stored pages with one address the first by its text counts.
    """
    held = stored.where("url is not null and html is not null").groupBy("url").agg(F.min("html").alias("html"))
    held = alone = held.withColumn("page_id", F.xxhash64("url"))
    for _ in range(depth - 1):
        held = with_frames(alone, held, same_origin).select("page_id", "url", "html")
    asked = materialize(pages.select("page_id", "url", "html").mapInArrow(_asked(same_origin), _FRAMES), "frames")
    frames = asked.where("k >= 0").select("page_id", "url", "k", "frame").distinct()
    bodies = frames.join(held.select(F.col("url").alias("frame"), F.col("html").alias("body")), "frame")
    found = bodies.groupBy("page_id", "url").agg(F.sort_array(F.collect_list(F.struct("k", "frame", "body"))).alias("held"))  # at most MOST
    whole = asked.where("k < 0").select("page_id", "url", "html").join(found, ["page_id", "url"], "left")
    return whole.select("page_id", "url", "html", "held").mapInArrow(_spliced, "page_id long, url string, html string, n_frames int")


def opened(html: str) -> tuple[str, int]:
    """A page with its closed regions open, and how many: details, and panels that a collapsed control names.

    What lies in navigation stays shut, and so do panels of buttons that send or reset a form, and what a control
    without ``aria-controls`` may open.  Pages without such marks come back as they are.
    """
    low = (html or "").lower()
    if "<details" not in low and "aria-expanded" not in low:
        return html, 0
    doc, count = parse(html), 0

    def in_navigation(n: Node) -> bool:
        return any(p.name == "nav" or (p.get("role") or "").lower() in NAV_ROLES or _NAV_CLASS.search((p.get("class") or "").lower()) for p in (n, *n.parents()))

    panels = {e.get("id"): e for e in reversed(list(doc.elements())) if e.get("id")}
    for d in doc.find_all("details"):
        if "open" not in d.attrs and not in_navigation(d):
            d.attrs["open"] = ""
            count += 1
    for control in doc.find_all(aria_expanded="false"):
        named = (control.get("aria-controls") or "").split()
        if not named or in_navigation(control) or (control.get("type") or "").lower() in ("submit", "reset") or any(p.name == "details" for p in control.parents()):
            continue
        control.attrs["aria-expanded"] = "true"
        count += 1
        for name in named:
            panel = panels.get(name)
            if panel is not None and not in_navigation(panel):
                _shown(panel)
    return (markup_of(doc) if count else html), count


def _shown(panel: Node) -> None:
    panel.attrs.pop("hidden", None)
    panel.attrs.pop("aria-hidden", None)
    if "class" in panel.attrs:
        panel.attrs["class"] = " ".join(c for c in panel.classes if c.lower() not in ("hidden", "collapse", "collapsed", "is-hidden", "d-none"))
    if "style" in panel.attrs:
        panel.attrs["style"] = re.sub(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden|max-height\s*:\s*0\w*|height\s*:\s*0\w*)\s*(?:!important)?(?=;|$)", "", panel.attrs["style"])
