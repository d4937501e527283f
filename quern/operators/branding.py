"""The look of a site (PRJ-30): colours, fonts, logo, colour scheme, sizes, spacing and images, from a page's markup and styles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

from quern.operators.dom import Document, Node

# Parts of the names of colour variables by role, families that name no font, and where logos stand.
ROLES = {
    "primary": ("primary", "main", "brand"), "secondary": ("secondary", "accent-2"), "accent": ("accent", "highlight"),
    "background": ("background", "bg", "surface"), "text": ("text", "foreground", "fg"),
}
GENERIC = {"serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"}
LOGO_IMAGES = ["img.logo", "img#logo", "[class*='logo'] img", ".navbar-brand img", ".site-logo img", "[role='img'][aria-label*='logo']", "img[alt*='logo' i]"]
BUILDER_IMAGES = ["[data-section-type='header'] img", ".header-display-desktop img", ".site-title img", ".site-branding img"]
LOGO_BOXES = [".logo", "#logo", "[class*='logo']", ".navbar-brand", ".site-logo"]
#: An image in the header that is wider than this is no logo.
WIDEST = 600
MOST_FONTS = 10


def styles(doc: Document) -> str:
    return "\n".join([n.raw_text() for n in doc.find_all("style")] + [f"{n.get('style')};" for n in doc.find_all(style=True)])


def variables(css: str) -> dict[str, str]:
    """Custom properties, the first value of each."""
    out: dict[str, str] = {}
    for name, value in re.findall(r"(--[\w-]+)\s*:\s*([^;}]+)", css):
        out.setdefault(name, value.strip())
    return out


def colors(doc: Document, css: str) -> dict[str, str | None]:
    """The first colour variable of each role; a variable counts for the first role that its name speaks of."""
    out: dict[str, str | None] = dict.fromkeys(ROLES)
    for name, value in variables(css).items():
        low = name.lower()
        role = next((r for r, marks in ROLES.items() if any(m in low for m in marks)), None) if "color" in low else None
        if role and out[role] is None:
            out[role] = value
    theme = next((m.get("content") for m in doc.find_all("meta", name="theme-color") if m.get("content")), None)
    return out | {"primary": out["primary"] or theme}


def fonts(doc: Document, css: str) -> list[str]:
    """Families of the styles, then those of font links, each once."""
    named = [f.strip().strip("'\"") for said in re.findall(r"font-family\s*:\s*([^;}]+)", css) for f in said.split(",")]
    links = [n.get("href") for n in doc.find_all("link", href=True) if re.search(r"fonts\.(?:googleapis|gstatic)\.com", n.get("href"))]
    named += [unquote(m[1].replace("+", " ")) for href in links if (m := re.search(r"family=([^:&]+)", href))]
    return list(dict.fromkeys(f for f in named if f and f.lower() not in GENERIC and not f.startswith("var(")))[:MOST_FONTS]


def _source(node: Node | None) -> str | None:
    """An image's address, or that of the first image inside."""
    inner = node if node is None or node.name == "img" or node.get("src") else node.find("img")
    return inner.get("src") if inner is not None else None


def _behind(node: Node | None) -> str | None:
    m = re.search(r"""background(?:-image)?\s*:[^;]*url\(\s*["']?([^"')]+)""", (node.get("style") if node is not None else None) or "")
    return m[1].strip() if m else None


def _offers(doc: Document) -> Iterator[str | None]:
    """Addresses that may be the logo, the likeliest first."""
    first = lambda s: next(iter(doc.select(s)), None)
    for s in LOGO_IMAGES:
        yield _source(first(s))
    for link in doc.find_all("a", href="/"):  # builders without names put it into the link home
        yield _source(link.find("img"))
    for mark in ("data-framer-name", "data-framer-component-type"):
        box = next((n for n in doc.find_all() if "logo" in (n.get(mark) or "").lower()), None)
        yield _source(box.find("img") if box is not None else None)
        yield _behind(box)
    for s in BUILDER_IMAGES:
        yield _source(first(s))
    for s in LOGO_BOXES:
        yield _behind(first(s))
    header = doc.find("header")
    for image in header.find_all("img") if header is not None else []:
        wide = re.match(r"\d+", image.get("width") or "")
        if ".svg" in (image.get("src") or "").lower() or not wide or int(wide[0]) <= WIDEST:
            yield image.get("src")
    yield _property(doc, "og:image")


def _property(doc: Document, name: str) -> str | None:
    return next((m.get("content") for m in doc.find_all("meta", property=name) if m.get("content")), None)


def logo(doc: Document, base: str) -> str | None:
    found = next((u for u in _offers(doc) if u and not u.startswith("data:")), None)
    return urljoin(base, found) if found else None


def color_scheme(doc: Document, css: str) -> str:
    """What the page declares, else dark by the root's classes or dark styles, else light."""
    declared = next(((m.get("content") or "").lower() for m in doc.find_all("meta", name="color-scheme")), "")
    if "dark" in declared or "light" in declared:
        return "dark" if "dark" in declared else "light"
    named = " ".join(c.lower() for n in (doc.find("html"), doc.find("body")) if n is not None for c in n.classes)
    return "dark" if re.search("dark|night", named) or "prefers-color-scheme: dark" in css or "--dark" in css else "light"


def sizes(css: str) -> dict[str, str]:
    """Font sizes of headings and the body."""
    found = {e: re.search(rf"(?<![\w.#-]){e}\s*{{[^}}]*?font-size\s*:\s*([^;}}]+)", css, re.S) for e in ("h1", "h2", "h3", "body")}
    return {e: m[1].strip() for e, m in found.items() if m}


def spacing(css: str) -> dict[str, str]:
    out = {k: v for k, v in variables(css).items() if re.search("spacing|gap|margin", k.lower())}
    radius = re.search(r"border-radius\s*:\s*([^;}]+)", css)
    return out | ({"borderRadius": radius[1].strip()} if radius else {})


def brand_images(doc: Document, base: str) -> dict[str, str]:
    rel = lambda *names: next((n.get("href") for name in names for n in doc.find_all("link", href=True) if (n.get("rel") or "").lower() == name), None)
    found = {"favicon": rel("icon", "shortcut icon"), "ogImage": _property(doc, "og:image"), "appleTouchIcon": rel("apple-touch-icon")}
    return {k: urljoin(base, u) for k, u in found.items() if u}


def branding(doc: Document, base: str) -> dict:
    css = styles(doc)
    return {
        "color_scheme": color_scheme(doc, css), "logo": logo(doc, base), "colors": colors(doc, css), "fonts": fonts(doc, css),
        "typography": {"font_sizes": sizes(css)}, "spacing": spacing(css), "images": brand_images(doc, base),
    }
