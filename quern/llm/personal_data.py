"""Operator 8: personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap.  Five kinds are settled by
their format: the base kinds (email, ip, card, phone) and private-key blocks; they always
stay.  The others (bank account, birth date, hardware address, IPv6 address, passport
number, payment number that the base format misses, phone without a country code, secret,
social security number) are proposed broadly and judged by boosted trees, one model a
kind, on features of the span's format and of the text around it; each kind's threshold
is calibrated on held-out examples so that at least ``PRECISION`` of what it accepts there
is right.  Of overlapping accepted spans the one with the highest probability stays;
nothing displaces a base span.  Names and postal addresses are not looked for.

The trees are fitted on the driver from a fixed number of generated examples
(``EXAMPLES`` a kind): spans of many forms in leads that speak for them, in leads that
speak against them, and, for ``NEUTRAL`` of either class, in leads that say nothing, so
that neither format nor lead alone decides.  A model does not depend on the corpus or its
size.

Every generator is linear in the text, and a secret is taken to its end, however long; behind
a word like password at least six characters are one.  Defined results: null text has no spans
and stays null when redacted; other columns pass through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.boosting import Boosted

BASE = ("email", "ip", "card", "phone")
SETTLED = (*BASE, "keyblock")
LEARNED = ("birth", "iban", "ipv6", "localphone", "mac", "pan", "passport", "secret", "ssn")
EXAMPLES, PRECISION, AROUND, NEUTRAL = 1800, 0.97, 36, 0.3

# Formats of the base kinds.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Broad formats of the learned kinds, and words that stand near them.
_MONTH = r"(?:jan|feb|mar|m[aä]r|apr|ma[iy]|jun|jul|aug|sep|o[ck]t|nov|de[cz]|ene|abr|ago|dic|janv|f[eé]v|avr|juin|juil|ao[uû]t|d[eé]c)[a-zéäû]{0,7}\.?"
_BROAD = {
    "birth": re.compile(rf"(?<![0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}\.?\x20(?:de\x20)?{_MONTH}\x20(?:de\x20)?(?:19|20)[0-9]{{2}}|{_MONTH}\x20[0-9]{{1,2}},\x20(?:19|20)[0-9]{{2}})(?![0-9/-])", re.I),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    "localphone": re.compile(r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z]|[.,/-][0-9])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    "pan": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4,6}[\x20-][0-9]{4,5}(?:[\x20-][0-9]{1,7})?)(?![0-9])"),
    "passport": re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z]{1,2}[0-9]{6,8}[A-Z]?|[CFGHJK][0-9A-Z]{8}|[0-9]{9})(?![A-Za-z0-9-])"),
    "secret": re.compile(r"[A-Za-z0-9+/_-]{12,}+"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])"),
}
#: Beginnings of well-known tokens, and words that a secret is given after.
_PREFIX = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xox", "eyJ", "AIza", "npm_")
_GIVEN = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
_ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credentials?)[\"']?\s{0,2}(?::|=>?|is|ist|est|es)\s{0,2}[\"']?([^\s\"',;<>]{6,}+)", re.I)
_KEYLINE = re.compile(r"-----(BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----")
_KEYBODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*+")
_NEAR = (
    re.compile(r"pass(?!port)|pwd|secret|token|key|auth|credential|bearer", re.I),
    re.compile(r"tel|phone|call|mobile|fax|cell|anruf|ruf|appel|llam|móvil|whatsapp|reach", re.I),
    re.compile(r"ssn|social|security|soc\.", re.I),
    re.compile(r"iban|account|bank|konto|compte|cuenta|transfer|überweis", re.I),
    re.compile(r"mac|ether|device|hw|wifi|adapter|interface", re.I),
    re.compile(r"card|visa|amex|payment|credit|debit|karte|carte|tarjeta|paid", re.I),
    re.compile(r"born|birth|dob|geb|né|nac", re.I),
    re.compile(r"passport|reisepass|passeport|pasaporte|travel doc", re.I),
    re.compile(r"\bip\b|ipv6|addr|host|server|client|peer", re.I),
    re.compile(r"version|isbn|date|order|part|\bid\b|commit|sha|hash|md5|uuid|build|invoice|figure|table|page|serial|sku|ref", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the learned kinds' generators propose; they may overlap."""
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        found += [(kind, *m.span()) for kind in ("birth", "pan", "passport", "ssn") for m in _BROAD[kind].finditer(text)]
        found += [("localphone", *m.span()) for m in _BROAD["localphone"].finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 12]
        for m in _BROAD["iban"].finditer(text):  # words in capitals may follow, so every length is proposed
            ends = [k for k in range(15, len(m[0]) + 1) if k == len(m[0]) or m[0][k] == " "]
            found += [("iban", m.start(), m.start() + k) for k in ends]
    if ":" in text or "-" in text:
        found += [("mac", *m.span()) for m in _BROAD["mac"].finditer(text)]
    if "::" in text or text.count(":") >= 7:
        found += [("ipv6", *m.span()) for m in _BROAD["ipv6"].finditer(text) if _is_ipv6(m[0])]
    proposed = {m.span() for m in _BROAD["secret"].finditer(text) if _DIGIT.search(m[0]) or m[0].startswith(_PREFIX)}
    low = text.lower()
    if any(w in low for w in _GIVEN):
        proposed |= {(m.start(1), m.start(1) + len(m[1].rstrip(".!?)]}"))) for m in _ASSIGNED.finditer(text)}
    return found + [("secret", a, b) for a, b in sorted(proposed) if b > a]


def key_blocks(text: str) -> list[tuple[str, int, int]]:
    """From each line that begins a key to the next such line's end, if that ends a key and only a key's characters stand between."""
    found, begun = [], None
    for m in _KEYLINE.finditer(text) if "PRIVATE KEY-----" in text else ():
        if m[1] == "END" and begun and _KEYBODY.match(text, begun.end(), m.start()).end() == m.start():
            found.append(("keyblock", begun.start(), m.end()))
        begun = m if m[1] == "BEGIN" else None
    return found


def _is_ipv6(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 4]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    upper = sum(c.isupper() for c in span)
    lower = sum(c.islower() for c in span)
    hexa = sum(c in string.hexdigits for c in span)
    counts = np.unique(list(span), return_counts=True)[1] / n
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    last = before.rstrip(" \"'")[-1:]
    groups = [len(g) for g in re.split(r"[^A-Za-z0-9]+", span) if g]
    named = re.findall(r"[A-Za-z]{3,}", span)
    return [
        n, digits, upper, lower, n - digits - upper - lower, digits / n, hexa / n, float(-(counts * np.log2(counts)).sum()), turns,
        float(span.startswith(_PREFIX)), float(last == "="), float(last == ":"), float(before[-1:] in "\"'" and before != ""),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(_mod97(span) if 15 <= n <= 45 else 0), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(13 <= digits <= 19 and luhn("".join(c for c in span if c.isdigit()))), float(span[:3] in ("000", "666") or span[:1] == "9"), float(span[:1] in "01"),
        float(span[:1] == "0"), float(span[:1] == "("), float("." in span), float("-" in span), float(" " in span), float("/" in span), max(map(len, named), default=0), float(_dated(span)),
        *(float(bool(p.search(before))) for p in _NEAR),
    ]


def _dated(span: str) -> bool:
    """Whether a span of digit groups begins with a day, or holds a year at either end."""
    groups = re.findall(r"[0-9]+", span)
    return bool(groups) and any(len(g) == 4 and g[:2] in ("19", "20") for g in (groups[0], groups[-1]))


# Words for generated examples, and leads that say nothing.
_WORDS = "the of invoice shipped on total amount report see page chapter and build release number order about for with from room price table figure item list der und mit la de el les en".split()
_PLAIN = ("", "is ", "was ", "of ", "and ", "to ", "with ", ": ", "the ", "(", "here: ", "at ", "it reads ", "- ")
# Leads that speak for a kind, and leads that speak against it.
_LEADS = {
    "birth": (("born ", "born on ", "date of birth: ", "DOB ", "dob: ", "geboren am ", "née le ", "nacido el ", "birthday ", "birth date "), ("on ", "date ", "due ", "published ", "updated ", "since ", "until ", "version of ", "meeting ", "shipped ")),
    "iban": (("IBAN ", "account: ", "bank ", "Konto ", "transfer to ", "compte ", "cuenta "), ("part ", "order ", "serial ", "code ", "ref ", "licence ")),
    "ipv6": (("ip ", "address ", "host ", "from ", "client ", "peer ", "server at "), ("in ", "time ", "namespace ", "ratio ", "at ", "call ")),
    "localphone": (("call ", "phone: ", "tel ", "Tel.: ", "mobile ", "fax ", "reach me at ", "Telefon ", "appelez le ", "llame al "), ("order ", "part ", "isbn ", "figures ", "version ", "between ", "scores ", "pages ", "rows ", "sizes ", "on ", "dated ", "from ")),
    "mac": (("mac ", "device ", "ether ", "adapter ", "wifi ", "hw "), ("date ", "id ", "build ", "between ", "uuid ", "codes ")),
    "pan": (("card ", "visa ", "payment ", "Karte ", "credit card ", "carte ", "paid with "), ("order ", "id ", "number ", "tracking ", "sku ", "ref ", "serial ")),
    "passport": (("passport ", "passport no. ", "Passport number: ", "Reisepass ", "passeport ", "pasaporte "), ("part ", "order ", "sku ", "serial ", "model ", "build ", "invoice ", "ref ", "commit ")),
    "secret": (('password="', "password=", "token: ", 'token = "', "secret=", "api_key: ", "apikey=", "auth token ", "Passwort: ", "the password is ", "pwd: ", "key="), ("see ", "commit ", "sha ", "md5 ", "uuid ", "the ", "file ", "on ", "number ", "order ", "path ", "at ")),
    "ssn": (("ssn ", "SSN: ", "social security number ", "ssn is ", "soc. sec. no. "), ("part ", "order ", "id ", "invoice ", "sku ", "ref ", "figures ")),
}


def _iban(rng, valid: bool) -> str:
    body = "".join(rng.choice(list(string.digits), 18))
    country = str(rng.choice(["DE", "FR", "ES", "GB", "NL"]))
    check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
    out = f"{country}{(check if valid else (check + 1 + int(rng.integers(90))) % 100):02d}{body}"
    return " ".join(out[k : k + 4] for k in range(0, len(out), 4)) if rng.random() < 0.5 else out


def _draw(rng, alphabet: str, n: int) -> str:
    return "".join(rng.choice(list(alphabet), n))


def _span(kind: str, good: bool, rng) -> str:
    """A span of a kind, or one that only looks like it."""
    d = lambda n: _draw(rng, string.digits, n)
    pick = lambda *x: str(rng.choice(x))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    if kind == "birth":
        year = str(int(rng.integers(1930, 2012) if good else rng.integers(1990, 2031)))
        day, month = int(rng.integers(1, 29)), int(rng.integers(1, 13))
        named = pick("Jan", "March", "July", "Okt.", "août", "mayo", "December")
        return pick(f"{day:02d}/{month:02d}/{year}", f"{day}.{month}.{year}", f"{year}-{month:02d}-{day:02d}", f"{day} {named} {year}", f"{named} {day}, {year}")
    if kind == "iban":
        return _iban(rng, good)
    if kind == "ipv6":
        if good:
            return pick("2001:db8:", "fe80::", "2a02:") + ":".join(_draw(rng, hexa, int(rng.integers(1, 5))) for _ in range(int(rng.integers(2, 4)))) + pick("::1", "::" + _draw(rng, hexa, 4))
        return pick("a::b", "::", "dead::", "c::" + _draw(rng, "abcdef", 2), "ab::cd", f"1::{d(1)}")
    if kind == "localphone":
        area = pick("2", "3", "4", "5", "6", "7", "8", "9") + d(2)
        if good:
            two = " ".join(d(2) for _ in range(4))
            return pick(f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"0{pick('1', '2', '3', '6', '9')} {two}", f"020 {d(4)} {d(4)}", f"0{d(3)} {d(6)[:5]}", f"0{d(3)}/{d(5)}", f"0{d(2)}-{d(3)} {d(2)} {d(2)}", f"9{d(2)} {d(3)} {d(3)}", f"{area} {d(3)} {d(4)}")
        year = f"20{d(2)}"
        return pick(f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{year}-0{pick('1', '5')}-1{d(1)}", f"{year}/1{pick('0', '2')}/2{d(1)} 1{d(1)}", f"978-{pick('0', '3')}{d(1)}-{d(5)}-{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(2)}-{d(2)}-{d(4)}", f"{d(2)}.{d(2)}.{year}", f"{year}-{year}", f"{d(5)}-{d(4)}")
    if kind == "mac":
        sep = pick(":", "-")
        if good:
            return sep.join(_draw(rng, hexa if rng.random() < 0.6 else hexa.upper(), 2) for _ in range(6))
        return pick("-", ":").join(d(2) for _ in range(6))
    if kind == "pan":
        digits = pick("4", "5", "37", "6011") + d(12)
        digits += next(c for c in string.digits if luhn(digits + c))
        if not good:
            digits = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(9))) % 10)
        return " ".join(digits[k : k + 4] for k in range(0, len(digits), 4)) if len(digits) == 16 and rng.random() < 0.3 else digits
    if kind == "passport":
        letters = _draw(rng, string.ascii_uppercase, int(rng.integers(1, 3)))
        return pick(letters + d(int(rng.integers(6, 9))), "C" + _draw(rng, string.ascii_uppercase[:6] + string.digits, 8), d(9))
    if kind == "ssn":
        return f"{int(rng.integers(1, 665)):03d}-{d(2)}-{d(4)}" if good else pick("{}-{}-{}", "{} {} {}").format(pick("9", "000", "666", "3")[:1] + d(2), d(2), d(4))
    if good:
        word = "".join(rng.choice(["correct", "horse", "battery", "staple", "sun", "flower", "dragon", "monkey", "letme", "admin", "secret", "winter"], int(rng.integers(2, 4))))
        value = _draw(rng, pick(hexa, alnum, alnum + "!#$%&*+_-"), int(rng.integers(10, 41)))
        return pick(value, value, "AKIA" + _draw(rng, string.ascii_uppercase + string.digits, 16), "ghp_" + _draw(rng, string.ascii_letters, 36), "sk-" + _draw(rng, alnum, 32), word, word.capitalize() + pick("!", "#") + d(2))
    words = "-".join(rng.choice(_WORDS, 3))
    return pick(f"{words}-{d(int(rng.integers(1, 5)))}", d(int(rng.integers(12, 22))), f"20{d(2)}-{d(2)}-{d(2)}" + pick("-report", "/page1", "_final"), _draw(rng, hexa, int(rng.choice([32, 40]))), f"src/{words}/v{d(1)}", "required", "invalid", "patience", "".join(rng.choice(_WORDS, 4)) + d(1))


def _example(kind: str, rng) -> tuple[str, str, bool]:
    """(words before, span, whether it is personal).

    With a lead for the kind and a span of its form it is; with a lead against it, or a span that only looks like it, not.
    Without a lead the form decides where it can (check digits, well-known beginnings), else nothing personal is there.
    """
    good = bool(rng.random() < 0.5)
    speaks, denies = _LEADS[kind]
    form = good or rng.random() < 0.35
    span = _span(kind, form, rng)
    if rng.random() < NEUTRAL:
        telling = kind in ("iban", "mac", "ipv6", "pan") or (kind == "secret" and span.startswith(_PREFIX)) or (kind == "localphone" and span.startswith("("))
        return str(rng.choice(_PLAIN)), span, form and telling
    if kind == "secret" and span in ("required", "invalid", "patience"):
        return str(rng.choice(["password ", "the secret: ", "token is ", "password: "])), span, False
    near = not form and kind in ("iban", "ipv6", "localphone", "pan") and rng.random() < 0.5  # what only looks like it, behind a lead that speaks for it
    return str(rng.choice(speaks if good or near else denies)), span, good and form


@lru_cache(maxsize=2)
def fitted(seed: int = 5) -> dict[str, tuple[Boosted, float]]:
    """A model and a threshold for each learned kind."""
    out = {}
    for kind in LEARNED:
        rng = np.random.default_rng([seed, LEARNED.index(kind)])
        x, y = [], []
        while len(y) < EXAMPLES:
            lead, span, good = _example(kind, rng)
            head = " ".join(rng.choice(_WORDS, 4)) + " " + lead
            tail = str(rng.choice(['"', " ", ". ", "\n", ", ", ")"])) + " ".join(rng.choice(_WORDS, 3))
            x.append(features(head + span + tail, len(head), len(head) + len(span)))
            y.append(good)
        x, y = np.array(x), np.array(y, float)
        cut = EXAMPLES * 2 // 3
        model = Boosted().fit(x[:cut], y[:cut])
        p, truth = model.predict(x[cut:]), y[cut:]
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(precision >= PRECISION)
        out[kind] = (model, max(0.5, float(p[order][ok[-1]])) if len(ok) else 1.1)
    return out


def spans(text: str | None, models: dict[str, tuple[Boosted, float]]) -> tuple[list, list]:
    """(base spans, all spans), each (kind, start, end)."""
    if not text:
        return [], []
    base = base_spans(text)
    proposed, blocks = candidates(text), key_blocks(text)
    if not proposed and not blocks:
        return base, base
    judged = [(-2.0, s, e, kind) for kind, s, e in blocks]
    x = np.array([features(text, s, e) for _, s, e in proposed])
    kinds = np.array([k for k, _, _ in proposed])
    for kind in set(kinds.tolist()):
        rows = np.flatnonzero(kinds == kind)
        model, least = models[kind]
        judged += [(-p, s, e, kind) for p, (_, s, e) in zip(model.predict(x[rows]), (proposed[r] for r in rows), strict=True) if p >= least]
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1:]):  # disjoint, so that one neighbour on each side decides
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    extra = []
    for _, s, e, kind in sorted(judged):
        at = bisect_left(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
            taken.insert(at, (s, e))
            extra.append((kind, s, e))
    return base, base + sorted(extra)


def redacted(text: str | None, models) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its kind in brackets."""
    found = sorted((s, e, k) for k, s, e in spans(text, models)[1])
    if not found:
        return text
    out, end = [], 0
    for s, e, kind in found:
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): n_spans counts all."""
    models = fitted()

    def said(found) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in found)

    def run(batches):
        for batch in batches:
            rows = [spans(t.as_py(), models) for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in BASE]
            digest = pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([said(x) for _, x in rows], pa.string()), pa.array([len(x) for _, x in rows], pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars`` follows, all else stays."""
    models = fitted()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [redacted(t.as_py(), models) for t in batch.column(at)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            k = batch.schema.get_field_index("n_chars")
            if k >= 0:
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type))
            yield batch

    return documents.mapInArrow(run, documents.schema)
