"""Checks of what a caller passes (PRD-38): each raises ``Invalid`` with the field's name, or returns the value to use.

Where a value may be absent, None stays None or becomes the default.  Steps alone are
never refused: what is no number is the default, and numbers are brought into range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any
from urllib.parse import urlparse

from quern.functions import urls as addresses

# Formats and sources that can be asked for.
FORMATS = ("markdown", "html", "rawHtml", "screenshot", "links")
SOURCES = ("web", "images", "news")


class Invalid(ValueError):
    def __init__(self, field: str, value: Any, why: str):
        super().__init__(f"{field}: {why}")
        self.field, self.value = field, value


def _need(ok: bool, field: str, value: Any, why: str) -> None:
    if not ok:
        raise Invalid(field, value, why)


def text(value: Any, field: str, least: int = 1, most: int = 10_000) -> str:
    """A text without space at its ends, within lengths."""
    _need(isinstance(value, str), field, value, "a text is needed")
    said = value.strip()
    _need(least <= len(said) <= most, field, value, f"{least} to {most} characters are needed")
    return said


def url(value: Any, field: str = "url", optional: bool = False, strict: bool = False) -> str | None:
    """A web address that no parser can read differently and whose host is no refused address; names are not looked up."""
    if optional and (value is None or (isinstance(value, str) and not value.strip())):
        return None
    _need(isinstance(value, str) and bool(value.strip()), field, value, "an address is needed")
    said = value.strip()
    _need(said.startswith(("http://", "https://")), field, value, "http:// or https:// is needed")
    _need(not re.search(r"[\\\x00-\x1F\x7F]", said), field, value, "it holds a backslash or a control character")
    try:
        place = urlparse(said)
        host = place.hostname or ""
    except ValueError:
        raise Invalid(field, value, "it cannot be taken apart") from None
    _need(bool(place.netloc), field, value, "a host is needed")
    _need(host.isascii(), field, value, "write the host in ASCII")
    _need(not addresses.blocked(host, strict), field, value, "the host is in a refused network")
    return said


def urls(value: Any, field: str = "urls", most: int = 100) -> list[str]:
    """A list of addresses, in order: a list, a JSON text of one, or one address."""
    if isinstance(value, str):
        said = value.strip()
        value = [said]
        if said.startswith("["):
            try:
                found = json.loads(said)
            except ValueError:
                found = None
            value = found if isinstance(found, list) else [said]
    _need(isinstance(value, list) and 0 < len(value) <= most, field, value, f"a list of 1 to {most} addresses is needed")
    return [url(x, f"{field}[{k}]") for k, x in enumerate(value)]


def query(value: Any, field: str = "query", most: int = 1000) -> str:
    return text(value, field, most=most)


def prompt(value: Any, field: str = "prompt", optional: bool = False) -> str | None:
    return None if optional and value is None else text(value, field, 10, 10_000)


def timeout(value: Any, field: str = "timeout", least: int = 1_000, most: int = 300_000) -> int | None:
    """Milliseconds; parts of one are cut off."""
    if value is None:
        return None
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        raise Invalid(field, value, "a whole number is needed") from None
    _need(least <= number <= most, field, value, f"{least} to {most} is allowed")
    return number


def limit(value: Any, field: str = "limit", most: int = 100, default: int | None = None) -> int | None:
    """How many, at least 1: a whole number or a text of one; true and false are none."""
    if value is None:
        return default
    if isinstance(value, str) and re.fullmatch(r"\s*\+?\d+\s*", value):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    _need(isinstance(value, int) and not isinstance(value, bool), field, value, "a whole number is needed")
    _need(1 <= value <= most, field, value, f"1 to {most} is allowed")
    return value


def steps(value: Any, least: int = 1, most: int = 20, default: int = 10) -> int:
    try:
        return max(least, min(int(value), most))
    except (TypeError, ValueError, OverflowError):
        return default


def choices(value: Any, field: str, known: Iterable[str]) -> list[str] | None:
    """Known names, in order and as often as they are said; None stays None."""
    if value is None:
        return None
    known = list(known)
    _need(isinstance(value, list), field, value, "a list is needed")
    for x in value:
        _need(x in known, field, value, f"{x!r} is none of {', '.join(known)}")
    return list(value)


def formats(value: Any, field: str = "formats", known: Iterable[str] = FORMATS) -> list[str] | None:
    return choices(value, field, known)


def sources(value: Any, field: str = "sources") -> list[str] | None:
    return choices(value, field, SOURCES)


def json_object(value: Any, field: str) -> dict | None:
    """An object, or a JSON text of one."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            raise Invalid(field, value, "it is no JSON") from None
    _need(value is None or isinstance(value, dict), field, value, "an object is needed")
    return value
