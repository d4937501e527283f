"""URL functions on columns: built-in expressions only (URL-*, PRD-25..28, PRD-31)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, apart from utm_*.
TRACKING = ["_ga", "_gl", "fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "share"]
# The shorter list that cache keys use; utm_* are named one by one.
CACHE_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "ref", "source"]


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)(#.*)$", 1)


def _before_query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host in lower case, without user and port; empty without one."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def registrable_domain(url: Column) -> Column:
    """Host without one leading ``www.``; null without a host."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def origin(url: Column) -> Column:
    return F.when(authority(url) != "", F.concat(scheme(url), F.lit("://"), F.lower(authority(url))))


def params(url: Column) -> Column:
    """Array of (key, value) of the query, decoded; blank values are kept, empty parts are not."""
    decoded = lambda x: F.try_url_decode(x)
    parts = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.coalesce(decoded(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1)).alias("key"), F.coalesce(decoded(F.regexp_extract(x, r"(?s)=(.*)$", 1)), F.regexp_extract(x, r"(?s)=(.*)$", 1)).alias("value")))


def _quoted(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["key"]), F.lit("="), _quoted(p["value"]))), "&")


def _with_query(url: Column, text: Column, tail: Column) -> Column:
    return F.concat(_before_query(url), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")), tail)


def _is_tracking(key: Column) -> Column:
    return F.lower(key).startswith("utm_") | F.lower(key).isin(TRACKING)


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; order and fragment stay; without a query it is unchanged."""
    kept = F.filter(params(url), lambda p: ~_is_tracking(p["key"]))
    return F.when(query(url) == "", url).otherwise(_with_query(url, _joined(kept), fragment(url)))


def normalise(url: Column, canonical: Column | None = None) -> Column:
    """Without fragment and tracking parameters; a (resolved) canonical address wins."""
    cleaned = strip_tracking(strip_fragment(url))
    if canonical is None:
        return cleaned
    return F.coalesce(strip_tracking(strip_fragment(F.nullif(canonical, F.lit("")))), cleaned)


def dedupe_key(url: Column) -> Column:
    """Without fragment and tracking parameters, parameters sorted; host case and trailing slash stay."""
    kept = F.array_sort(F.filter(params(url), lambda p: ~_is_tracking(p["key"])))
    return _with_query(url, _joined(kept), F.lit(""))


def cache_address(url: Column) -> Column:
    """The address behind a cache key: own tracking list, no trailing slash, equal keys side by side."""
    kept = F.filter(params(url), lambda p: ~F.lower(p["key"]).isin(CACHE_TRACKING))
    names = F.array_distinct(F.transform(kept, lambda p: p["key"]))
    grouped = F.flatten(F.transform(names, lambda k: F.filter(kept, lambda p: p["key"] == k)))
    trimmed = F.regexp_replace(path(url), r"/+$", "")
    head = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(F.lit("")), F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(F.lit("")))
    text = _joined(grouped)
    return F.concat(head, F.when(trimmed == "", F.lit("/")).otherwise(trimmed), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))


def cache_key(url: Column, variant: Column | None = None) -> Column:
    """First 16 hex digits of the address's SHA-256, with the variant after a bar."""
    basis = cache_address(url)
    if variant is not None:
        basis = F.when(F.coalesce(variant, F.lit("")) != "", F.concat(basis, F.lit("|"), variant)).otherwise(basis)
    return F.substring(F.sha2(basis, 256), 1, 16)


def crawl_slug(url: Column) -> Column:
    """File name of a crawled page: its path with slashes as underscores, ``index`` for the root."""
    trimmed = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.coalesce(F.nullif(F.translate(trimmed, "/", "_"), F.lit("")), F.lit("index"))


def batch_slug(url: Column) -> Column:
    """File name of a batch result: host and path with slashes as underscores, ``index`` for nothing."""
    trimmed = F.regexp_replace(F.concat(authority(url), path(url)), r"^/+|/+$", "")
    return F.coalesce(F.nullif(F.translate(trimmed, "/", "_"), F.lit("")), F.lit("index"))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 8)


def matches_any(url: Column, patterns: list[str]) -> Column:
    """Whether any of the regular expressions is found in the URL."""
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(p)
    return out


def same_domain(url: Column, base: Column, subdomains: bool = False) -> Column:
    h = F.lower(authority(url))
    same = h == F.lower(base)
    return same | h.endswith(F.concat(F.lit("."), F.lower(base))) if subdomains else same


def valid(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^(?i)https?://[^/\s?#]+[^\s]*$"), F.lit(False))


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


# Extensions of addresses that are no PDF.
NOT_PDF = "html htm php asp aspx jsp cgi shtml xhtml cfm pl py rb js css xml json rss atom svg txt png jpg jpeg gif webp ico bmp mp3 mp4 webm ogg wav avi mov zip tar gz bz2 rar 7z".split()


def needs_type_check(url: Column) -> Column:
    """Whether only a request can tell if the address is a PDF: neither .pdf nor an extension of something else."""
    extension = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    return ~is_pdf(url) & ~extension.isin(NOT_PDF)


def is_pdf_body(body: Column) -> Column:
    """Whether the PDF mark stands in the first 1024 bytes."""
    return F.locate("%PDF-", F.decode(F.substring(body, 1, 1024), "ISO-8859-1")) > 0


def site_query(text: Column, include: Column, exclude: Column) -> Column:
    """A search query with site operators for arrays of domains."""
    wanted = F.array_join(F.transform(F.coalesce(include, F.array().cast("array<string>")), lambda d: F.concat(F.lit("site:"), d)), " OR ")
    unwanted = F.array_join(F.transform(F.coalesce(exclude, F.array().cast("array<string>")), lambda d: F.concat(F.lit("-site:"), d)), " ")
    several = F.when(F.size(include) > 1, F.concat(F.lit("("), wanted, F.lit(")"))).otherwise(wanted)
    return F.concat_ws(" ", text, F.nullif(several, F.lit("")), F.nullif(unwanted, F.lit("")))


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    parts = F.split(address, r"\.")
    ok = address.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a * 256 + b)
    return F.when(ok & F.forall(parts, lambda p: p.try_cast("int") <= 255), number)


# Networks that no request may reach (first, last).
BLOCKED_NETS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def is_blocked_ipv4(address: Column, networks: list[tuple[str, int]] = BLOCKED_NETS) -> Column:
    """Whether an address lies in one of the networks (first address, bits)."""
    number = ipv4_number(address)
    out = F.lit(False)
    for net, bits in networks:
        low = sum(int(p) << (24 - 8 * k) for k, p in enumerate(net.split(".")))
        out = out | number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(out, F.lit(False))


# Networks that are refused at any time, and those that a strict caller refuses too.
LINK_LOCAL = ["169.254.0.0/16", "fe80::/10"]
PRIVATE = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "224.0.0.0/4",
    "::1/128", "::/128", "fc00::/7", "ff00::/8",
]
#: IPv6 networks whose addresses end in the IPv4 address that is reached: translated and compatible ones.
_EMBEDDING = ["64:ff9b::/96", "::/96"]


def blocked(host: str | None, strict: bool = False) -> bool:
    """Whether an address, or the IPv4 address inside an IPv6 one, is in a refused network; names are not looked up."""
    import ipaddress

    try:
        address = ipaddress.ip_address(host or "")
    except ValueError:
        return False
    reached = [address]
    if address.version == 6:
        low = ipaddress.IPv4Address(int(address) & 0xFFFFFFFF)
        held = any(address in ipaddress.ip_network(n) for n in _EMBEDDING) and int(address) > 1
        reached += [x for x in (address.ipv4_mapped, address.sixtofour, low if held else None) if x is not None]
    networks = [ipaddress.ip_network(n) for n in LINK_LOCAL + PRIVATE * strict]
    return any(a in n for a in reached for n in networks if a.version == n.version)


def bare_host(url: Column) -> Column:
    """The host without brackets, user and port, in lower case."""
    place = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(place, r"^\[([^\]]*)\]", 1), F.lit("")), F.regexp_replace(place, r":\d*$", "")))


def refusal(url: Column, strict: bool = False) -> Column:
    """Why a request may not be sent, null if it may: characters that parsers read differently, scheme, host, network.

    Hosts with a colon are IPv6 addresses, which a batch function judges; all else is plain expressions.
    """
    @F.arrow_udf("boolean")
    def refused(hosts: pa.Array) -> pa.Array:
        return pa.array([blocked(h, strict) for h in hosts.to_pylist()], pa.bool_())

    name = bare_host(url)
    v4 = F.coalesce(_in_networks(name, [n for n in LINK_LOCAL + PRIVATE * strict if ":" not in n]), F.lit(False))
    return (
        F.when(url.rlike(r"[\\\x00-\x1F\x7F]"), "character")
        .when(~F.coalesce(scheme(url).isin("http", "https"), F.lit(False)), "scheme")
        .when(name.rlike(r"[^\x00-\x7F]"), "host")
        .when(v4 | refused(F.when(F.contains(name, F.lit(":")), name)), "network")
    )


def _in_networks(address: Column, networks: list[str]) -> Column:
    number, out = ipv4_number(address), F.lit(False)
    for network in networks:
        net, bits = network.split("/")
        low = sum(int(p) << (24 - 8 * k) for k, p in enumerate(net.split(".")))
        out = out | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return out


def percent_encoded(url: Column) -> Column:
    """Characters beyond ASCII as percent signs and the bytes of their UTF-8."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(r"[^\x00-\x7F]"), F.array_join(coded, "")).otherwise(url)


def scoped_headers(url: Column, base: Column, headers: Column) -> Column:
    """Headers for a request: a caller's own go to the origin that they were given for only."""
    return F.when(origin(url) == origin(base), headers).otherwise(F.map_filter(headers, lambda k, _: F.lower(k).isin("user-agent", "accept", "accept-language")))
