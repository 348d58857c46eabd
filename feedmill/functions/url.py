"""Addresses: canonical form, official domain, resolution against a base, images.

Common addresses are handled by built-in expressions.  An address with user data, an international or odd host, percent codes,
dot segments, a backslash or another scheme goes through one vectorised Python function instead.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import bind, trim

# Parameters that track a visit and never change what an address names.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "source"]

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
SIMPLE = r"^(?i:https?)://[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z][A-Za-z0-9-]*(:[0-9]{1,4})?(/[A-Za-z0-9_~!$&*+,;=:@()-]+(\.[A-Za-z0-9_~!$&*+,;=:@()-]+)*)*/?(\?[A-Za-z0-9_*.=&-]*)?(#.*)?$"


def _parsed(text: str):
    """(scheme, host, port, path, query) of an absolute address, or None if there is none."""
    text = re.sub(r"[\t\n\r]", "", text.strip())
    try:
        u = urlsplit(text.replace("\\", "/") if re.match(r"(?i)(https?|ftp|wss?):", text) else text)
        scheme = u.scheme.lower()
        if not scheme:
            return None
        if scheme not in DEFAULT_PORTS:
            return scheme, u.netloc, None, u.path, u.query
        host = unquote(u.hostname or "")
        if not host:
            return None
        host = host.lower() if host.isascii() else host.lower().encode("idna").decode("ascii")
        if re.search(r"[\s<>^|%#\\/?@\[\]]", host.strip("[]")):
            return None
        port = u.port
        return scheme, (f"[{host}]" if ":" in host else host), None if port == DEFAULT_PORTS[scheme] else port, u.path, u.query
    except (ValueError, UnicodeError):
        return None


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:] if path.startswith("/") else path.split("/")
    for i, p in enumerate(parts):
        plain = p.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def canonicalize(text: str | None) -> str | None:
    """The canonical form of an address: lower-case scheme and host, no fragment, default port or tracking parameters, the other
    parameters sorted by name, no slash at the end but for the root.  What can't be read comes back trimmed; null stays null."""
    if text is None:
        return None
    parsed = _parsed(text)
    if parsed is None:
        return text.strip()
    scheme, host, port, path, query = parsed
    pairs = sorted(((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k not in TRACKING), key=lambda p: p[0])
    search = "&".join(quote_plus(k, safe="*-._").replace("~", "%7E") + "=" + quote_plus(v, safe="*-._").replace("~", "%7E") for k, v in pairs)
    if scheme in DEFAULT_PORTS:
        path = quote(_without_dots(path or "/"), safe="/%:@!$&'()*+,;=~-._|[]^")
        out = f"{scheme}://{host}{f':{port}' if port is not None else ''}{path}"
    else:
        out = f"{scheme}:{'//' + host if host else ''}{path}"
    out += f"?{search}" if search else ""
    return out[:-1] if path != "/" and out.endswith("/") else out


def _canonical_series(urls: pd.Series) -> pd.Series:
    return urls.map(canonicalize, na_action="ignore")


def _vectorised(f, *columns: Column) -> Column:
    """Applied where a plan is made, so that importing this module on a worker needs no session."""
    return F.pandas_udf(f, "string")(*columns)


def _canonical_simple(u: Column) -> Column:
    part = lambda p: F.regexp_extract(u, r"^([A-Za-z]+)://([^/:?#]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?", p)
    head = F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), F.regexp_replace(part(3), "^0+(?=.)", "").alias("port"), part(4).alias("path"), part(5).alias("query"))

    def search(query: Column) -> Column:
        """The parameters that are kept, as (name, position, name=value), sorted; put together again."""
        named = lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x"))
        pairs = F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), named), lambda p: ~p["k"].isin(TRACKING))
        value = lambda p: F.replace(F.substring(p["x"], F.length(p["k"]) + 2, F.length(p["x"])), F.lit("="), F.lit("%3D"))
        return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), value(p))), "&")

    def joined(h: Column) -> Column:
        usual = (h["port"] == "") | ((h["scheme"] == "https") & (h["port"] == "443")) | ((h["scheme"] == "http") & (h["port"] == "80"))
        base = F.concat(h["scheme"], F.lit("://"), h["host"], F.when(usual, "").otherwise(F.concat(F.lit(":"), h["port"])), F.when(h["path"] == "", "/").otherwise(h["path"]))
        bare = F.when(h["path"].isin("", "/"), base).otherwise(F.regexp_replace(base, "/$", ""))
        return bind(search(h["query"]), lambda q: F.when(q == "", bare).otherwise(F.regexp_replace(F.concat(base, F.lit("?"), q), "/$", "")))

    return bind(head, joined)


def canonical_url(c: Column) -> Column:
    """``canonicalize`` as a column; the Python function sees null in place of the addresses that built-in expressions handle."""
    simple = trim(c).rlike(SIMPLE)
    odd = _vectorised(_canonical_series, F.when(~simple, c))
    return F.coalesce(odd, bind(trim(c), _canonical_simple))


def host_of(c: Column) -> Column:
    """The lower-case host of an absolute http(s) address; null for anything else."""
    host = F.regexp_extract(trim(c), r"^(?i:https?)://(?:[^/?#@]*@)?([^/:?#@\s]+)(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def normalize_host(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\.$", ""), r"^www\.", "")


def on_official_domain(url: Column, domain: Column) -> Column:
    """The address lies on the domain or below it; false for what can't be read, for nulls and an empty domain."""
    h, d = normalize_host(host_of(url)), normalize_host(domain)
    return F.coalesce((d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d))), F.lit(False))


def resolve(href: str | None, base: str | None) -> str | None:
    """An absolute address for a link found on a page; null where the base or the result isn't one."""
    if href is None:
        return None
    try:
        out = urljoin(base or "", re.sub(r"[\t\n\r]", "", href.strip()))
        if _parsed(out) is None or (base is not None and not urlsplit(href).scheme and _parsed(base) is None):
            return None
        scheme, host, port, path, query = _parsed(out)
        if scheme not in DEFAULT_PORTS:
            return out
        fragment = urlsplit(out).fragment
        path = quote(_without_dots(path or "/"), safe="/%:@!$&'()*+,;=~-._|[]^")
        query = quote(query, safe="/%:@!$&()*+,;=~-._|[]^?`{}")
        return f"{scheme}://{host}{f':{port}' if port is not None else ''}{path}" + (f"?{query}" if query else "") + (f"#{fragment}" if fragment else "")
    except ValueError:
        return None


def clean_image(raw: str | None, base: str | None) -> str | None:
    """An absolute http(s) address of an image with its parameters kept; null for empty, data and other addresses."""
    raw = (raw or "").strip()
    if not raw or raw.startswith("data:"):
        return None
    out = resolve(raw, base)
    return out if out and re.match(r"(?i)https?://", out) else None


def _resolve_series(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b) for h, b in zip(href, base)], dtype=object)


def resolve_url(href: Column, base: Column) -> Column:
    return _vectorised(_resolve_series, href, base)


def _image_series(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([clean_image(r, b) for r, b in zip(raw, base)], dtype=object)


def clean_image_url(raw: Column, base: Column) -> Column:
    """``clean_image`` as a column; absolute plain addresses don't reach Python."""
    plain = trim(raw).rlike(r"^https?://[a-z0-9.-]+/[A-Za-z0-9_~!$&()*+,;=:@/.?-]*$") & ~raw.contains("/.")
    return F.when(plain, trim(raw)).otherwise(_vectorised(_image_series, F.when(~F.coalesce(plain, F.lit(False)), raw), base))
