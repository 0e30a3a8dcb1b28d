"""Classes of addresses found in untrusted text.

The rules fail closed: whatever the parser is unsure of has no class. The hosts of the site that is read are
parameters (``Site``).
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a bare address, and punctuation cut from its end.
_BARE = re.compile(r"https?://[^\s<>\"'`|{}\[\]\\\ufeff]+", re.I)
_TRAILING = set(".,;:!?\"'。，、；：！？…‥」』）】》〉］｝「『（【《〈［｛”’")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_DIGITS = re.compile(r"[0-9]+")

#: Networks whose addresses are never followed; all of 192.0.0.0/16 is refused on purpose.
_REFUSED_4 = [
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/16 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
    ).split()
]
_REFUSED_6 = [ipaddress.ip_network(n) for n in ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")]


@dataclass(frozen=True)
class Site:
    """Hosts with a special meaning: one that only redirects, and the domain of trusted images."""

    redirect_host: str = "link.example"
    image_domain: str = "img.example"
    page_host: str = "qa.example"


def tokenize(text: str | None) -> list[tuple[str, str]]:
    """A text as spans of ('text', part) and ('url', address), trailing punctuation outside the address."""
    text = text or ""
    spans, at = [], 0

    def add(part: str) -> None:
        if part:
            spans.append(("text", part))

    for m in _BARE.finditer(text):
        address = m.group()
        while address:
            last = address[-1]
            if last in ")]}":
                opening = "([{"[")]}".index(last)]
                if address.count(opening) >= address.count(last):
                    break
            elif last not in _TRAILING:
                break
            address = address[:-1]
        add(text[at : m.start()])
        if address:
            spans.append(("url", address))
        add(m.group()[len(address) :])
        at = m.end()
    add(text[at:])
    return spans


def _ipv4_number(part: str) -> int | None:
    """A part of a dotted address in decimal, octal or hexadecimal."""
    try:
        if part[:2].lower() == "0x":
            return int(part[2:], 16) if part[2:] else 0
        if len(part) > 1 and part[0] == "0":
            return int(part[1:], 8)
        return int(part) if _DIGITS.fullmatch(part) else None
    except ValueError:
        return None


def _host(raw: str) -> str | None:
    """A host in its normal form; None if it isn't certain."""
    if raw.startswith("["):
        if not raw.endswith("]"):
            return None
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
        except ValueError:
            return None
    text = raw
    if "%" in text:
        from urllib.parse import unquote

        text = unquote(text)
    if not text.isascii():
        try:
            import idna

            text = idna.encode(text.replace("。", ".").replace("．", ".").replace("｡", "."), uts46=True).decode("ascii")
        except Exception:
            return None
    text = text.lower()
    if not text or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", text):
        return None
    labels = text[:-1].split(".") if text.endswith(".") else text.split(".")
    if labels and (_DIGITS.fullmatch(labels[-1]) or re.fullmatch(r"0x[0-9a-f]*", labels[-1])):
        numbers = [_ipv4_number(x) if x else None for x in labels]
        if len(numbers) > 4 or any(n is None for n in numbers):
            return None
        if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(n << (8 * (3 - k)) for k, n in enumerate(numbers[:-1]))
        return str(ipaddress.IPv4Address(value))
    if any(not x for x in labels):
        return None if len(labels) > 1 or not labels[0] else text
    return text


@dataclass(frozen=True)
class Address:
    scheme: str
    user: bool
    host: str
    port: str
    path: str
    query: str | None
    fragment: str | None

    @property
    def href(self) -> str:
        out = f"{self.scheme}://{self.host}{':' + self.port if self.port else ''}{self.path}"
        return out + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse(raw: str) -> Address | None:
    """An http or https address in normal form; None for everything else."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = re.match(r"(https?):[/\\]*", text, re.I)
    if not m:
        return None
    scheme, rest = m.group(1).lower(), text[m.end() :]
    rest, mark, fragment = rest.partition("#")
    fragment = quote(fragment, safe="!#$%&'()*+,/:;=?@[]^_{|}~-.\\") if mark else None
    rest, mark, query = rest.partition("?")
    query = quote(query, safe="!$%&()*+,/:;=?@[\\]^_`{|}~-.") if mark else None
    cut = re.search(r"[/\\]", rest)
    authority, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    user, mark, hostport = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
    if not m or not m.group(1):
        return None
    host = _host(m.group(1))
    if host is None:
        return None
    port = m.group(2) or ""
    if port:
        if int(port) > 65535:
            return None
        port = "" if int(port) == (443 if scheme == "https" else 80) else str(int(port))
    path = quote(_dots(path.replace("\\", "/")), safe="!$%&'()*+,/:;=@[]^_|~-.")
    return Address(scheme, bool(mark and user.strip(":")), host, port, path, query, fragment)


def restricted(host: str) -> bool:
    """A name or number of this machine, a private or a reserved network."""
    name = host.lower().strip("[]").rstrip(".") if not host.endswith("..") else host
    if name == "localhost" or name.endswith(".localhost"):
        return True
    try:
        number = ipaddress.ip_address(name)
    except ValueError:
        return bool(_CONTROL.search(name))
    if number.version == 6:
        if number.ipv4_mapped is not None:
            number = number.ipv4_mapped
        else:
            return any(number in n for n in _REFUSED_6)
    return any(number in n for n in _REFUSED_4)


def classify(raw: str | None, site: Site = Site(), depth: int = 0) -> dict | None:
    """The class of an address, or None if it may not be followed. A redirect is judged by its target."""
    if not raw or _CONTROL.search(raw) or depth > 20:
        return None
    address = parse(raw)
    if address is None:
        return None
    name = address.host.rstrip(".")
    if name == site.redirect_host:
        target = redirect_target(raw, site)
        inner = classify(target, site, depth + 1) if target else None
        if inner is None:
            return None
        return {**inner, "reason": f"redirect_target:{inner['reason']}", "redirect_target": inner["canonical_url"]}
    if address.scheme != "https" or address.user or restricted(address.host):
        return None
    return {"clickable": True, "security_class": "external_unverified", "canonical_url": address.href, "display_host": address.host, "reason": "https_public", "redirect_target": None}


def redirect_target(raw: str | None, site: Site = Site()) -> str | None:
    """The target that an address of the redirect host names."""
    address = parse(raw or "")
    if address is None or address.host.rstrip(".") != site.redirect_host or not address.query:
        return None
    return next((v for k, v in parse_qsl(address.query, keep_blank_values=True) if k == "target"), None) or None


def classify_image(raw: str | None, site: Site = Site()) -> dict | None:
    """The class of an image's address: detected, and to be followed only on the trusted domain over https."""
    text = (raw or "").strip()
    if not text or _CONTROL.search(text) or not re.match(r"https?://", text, re.I):
        return None
    address = parse(text)
    if address is None:
        return {"host": "unknown", "original_url": text, "clickable": False, "security_class": "external_image_untrusted", "reason": "unparsable"}
    secure = address.scheme == "https"
    trusted = secure and address.host.rstrip(".").split(".")[-2:] == site.image_domain.split(".")
    return {
        "host": address.host,
        "original_url": address.href if secure else text,
        "clickable": trusted,
        "security_class": "trusted_image" if trusted else "external_image_untrusted",
        "reason": "trusted_https" if trusted else "other_host" if secure else "non_https",
    }


def safe_destination(url: str | None) -> str:
    """An address whose characters cannot end a Markdown link."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 0x20 or ord(c) == 0x7F or c in "()<>\\\"'" else c for c in url or "")


def classify_answer(raw: str | None, question: str | None, answer: str | None, site: Site = Site()) -> str:
    """H27: 'ok', or why an address is not that of the given answer."""
    if raw is None:
        return "url_missing"
    address = parse(raw)
    if address is None:
        return "protocol_not_https" if re.match(r"[a-z][a-z0-9+.\-]*:", raw.strip(), re.I) and not re.match(r"https?:", raw.strip(), re.I) else "url_unparsable"
    if address.scheme != "https":
        return "protocol_not_https"
    if address.host != site.page_host:
        return "host_not_site"
    if address.port:
        return "port_not_https"
    if address.user:
        return "url_has_userinfo"
    path = address.path.rstrip("/")
    if path != f"/question/{question}/answer/{answer}":
        return "path_mismatch" if path.startswith("/question/") else "path_not_answer"
    return "ok"


# ---------------------------------------------------------------- Columns

_CLASS = "clickable boolean, security_class string, canonical_url string, display_host string, reason string, redirect_target string"
CLASS_TYPE = _CLASS.replace(" ", ":").replace(",:", ",")
_IMAGE = "host string, original_url string, clickable boolean, security_class string, reason string"


def _struct_udf(schema: str, function: Callable[[str | None], dict | None]):
    names = [part.strip().split()[0] for part in schema.split(",")]

    @F.pandas_udf(f"found boolean, {schema}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = [function(v) for v in values]
            yield pd.DataFrame({"found": [r is not None for r in rows], **{n: [r[n] if r else None for r in rows] for n in names}})

    return run


def url_class(value: Column, site: Site = Site()) -> Column:
    """H23 as a struct; null where the address has no class."""
    got = _struct_udf(_CLASS, lambda v: classify(v, site))(value)
    return F.when(got["found"], got.dropFields("found"))


def image_class(value: Column, site: Site = Site()) -> Column:
    """H25 as a struct; null where the address has no class."""
    got = _struct_udf(_IMAGE, lambda v: classify_image(v, site))(value)
    return F.when(got["found"], got.dropFields("found"))


def answer_check(url: Column, question: Column, answer: Column, site: Site = Site()) -> Column:
    """H27 as a reason code."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, q, a in batches:
            yield pd.Series([classify_answer(*x, site=site) for x in zip(u, q, a)], dtype=object)

    return run(url, question, answer)


def bare_urls(value: Column) -> Column:
    """The addresses of a text, in order."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([[t for kind, t in tokenize(v) if kind == "url"] for v in values], dtype=object)

    return run(value)
