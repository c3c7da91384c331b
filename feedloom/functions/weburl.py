"""Addresses read and written as the URL standard says: one parser for a string, used in Arrow batches."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace

# Fixed values of the standard: default ports, percent-encode sets, forbidden signs of hosts.
PORTS = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}
FRAGMENT = ' "<>`'
QUERY = ' "#<>'
SPECIAL_QUERY = QUERY + "'"
PATH = QUERY + "?^`{}"
USERINFO = PATH + "/:;=@[\\]|"
FORBIDDEN_HOST = "\0\t\n\r #/:<>?@[\\]^|"
FORBIDDEN_DOMAIN = FORBIDDEN_HOST + "%\x7f" + "".join(map(chr, range(32)))

SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):")
DOT, DOTS = re.compile(r"(?:\.|%2e)", re.I), re.compile(r"(?:\.|%2e){2}", re.I)
DRIVE = re.compile(r"[a-zA-Z][:|]")
ENDS = "".join(map(chr, range(33)))


class NotAnAddress(ValueError):
    """A string that the standard's parser refuses."""


def encoded(text: str, signs: str) -> str:
    """Text with these signs, controls and what isn't ASCII percent-encoded."""
    return "".join(c if " " <= c <= "~" and c not in signs else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def decoded(text: str) -> bytes:
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


def to_ascii(domain: str) -> str:
    """Labels in lower case and composed form; those beyond ASCII in Punycode."""
    labels = re.split("[.。．｡]", unicodedata.normalize("NFKC", domain).lower().replace("\xad", ""))
    return ".".join(x if x.isascii() else "xn--" + unicodedata.normalize("NFC", x).encode("punycode").decode() for x in labels)


def number(part: str) -> int | None:
    """A decimal, octal or hexadecimal part of an IPv4 address."""
    base, digits = (16, part[2:]) if part[:2].lower() == "0x" else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    allowed = "0123456789abcdefABCDEF" if base == 16 else "01234567" if base == 8 else "0123456789"
    if part == "" or any(c not in allowed for c in digits):
        return None
    return int(digits or "0", base)


def ipv4(domain: str) -> str | None:
    """The address that a domain whose last label is a number stands for; None for other domains."""
    parts = domain.split(".")
    parts = parts[:-1] if len(parts) > 1 and parts[-1] == "" else parts
    if not (parts[-1].isdigit() and parts[-1].isascii()) and number(parts[-1]) is None:
        return None
    values = [number(p) for p in parts]
    if len(values) > 4 or any(v is None for v in values) or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        raise NotAnAddress(domain)
    whole = values[-1] + sum(v << 8 * (3 - k) for k, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(whole))


def host_of(text: str, special: bool) -> str:
    if text.startswith("["):
        try:
            if not text.endswith("]") or "%" in text:
                raise ValueError
            v = ipaddress.IPv6Address(text[1:-1])
        except ValueError as e:
            raise NotAnAddress(text) from e
        return f"[{shortened(v)}]"
    if not special:
        if any(c in FORBIDDEN_HOST for c in text):
            raise NotAnAddress(text)
        return encoded(text, "")
    domain = to_ascii(decoded(text).decode("utf-8", "replace"))
    if not domain or any(c in FORBIDDEN_DOMAIN for c in domain):
        raise NotAnAddress(text)
    return ipv4(domain) or domain


def shortened(v: ipaddress.IPv6Address) -> str:
    """Pieces in hexadecimal, the first longest run of two or more zeros left out."""
    pieces = [v.packed[2 * k] << 8 | v.packed[2 * k + 1] for k in range(8)]
    runs = [(sum(1 for _ in _zeros(pieces, k)), -k) for k in range(8)]
    n, at = max(runs)
    words = [f"{p:x}" for p in pieces]
    return ":".join(words) if n < 2 else ":".join(words[:-at]) + "::" + ":".join(words[-at + n :])


def _zeros(pieces: list[int], k: int):
    while k < len(pieces) and pieces[k] == 0:
        yield k
        k += 1


def path_of(text: str, special: bool, file: bool) -> str:
    """A path with its dot segments resolved, each segment encoded, a slash in front."""
    out: list[str] = []
    parts = re.split(r"[/\\]" if special else "/", text)
    for k, part in enumerate(parts):
        final = k == len(parts) - 1
        if DOTS.fullmatch(part):
            if out and not (file and len(out) == 1 and DRIVE.fullmatch(out[0])):
                out.pop()
            out += [""] if final else []
        elif DOT.fullmatch(part):
            out += [""] if final else []
        else:
            if file and not out and DRIVE.fullmatch(part):
                part = part[0] + ":"
            out.append(encoded(part, PATH))
    return "/" + "/".join(out)


@dataclass(frozen=True)
class Address:
    scheme: str
    user: str
    password: str
    host: str | None
    port: int | None
    path: str
    opaque: bool
    query: str | None
    fragment: str | None

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            login = self.user + (f":{self.password}" if self.password else "")
            out += "//" + (f"{login}@" if login else "") + self.host + ("" if self.port is None else f":{self.port}")
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        return out + self.path + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def parse(value: str) -> Address:
    """The address that an absolute one stands for; relative ones and what has no valid host or port raise NotAnAddress."""
    text = re.sub("[\t\n\r]", "", value.strip(ENDS))
    m = SCHEME.match(text)
    if not m:
        raise NotAnAddress(value)
    scheme, rest = m[1].lower(), text[m.end() :]
    special, file = scheme in PORTS, scheme == "file"
    rest, mark, fragment = rest.partition("#")
    fragment = encoded(fragment, FRAGMENT) if mark else None
    rest, mark, query = rest.partition("?")
    query = encoded(query, SPECIAL_QUERY if special else QUERY) if mark else None
    slashes = "/\\" if special else "/"
    user = password = ""
    host, port, opaque = None, None, False
    if special and not file:
        rest = "//" + rest.lstrip(slashes)
    if len(rest) >= 2 and rest[0] in slashes and rest[1] in slashes and not (file and DRIVE.match(rest[2:4]) and (len(rest) == 4 or rest[4] in slashes)):
        cut = next((k for k in range(2, len(rest)) if rest[k] in slashes), len(rest))
        authority, path = rest[2:cut], rest[cut:]
        login, at, place = authority.rpartition("@")
        if at and file:
            raise NotAnAddress(value)
        user, _, password = (encoded(x, USERINFO) for x in login.partition(":"))
        name, colon, digits = place.rpartition(":") if re.search(r":[^\]]*$", place) else (place, "", "")
        if digits and not (digits.isdigit() and digits.isascii() and int(digits) <= 65535) or (colon and file):
            raise NotAnAddress(value)
        if name == "" and (colon or at or (special and not file)):
            raise NotAnAddress(value)
        host = host_of(name, special) if name else ""
        host = "" if file and host == "localhost" else host
        port = int(digits) if digits and int(digits) != PORTS.get(scheme) else None
        path = path_of(path[1:], special, file) if path or special else ""
    elif file:
        host, path = "", path_of(rest[2 if rest[:2] in ("//", "\\\\", "/\\", "\\/") else int(rest[:1] in ("/", "\\") and bool(rest)) :], True, True)
    elif rest.startswith("/"):
        path = path_of(rest[1:], False, False)
    else:
        path, opaque = encoded(rest, ""), True
    return Address(scheme, user, password, host, port, path, opaque, query, fragment)


def read(value: str | None) -> Address | None:
    """The address of a text, surrounding white space ignored; None for what isn't one."""
    try:
        return parse(value.strip()) if value and value.strip() else None
    except NotAnAddress:
        return None


def href(value: str | None) -> str | None:
    found = read(value)
    return None if found is None else str(found)


def canonical(value: str | None) -> str | None:
    """For comparison: no fragment and no slashes at the end of the path; what isn't an address is trimmed and in lower case."""
    found = read(value)
    if found is None:
        return (value or "").strip().lower() or None
    return str(replace(found, fragment=None, path=found.path if found.opaque else found.path.rstrip("/") or "/"))


def favicon(value: str | None) -> str | None:
    """``/favicon.ico`` at the same host; None for addresses without a hierarchy."""
    found = read(value)
    return None if found is None or found.opaque else str(replace(found, path="/favicon.ico", query=None, fragment=None))
