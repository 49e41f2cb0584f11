"""Finding spans in whole texts in time that grows with their length, whatever they hold."""

from __future__ import annotations

import re

import numpy as np

DIGIT = re.compile(r"[0-9]")


def char_class(chars: str) -> np.ndarray:
    """A lookup table over code points below 128; the last entry stands for all others."""
    table = np.zeros(129, bool)
    table[[ord(c) for c in chars]] = True
    return table


def runs(text: str, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of ``least`` or more characters of the class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = table[np.minimum(points, 128)]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` is looked at once: the longest free local part before it, the domain behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]


def private_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of personal data by kind, in the order of the kinds."""
    digits = DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if digits else [],
            "card": cards(text) if digits else [], "phone": phones(text) if digits and "+" in text else []}
