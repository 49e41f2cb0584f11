"""Secrets in texts, and credentials whose parts stand apart.

Strong finds (assignments, access keys, long hexadecimal values) are reported as they are. Weak
candidates prove nothing alone: a user or client name, a random-looking value, a host or address.
Within a scope - ``reach`` code points to either side - the candidates of a text are interval-joined:
a random-looking value counts if an access identifier or an endpoint lies in its scope, a faint value
- 8 characters or more behind a key-like label, or 16 or more of two character classes - only if
both do, an identifier if a secret does, and an endpoint if it serves such a link. The join sorts intervals by
start and compares with the farthest end so far, so it grows with the number of candidates.

Null texts are empty. Every row is judged alone: repeated rows give repeated results, other columns
are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from hearthbook.llm.common import digest, per_text
from hearthbook.llm.spans import char_class, runs

BASE = ("assign", "access", "hex")
LINKED = ("identifier", "value", "endpoint")
KINDS = BASE + LINKED

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
HEX = char_class("0123456789abcdef")
TOKEN = char_class(ALNUM + "+/_-=")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", re.I | re.A)
IDENTIFIER_WORDS = ("user", "login", "account", "client", "keyid", "key_id")
LABELLED = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass(?:phrase|code|wd|word)?|auth(?:orization)?|cred(?:ential)?s?|pin|[A-Za-z0-9_-]{0,40}?(?:key|secret|token|pwd))["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{8,})""", re.I | re.A)
LABEL_WORDS = ("pwd", "pass", "auth", "cred", "pin", "key", "secret", "token")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)


def strong(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's kinds, by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(a, b, "hex") for a, b in runs(text, HEX, 32)]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


def random_looking(token: str) -> bool:
    """Letters of both cases and digits, at three and a half bits a character or more."""
    if not (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.5


def two_classes(token: str) -> bool:
    """Two of lower case, upper case and digits; a capital at the start alone is no upper case."""
    return any(c.islower() for c in token) + any(c.isupper() for c in token[1:]) + any(c.isdigit() for c in token) >= 2


def weak(text: str, taken: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """Candidates by role, none of them inside a strong find."""
    low = text.lower()
    covered = sorted((a, b) for a, b, _ in taken)
    starts, ends = [a for a, _ in covered], np.maximum.accumulate([b for _, b in covered]) if covered else []

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b)) if starts else 0
        return i == 0 or ends[i - 1] <= a

    out = {"identifier": [], "value": [], "endpoint": [], "faint": []}
    if any(w in low for w in IDENTIFIER_WORDS):
        out["identifier"] = [m.span() for m in IDENTIFIER.finditer(text) if free(*m.span())]
    if "://" in text:
        out["endpoint"] = [m.span() for m in ENDPOINT.finditer(text) if free(*m.span())]
    tokens = [(a, b) for a, b in runs(text, TOKEN, 16) if free(a, b)]
    out["value"] = [(a, b) for a, b in tokens if b - a >= 20 and random_looking(text[a:b])]
    # faint values need an identifier and an endpoint
    if (out["identifier"] or any(k == "access" for *_, k in taken)) and out["endpoint"]:
        faint = {(a, b) for a, b in tokens if two_classes(text[a:b])}
        if any(w in low for w in LABEL_WORDS):
            faint |= {m.span(1) for m in LABELLED.finditer(text) if free(*m.span(1))}
        firm = sorted(out["value"] + out["identifier"] + out["endpoint"])
        faint, upto = sorted(faint, key=lambda s: (s[0], -s[1])), 0
        # the first and longest of those that meet; none that meets a firmer candidate
        for (a, b), met in zip(faint, near(faint, firm, -1), strict=True):
            if a >= upto and not met:
                out["faint"].append((a, b))
                upto = b
    return out


def near(these: list[tuple[int, int]], those: list[tuple[int, int]], reach: int) -> list[bool]:
    """For each of these whether one of those lies within its scope."""
    if not these or not those:
        return [False] * len(these)
    those = sorted(those)
    starts = np.array([a for a, _ in those])
    farthest = np.maximum.accumulate([b for _, b in those])
    upto = np.searchsorted(starts, [b + reach for _, b in these], "right")
    return [bool(i and farthest[i - 1] >= a - reach) for i, (a, _) in zip(upto, these, strict=True)]


def link(text: str, reach: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Strong finds, and the weak candidates whose complement is in scope."""
    base = strong(text)
    parts = weak(text, base)
    ids = [(a, b) for a, b, k in base if k == "access"] + parts["identifier"]
    known = [(a, b) for a, b, k in base if k != "access"]
    out = []
    values = [v for v, x, y in zip(parts["value"], near(parts["value"], ids, reach),
                                   near(parts["value"], parts["endpoint"], reach), strict=True) if x or y]
    values += [v for v, x, y in zip(parts["faint"], near(parts["faint"], ids, reach),
                                    near(parts["faint"], parts["endpoint"], reach), strict=True) if x and y]
    out += [(*v, "value") for v in values]
    out += [(*v, "identifier") for v, x in zip(parts["identifier"], near(parts["identifier"], known + values, reach), strict=True) if x]
    out += [(*v, "endpoint") for v, x in zip(parts["endpoint"], near(parts["endpoint"], known + values + [(a, b) for a, b, k in base if k == "access"], reach), strict=True) if x]
    return base, sorted(out)


SCHEMA = "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row per document: counts, the digest of the strong spans, and all spans as text.

    A span is ``kind:start:end`` in code points, end exclusive, by start, then kind as listed in KINDS.
    """
    def scan(value: str) -> tuple:
        base, linked = link(value, reach)
        count = Counter(k for *_, k in base)
        every = sorted(base + linked, key=lambda s: (s[0], KINDS.index(s[2])))
        return (count["assign"], count["access"], count["hex"], len(linked),
                digest(f"{k}:{a}:{b}" for a, b, k in base), ",".join(f"{k}:{a}:{b}" for a, b, k in every))

    return per_text(docs, scan, SCHEMA, key, text)
