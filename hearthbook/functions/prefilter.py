"""Cheap necessary conditions for patterns.

Most texts match few rules. A pattern can only match where one of its fixed pieces occurs, and
looking for a fixed piece is an order of magnitude cheaper than running the pattern. Pieces are read
off the pattern with the standard library, so the condition never hides a match.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

try:
    from re import _constants as sre, _parser as reader
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse as reader

MOST_PIECES = 64
MARK = "\x01"


def _best(options: list[list[str]]) -> list[str] | None:
    """The set whose shortest piece is longest."""
    usable = [o for o in options if o and len(o) <= MOST_PIECES]
    return max(usable, key=lambda o: (min(map(len, o)), -len(o))) if usable else None


def _pieces(tokens) -> list[str] | None:
    options, run = [], ""

    def flush():
        nonlocal run
        if run:
            options.append([run])
        run = ""

    for op, arg in tokens:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        flush()
        if op is sre.SUBPATTERN:
            found = _pieces(arg[-1])
        elif op is sre.BRANCH:
            parts = [_pieces(b) for b in arg[1]]
            found = [p for part in parts for p in part] if all(parts) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            found = _pieces(arg[2])
        else:
            found = None
        if found:
            options.append(list(dict.fromkeys(found)))
    flush()
    return _best(options)


def _flags(tokens) -> int:
    """All flags that some part of the pattern switches on."""
    found = 0
    for op, arg in tokens:
        if op is sre.SUBPATTERN:
            found |= arg[1] | _flags(arg[-1])
        elif op is sre.BRANCH:
            for b in arg[1]:
                found |= _flags(b)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            found |= _flags(arg[2])
    return found


def pieces(pattern: str) -> tuple[list[str] | None, bool]:
    """Fixed pieces of which every match holds at least one, and whether case is ignored somewhere.

    Flags are taken from the parsed pattern, of the whole and of its parts. Where the standard library
    reads a pattern otherwise or not at all, there are no pieces.
    """
    try:
        parsed = reader.parse(pattern)
    except (re.error, OverflowError):
        return None, False
    flags = parsed.state.flags | _flags(parsed)
    folded = bool(flags & re.IGNORECASE)
    found = None if flags & re.VERBOSE else _pieces(parsed)
    if found and folded:
        found = [p.lower() for p in found] if all(p.isascii() for p in found) else None
    return found, folded


def plain_words(pattern: str) -> list[str] | None:
    """The alternatives of a pattern that is nothing but words joined by bars."""
    if re.search(r"[\\^$.?*+()\[\]{}]", pattern):
        return None
    return pattern.split("|")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when one of the words occurs; a long list travels as one constant array."""
    if len(words) <= 3 or any(MARK in w for w in words):
        return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    return F.exists(F.split(F.lit(MARK.join(words)), MARK), lambda w: F.contains(c, w))


def holds_any(c: Column, words: list[str], fold: bool = False) -> Column:
    """``contains_any`` for long texts and long lists: one automaton looks for all words at once, on Arrow batches.

    With ``fold`` case is ignored. Not for use inside lambdas.
    """
    pattern = "|".join(map(re.escape, words))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        return pc.match_substring_regex(texts, pattern, ignore_case=fold)

    return found(c)


TOGETHER = 10


def held(c: Column, sets: list[list[str]]) -> Column:
    """Numbers, as words, of the sets of which a word occurs in the text.

    On Arrow batches one automaton tells which texts hold a word of several sets; only those are searched for each of them.
    Not for use inside lambdas.
    """
    automata = [("|".join(map(re.escape, words)), i) for i, words in enumerate(sets) if words]
    groups = [automata[i:i + TOGETHER] for i in range(0, len(automata), TOGETHER)]

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        def holding(some, pattern):
            return np.flatnonzero(pc.fill_null(pc.match_substring_regex(some, pattern), False).to_numpy(zero_copy_only=False))

        rows, numbers = [np.empty(0, "int64")], [np.empty(0, "int64")]
        for group in groups:
            near = holding(texts, "|".join(p for p, _ in group))
            some = texts.take(pa.array(near))
            for pattern, i in group:
                rows.append(near[holding(some, pattern)])
                numbers.append(np.full(len(rows[-1]), i))
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(texts) + 1)).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(number[order]).cast("string"))

    return found(c)


def may_match(c: Column, pattern: str) -> Column | None:
    """Condition without which the pattern cannot match, or None when it has no fixed piece."""
    found, folded = pieces(pattern)
    if not found:
        return None
    return contains_any(F.lower(c) if folded else c, found)


# -- many patterns at once ----------------------------------------------------------------------

FEW = 4


def _char(c: str) -> str:
    return "\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else f"\\x{{{ord(c):x}}}" if c.isspace() else c


def _branches(children: dict, nested: dict[str, str]) -> str:
    """Alternatives by first letter; many of them are halved by look-ahead, so that a place costs a few class tests."""
    letters = sorted(children)
    if len(letters) <= FEW:
        return "|".join(_char(c) + nested[c] for c in letters)
    half = len(letters) // 2
    first, second = letters[:half], letters[half:]
    parts = [_branches({c: children[c] for c in some}, nested) for some in (first, second)]
    return f"(?=[{''.join(map(_char, first))}])(?:{parts[0]})|{parts[1]}"


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of the words at a place, with common beginnings read once."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        children = {c: n for c, n in node.items() if c}
        if not children:
            return ""
        inner = f"(?:{_branches(children, {c: build(n) for c, n in children.items()})})"
        return inner + "?" if "" in node else inner

    return build(trie)


def occurring(c: Column, words: list[str]) -> Column:
    """The distinct words that start somewhere in a text, the longest of each place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=({trie_pattern(words)}))"), F.lit(1)))


class PatternIndex:
    """Which of many patterns may match: those with a fixed piece in the text, and those without any."""

    def __init__(self, patterns: list[str]):
        self.known = {p: pieces(p) for p in dict.fromkeys(patterns)}
        self.number = {p: i for i, p in enumerate(self.known)}

    def numbers(self, c: Column) -> Column:
        """Numbers of the patterns with a piece in the text, as words."""
        return held(c, [found or [] for found, _ in self.known.values()])

    def need(self, pattern: str, own: Column, low: Column) -> Column | None:
        """Condition from the numbers found in the text and in its lower-cased form."""
        found, folded = self.known[pattern]
        if not found:
            return None
        return F.array_contains(low if folded else own, str(self.number[pattern]))
