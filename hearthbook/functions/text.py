"""Column functions over strings: names of files, slugs, cleaning, lines and previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook.functions.prefilter import contains_any, may_match, plain_words
from hearthbook.rulesets import mail, ocr


def unicode_words(pattern: str) -> str:
    r"""Spell ``\w`` as letters, digits and underscore of any script, inside and outside classes."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]")
            i += 2
            continue
        if pair[0] == "\\":
            out.append(pair)
            i += 2
            continue
        if pair[0] == "[" and not in_class:
            in_class = True
        elif pair[0] == "]" and in_class:
            in_class = False
        out.append(pair[0])
        i += 1
    return "".join(out)


def let(value: Column, body) -> Column:
    """Compute ``value`` once and use it many times in ``body``.

    Long rule lists stay out of the generated code of the stage, which has a size limit.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    def trimmed(x: Column) -> Column:
        # a pattern's end also lies before a last line end of other scripts; elsewhere plain trimming does the same
        odd = F.endswith(x, F.lit("\u0085")) | F.endswith(x, F.lit("\u2028")) | F.endswith(x, F.lit("\u2029"))
        return F.when(odd, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(" \t\n\x0b\f\r")))

    return let(c, trimmed)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def any_of(words: list[str]) -> str:
    """One alternation that finds any of ``words`` literally."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def occurs(c: Column, pattern: str) -> Column:
    """True when the pattern occurs; plain words are searched as such."""
    words = plain_words(pattern)
    if words:
        return contains_any(c, words)
    found = matches(c, unicode_words(pattern))
    need = may_match(c, pattern)
    return found if need is None else need & found


def hits(c: Column, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    counted = F.regexp_count(c, F.lit(unicode_words(pattern)))
    need = may_match(c, pattern)
    return counted if need is None else F.when(need, counted).otherwise(0)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """Every match, or one group of each, in text order."""
    found = F.regexp_extract_all(c, F.lit(unicode_words(pattern)), F.lit(group))
    need = may_match(c, pattern)
    return found if need is None else F.when(need, found).otherwise(F.array().cast("array<string>"))


# -- slugs and file names -----------------------------------------------------------------------


def slugify(c: Column, style: str = "url", max_len: int = 60) -> Column:
    """Slug of a text: ``url`` (article links), ``tag`` (note tags) or ``id`` (work ids)."""
    if style == "url":
        kept = F.regexp_replace(strip(F.lower(c)), r"[^\p{L}\p{N}_\s-]", "")
        dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "-+", "-")
        return F.substring(F.btrim(dashed, F.lit("-")), 1, max_len)
    if style == "tag":
        dashed = F.regexp_replace(F.lower(c), "[^a-zA-Z0-9_-]", "-")
        return F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit("-"))
    if style == "id":
        return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    raise ValueError(f"unknown slug style {style!r}")


def safe_name(c: Column, max_len: int = 200) -> Column:
    """Social file name: slashes become dashes, reserved characters vanish."""
    cleaned = F.regexp_replace(F.translate(c, "/\\", "--"), r'[<>:"|?*]', "")
    cut = F.substring(F.btrim(cleaned, F.lit(". ")), 1, max_len)
    return F.when(cut == "", "Untitled").otherwise(cut)


def category_name(c: Column) -> Column:
    return F.trim(F.translate(c, "/\\", "--"))


def headline_name(c: Column, max_len: int = 120) -> Column:
    """Article file-name part: reserved characters removed, cut at the last blank before the limit."""
    clean = F.regexp_replace(c, r'[<>:"/\\|?*]', "")
    cut = F.substring(clean, 1, max_len)
    at_word = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(clean) > max_len, at_word).otherwise(clean)


def address_file_name(addr: Column) -> Column:
    """File name of a contact bundle; long or path-unsafe addresses get a digest."""
    plain = F.translate(F.replace(addr, F.lit("@"), F.lit("_at_")), "./\\ ", "____")
    digest = F.concat(F.substring(plain, 1, 40), F.lit("_"), F.substring(F.md5(addr), 1, 12))
    unsafe = (F.length(plain) > 100) | matches(addr, r"[/\\ ]")
    return F.when(unsafe, digest).otherwise(plain)


# -- mail bodies --------------------------------------------------------------------------------


def html_to_text(c: Column) -> Column:
    """Tag-free text: style and script go, block ends become line breaks, entities are decoded."""
    bare = F.regexp_replace(c, r"(?is)<(style|script)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    broken = F.regexp_replace(bare, r"(?i)</(p|div|tr|li|h1|h2|h3|h4|br)\s*>|<br\s*/>", "\n")
    text = F.regexp_replace(broken, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_replies(c: Column) -> Column:
    """Drop everything from the first reply mark on, then quoted lines and the blanks behind them."""
    def upto_mark(lines: Column) -> Column:
        def is_mark(line: Column, i: Column) -> Column:
            header_follows = F.exists(
                F.slice(lines, i + 2, 3), lambda x: matches(strip(x), r"^(Sent|Date|To|Subject):\s+")
            )
            return let(strip(line), lambda s: (
                matches(s, r"^On .+ wrote:$")
                | matches(s, r"(?i)^-{3,}\s*Original Message\s*-{3,}")
                | (matches(s, r"^From:\s+") & header_follows)
            ))

        stop = F.array_position(F.transform(lines, is_mark), True)
        kept = let(stop, lambda n: F.when(n > 0, F.slice(lines, 1, F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(lines))
        return F.array_join(kept, "\n")

    # every mark holds one of these: most texts need no look at their lines
    marked = F.contains(c, F.lit("wrote:")) | F.contains(c, F.lit("---")) | F.contains(c, F.lit("From:"))
    head = F.when(marked, let(F.split(c, "\n"), upto_mark)).otherwise(c)
    # a quoted line and the blank ones behind it go in one pass over the text
    quoted = r"(?m)^[^\S\n]*>[^\n]*(?:\n|\z)(?:[^\S\n]*\n)*"
    return let(head, lambda h: strip(F.when(F.contains(h, F.lit(">")), F.regexp_replace(h, quoted, "")).otherwise(h)))


def signature(c: Column, mark_first: bool = False) -> Column:
    """Struct of the phone and the title found in the signature area.

    With ``mark_first`` a phone below the mark goes before long numbers of the text above it.
    """
    def phone(area: Column) -> Column:
        found = F.regexp_extract_all(area, F.lit(mail.SIGNATURE_PHONE), F.lit(0))
        return F.get(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 7), F.lit(0))

    title = r"(?i)^(?:" + "|".join(mail.TITLE_WORDS) + r")[\p{L}\p{N}_\s,/&-]*"

    def read(lines: Column, mark: Column) -> Column:
        area = F.when(F.size(lines) > 15, F.array_join(F.slice(lines, -15, 15), "\n")).otherwise(c)
        below = F.slice(lines, (mark + 1).cast("int"), F.greatest(F.size(lines), F.lit(1)))
        titled = F.filter(
            F.transform(below, strip),
            lambda x: matches(x, title) & ~matches(x, mail.SIGNATURE_PHONE) & ~F.contains(x, F.lit("@")),
        )
        found = strip(F.regexp_extract(F.get(titled, F.lit(0)), title, 0))
        first = phone(area)
        if mark_first:
            signed = F.slice(lines, F.greatest(mark + 1, F.size(lines) - 14).cast("int"), F.lit(15))
            first = F.coalesce(F.when(mark > 0, phone(F.array_join(signed, "\n"))), first)
        return F.struct(
            strip(first).alias("phone"),
            F.when(mark > 0, F.nullif(found, F.lit(""))).alias("title"),
        )

    def with_mark(lines: Column) -> Column:
        mark = F.array_position(F.transform(lines, lambda x: strip(x).isin(mail.SIGNATURE_MARKS)), True)
        return let(mark, lambda m: read(lines, m))

    return let(F.split(strip(c), "\n"), with_mark)


def normalise_subject(c: Column, width: int | None = None) -> Column:
    """Reply and forward prefixes removed, lower case; whole, or cut to ``width`` letters."""
    bare = F.trim(F.regexp_replace(F.lower(c), r"^(?:(?:re|fwd|fw):\s*)+", ""))
    return bare if width is None else F.substring(bare, 1, width)


# -- lines, previews, lists ---------------------------------------------------------------------


def clean_lines(c: Column, patterns: list[str] = ocr.CHROME_LINES) -> Column:
    """Drop blank lines and lines that are nothing but screen furniture."""
    furniture = "(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
    kept = F.filter(
        F.split(F.coalesce(c, F.lit("")), "\n"),
        lambda x: let(strip(x), lambda s: (s != "") & ~matches(s, furniture)),
    )
    return F.array_join(kept, "\n")


def dedup_ci(arr: Column) -> Column:
    """First spelling of each value, compared trimmed and without case; one-letter values go."""
    def first(trimmed: Column, keys: Column) -> Column:
        wanted = F.filter(F.array_distinct(keys), lambda k: F.length(k) > 1)
        return F.transform(wanted, lambda k: F.get(trimmed, F.array_position(keys, k).cast("int") - 1))

    # bound to names: what finds the values runs once a text, not once more for each of them
    return let(F.transform(arr, strip), lambda trimmed: let(F.transform(trimmed, F.lower), lambda keys: first(trimmed, keys)))


def preview(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def one_line_preview(c: Column, n: int = 120) -> Column:
    """Table-safe preview of a text."""
    head = F.trim(F.translate(F.substring(c, 1, n), "\n|", " /"))
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head)


def paragraphs(c: Column) -> Column:
    """Array of (is_heading, text): a short line without closing punctuation is a heading."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            ((F.length(x) < 80) & ~matches(x, "[.\"']$")).alias("is_heading"), x.alias("text")
        ),
    )


def search_query(c: Column) -> Column:
    """Query text on a saved result page."""
    return F.nullif(strip(F.regexp_extract(c, ocr.SEARCH_QUERY, 1)), F.lit(""))


def find_year(link_text: Column, context: Column) -> Column:
    year = r"(20\d{2}|19\d{2})"
    return F.coalesce(extract(link_text, year), extract(context, year), F.lit("unknown"))


def word_overlap(a: Column, b: Column, min_len: int = 5) -> Column:
    """Number of distinct words of at least ``min_len`` letters both texts share."""
    def words(c: Column) -> Column:
        return F.array_distinct(all_matches(F.lower(c), r"\w+"))
    return F.size(F.filter(F.array_intersect(words(a), words(b)), lambda w: F.length(w) >= min_len))


def set_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def minus_noise(a: Column, noise: list[str]) -> Column:
    return F.array_except(a, F.array(*[F.lit(x) for x in noise]))


# -- addresses of pages -------------------------------------------------------------------------


def url_domain(c: Column) -> Column:
    """Host of a link as written, without scheme and ``www.``; NULL when it is no host."""
    bare = F.regexp_replace(c, r"^https?://(www\.)?", "")
    host = F.lower(F.substring_index(F.substring_index(bare, "/", 1), "?", 1))
    return F.when(F.contains(host, F.lit(".")) & (F.length(host) > 4), host)


def link_host(url: Column) -> Column:
    return F.replace(extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"), F.lit("www."), F.lit(""))


def absolute_url(src: Column, page: Column) -> Column:
    """Full address of an image: archive prefix unwrapped, protocol and root made explicit."""
    from hearthbook.rulesets.files import ARCHIVE_PREFIX

    root = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(matches(src, ARCHIVE_PREFIX), F.regexp_extract(src, ARCHIVE_PREFIX, 1))
        .when(matches(src, "^(https?://|data:)"), src)
        .when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src))
        .when(F.startswith(src, F.lit("/")), F.concat(root, src))
        .otherwise(src)
    )


def is_ad_image(src: Column, width: Column, height: Column, parts: list[str] | None = None) -> Column:
    """Advertising, tracking, tiny or inline image."""
    from hearthbook.rulesets.files import AD_IMAGE_PARTS, MIN_IMAGE_SIDE

    w = F.replace(width, F.lit("px"), F.lit("")).try_cast("int")
    h = F.replace(height, F.lit("px"), F.lit("")).try_cast("int")
    tiny = (w.isNotNull() & h.isNotNull()) & ((w < MIN_IMAGE_SIDE) | (h < MIN_IMAGE_SIDE))
    return (
        contains_any(F.lower(src), list(parts or AD_IMAGE_PARTS))
        | F.coalesce(tiny, F.lit(False))
        | F.startswith(src, F.lit("data:"))
    )


def is_video_url(url: Column) -> Column:
    from hearthbook.rulesets.files import VIDEO_DOMAINS

    return F.coalesce(contains_any(link_host(url), VIDEO_DOMAINS), F.lit(False))


def is_error_page(title: Column) -> Column:
    return F.coalesce(matches(F.lower(title), "404|not found|error"), F.lit(False))


def min_length(c: Column, n: int) -> Column:
    return F.length(strip(c)) >= n


def split_byline(c: Column) -> Column:
    """Struct of author and date from ``By Name · date``."""
    parts = F.split(c, r"\s*[·•]\s*")
    author = F.trim(F.regexp_replace(F.trim(F.get(parts, F.lit(0))), r"(?i)^By\s+", ""))
    return F.struct(author.alias("author"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("date"))


def wikilink(c: Column, names: Column) -> Column:
    """Wrap every known name in the text in double brackets."""
    return F.aggregate(
        names, c, lambda acc, n: F.replace(acc, n, F.concat(F.lit("[["), n, F.lit("]]")))
    )


def yaml_list(arr: Column) -> Column:
    """Inline YAML list with quoted items."""
    quoted = F.transform(
        arr, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def frontmatter(fields: dict[str, Column]) -> Column:
    rows = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *rows, F.lit("---"))
