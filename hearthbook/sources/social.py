"""Social archive pages and rendered thread notes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthbook.functions.text import strip
from hearthbook.sources import html as h

COMMENT = "array<struct<author:string,content:string,time:string>>"


def clean(n: h.Node | None) -> str:
    return re.sub(r"[ \t]+", " ", n.text(" ").replace("\xa0", " ")).strip() if n else ""


def stamp(n: h.Node | None) -> datetime | None:
    iso = n.attrs.get("title", "") if n else ""
    try:
        when = datetime.fromisoformat(iso.replace("+0000", "+00:00"))
    except ValueError:
        return None
    return when.replace(tzinfo=None)


def author_of(n: h.Node) -> str:
    found = n.find(h.has_class("fn", "span"))
    return clean(found) if found else "Unknown"


def comments_of(n: h.Node) -> list[dict]:
    block = n.find(h.has_class("comments", "div"))
    if block is None:
        return []
    return [
        {"author": author_of(c), "content": clean(c.find(h.has_class("entry-content", "span"))),
         "time": clean(c.find(h.has_class("time", "abbr")))}
        for c in block.find_all(h.has_class("comment", "div"))
    ]


MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
APART = {"p", "div", "table", "tr", "ul", "li", "blockquote"}


def spelled(part: h.Node | None) -> str:
    """Markdown of any part of a page: links, emphasis and line breaks stay, blocks stand apart."""
    def say(n: h.Node) -> str:
        if n.tag is None:
            return re.sub(r"\s+", " ", n.data)
        if n.tag == "br":
            return "\n"
        words = "".join(map(say, n.children))
        bare, mark, href = words.strip(), MARKS.get(n.tag), n.attrs.get("href") if n.tag == "a" else None
        if href:
            return f"[{bare or href}]({href})"
        if mark and bare:
            return f"{mark}{bare}{mark}"
        return f"\n\n{bare}\n\n" if n.tag in APART else words

    words = re.sub(r"[ \t]*\n[ \t]*", "\n", say(part)) if part is not None else ""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", words)).strip()


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Pieces of the pages that start at ``mark``: one big page still feeds many tasks."""
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.concat(F.lit(mark), "value").alias("html"), F.col("_metadata.file_path").alias("file"))


def _parsed(records: DataFrame, schema: str, row: Callable[[h.Node], dict | None]) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in re.split(r", (?=\w+ )", schema)]

    def run(frames):
        for pdf in frames:
            out = []
            for text, file in zip(pdf["html"], pdf["file"]):
                root = h.parse(text)
                got = row(root)
                if got is not None:
                    out.append({**got, "file": file})
            yield pd.DataFrame(out, columns=[*names, "file"])

    return records.mapInPandas(run, f"{schema}, file string")


def read_social_wall(spark: SparkSession, path: str) -> DataFrame:
    """Wall posts with nested comments."""
    def row(root):
        entry = root.find(h.has_class("feedentry", "div"))
        if entry is None:
            return None
        when = entry.find(h.has_class("time", "abbr"))
        return {"author": author_of(entry), "content": spelled(entry.find(h.has_class("entry-content", "span"))),
                "ts": stamp(when), "time_display": clean(when), "comments": comments_of(entry)}
    return _parsed(_records(spark, path, '<div class="feedentry'),
                   f"author string, content string, ts timestamp_ntz, time_display string, comments {COMMENT}", row)


def read_social_messages(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """Messages with their thread: participants without the owner, in time order by ``pos``."""
    def row(root):
        thread = root.find(h.has_class("thread", "div"))
        if thread is None:
            return None
        said = []
        for m in thread.find_all(h.has_class("message", "div")):
            when = m.find(h.has_class("time", "abbr"))
            body = m.find(h.has_class("msgbody", "div"))
            said.append({"author": author_of(m), "ts": stamp(when), "time_display": clean(when),
                         "body": body.text("\n").replace("\xa0", " ") if body else ""})
        if not said:
            return None
        people = sorted({m["author"] for m in said} - {owner, "Unknown"})
        said.sort(key=lambda m: m["ts"] or datetime.min)
        return {"participants": people, "name": ", ".join(people) or "Unknown", "messages": said}
    message = "array<struct<author:string,ts:timestamp_ntz,time_display:string,body:string>>"
    threads = _parsed(_records(spark, path, '<div class="thread"'), f"participants array<string>, name string, messages {message}", row)
    threads = threads.withColumn("thread_id", F.md5(F.to_json(F.struct("file", "name", "messages"))))
    return threads.select("thread_id", "participants", "name", F.posexplode("messages").alias("pos", "m")).select(
        "thread_id", "participants", "name", "pos", "m.author", "m.ts", "m.time_display", "m.body")


def read_social_notes(spark: SparkSession, path: str) -> DataFrame:
    def row(root):
        note = root.find(h.has_class("note", "div"))
        if note is None:
            return None
        title = note.find(h.has_class("entry-title", "h2"))
        when = next((c for c in note.children if c.tag == "abbr" and "time" in c.classes()), None)
        when = when or note.find(h.has_class("time", "abbr"))
        comments = comments_of(note)
        body = note.find(h.has_class("notebody", "div"))
        if body is None:
            block = note.find(h.has_class("comments", "div"))
            if block is not None:
                block.drop()
        return {"title": clean(title) if title else "Untitled", "ts": stamp(when),
                "body": spelled(body) if body else clean(note), "comments": comments}
    return _parsed(_records(spark, path, '<div class="note"'), f"title string, ts timestamp_ntz, body string, comments {COMMENT}", row)


# A place as it stands behind a line break: words, perhaps with empty brackets at the end.
PLACE = re.compile(r"^(\w\w.*?\w)\W*?\s*(?:\(\))?$", re.S)


def read_social_events(spark: SparkSession, path: str) -> DataFrame:
    def places(n: h.Node, skipped: h.Node | None) -> Iterator[str]:
        """Texts that directly follow a line break, outside the description."""
        for c, then in zip(n.children, [*n.children[1:], None]):
            if c.tag == "br" and then is not None and then.tag is None:
                yield then.data.strip()
            elif c.tag and c is not skipped:
                yield from places(c, skipped)

    def row(root):
        ev = root.find(h.has_class("event", "div"))
        if ev is None:
            return None
        named = {k: ev.find(t) for k, t in {"title": h.is_tag("h2"), "host": h.has_class("fn", "span"), "page": h.has_class("page", "span"),
                                            "text": h.has_class("description", "div")}.items()}
        host = named["host"] or named["page"]
        found = next((m.group(1) for t in places(ev, named["text"]) if (m := PLACE.match(t))), "")
        return {"title": clean(named["title"]) if named["title"] else "Untitled Event", "host": clean(host) if host else "Unknown",
                "description": named["text"].text("\n\n") if named["text"] else "", "location": found}
    return _parsed(_records(spark, path, '<div class="event"'), "title string, host string, description string, location string", row)


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("file"))


def read_social_friends(spark: SparkSession, path: str) -> DataFrame:
    """Names on a friends page."""
    def row(root):
        return {"names": [clean(n) for n in root.find_all(h.has_class("fn", "span"))]}
    return _parsed(_pages(spark, path), "names array<string>", row).select("file", F.posexplode("names").alias("pos", "name"))


def read_social_albums(spark: SparkSession, path: str) -> DataFrame:
    """Albums with their photos; the file name names an album without a heading."""
    photo = "array<struct<src:string,ts:timestamp_ntz,time_display:string,caption:string>>"

    def row(root):
        title = root.find(h.is_tag("h2"))
        photos = []
        for p in root.find_all(h.has_class("photo-container", "div")):
            img, when = p.find(h.has_class("photo", "img")), p.find(h.has_class("time", "abbr"))
            caption = " ".join(t for t in (c.data.strip() for c in p.children if c.tag is None) if t)
            photos.append({"src": img.attrs.get("src", "") if img else "", "ts": stamp(when),
                           "time_display": clean(when), "caption": caption})
        return {"title": clean(title) if title else None, "photos": photos}
    albums = _parsed(_pages(spark, path), f"title string, photos {photo}", row)
    file = F.substring_index("file", "/", -1)
    fallback = F.try_url_decode(F.try_url_decode(F.regexp_extract(file, r"^album-(.*)\.html$", 1)))
    return albums.select(F.coalesce("title", fallback).alias("name"), file.alias("filename"), F.size("photos").alias("photo_count"), "photos")


def read_social_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile fields, family members and page lists."""
    lists = ("Activities", "Interests", "Other")

    def row(root):
        fields, family, pages = {}, [], {}
        for tr in root.find_all(h.is_tag("tr")):
            label_td = tr.find(h.has_class("profile_label", "td"))
            if label_td is None:
                continue
            cells = [c for c in label_td.parent.children if c.tag == "td"]
            rest = cells[cells.index(label_td) + 1:]
            if not rest:
                continue
            label, value = clean(label_td).rstrip(":"), rest[0]
            if label == "Family":
                for fn in value.find_all(h.has_class("fn", "span")):
                    after = fn.parent.children[fn.parent.children.index(fn) + 1:][:1]
                    rel = after[0].data.strip().strip("()") if after and after[0].tag is None else ""
                    family.append({"name": clean(fn), "relationship": rel})
            elif label in lists:
                pages[label] = [clean(p) for p in value.find_all(h.has_class("page", "span"))]
            else:
                fields[label] = clean(value)
        return {"fields": fields, "family": family, "pages": pages}
    return _parsed(_pages(spark, path), "fields map<string,string>, family array<struct<name:string,relationship:string>>, "
                   "pages map<string,array<string>>", row)


def read_message_notes(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """Rendered thread notes: participants, count, dates and both sides' messages."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---", "")
    said = r"(?s)\*\*(?:\[\[)?(.+?)(?:\]\])?\*\* \([^\n]*?\):\n> (.+?)(?=\n\n|\n\*\*|\z)"
    people = F.split(F.regexp_extract(front, r"participants:\s*\[(.+?)\]", 1), ",")
    staged = files.filter(F.regexp_like("value", F.lit(r"(?s)\A---\n.*?\n---"))).select(
        "path", body.alias("body"),
        F.filter(F.transform(people, lambda p: F.btrim(p, F.lit(" \"'"))), lambda p: p != "").alias("participants"),
        F.coalesce(F.regexp_extract(front, r"message_count:\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("message_count"))
    pairs = F.zip_with(F.regexp_extract_all("body", F.lit(said), F.lit(1)), F.regexp_extract_all("body", F.lit(said), F.lit(2)),
                       lambda a, t: F.struct(a.alias("author"), strip(t).alias("text")))
    dates = F.regexp_extract_all("body", F.lit(r"## (\w+ \d+, \d{4})"), F.lit(1))
    out = staged.withColumn("_said", pairs).withColumn("_dates", dates)

    def side(own: bool):
        return F.transform(F.filter("_said", lambda x: (x["author"] == owner) if own else (x["author"] != owner)), lambda x: x["text"])
    return out.select(
        "path", "participants", "message_count", "body", F.get("_dates", F.lit(0)).alias("first_date"),
        F.when(F.size("_dates") > 0, F.element_at("_dates", -1)).alias("last_date"), side(True).alias("owner_messages"), side(False).alias("other_messages"))


