"""Column functions for media files, paths and positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook.functions.text import matches
from hearthbook.rulesets import files


def type_lookup(table: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for kind, exts in table.items() for e in exts for x in (e, kind)]
    return F.create_map(*pairs)


def file_type(ext: Column, table: dict[str, list[str]] = files.DOCUMENT_TYPES, default: str = "Other") -> Column:
    return F.coalesce(F.try_element_at(type_lookup(table), F.lower(ext)), F.lit(default))


def png_size(content: Column) -> Column:
    """Struct of width and height from a PNG header, NULL for other bytes."""
    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png, F.struct(number(17).alias("width"), number(21).alias("height")))


def is_screenshot(ext: Column, width: Column, height: Column, has_camera: Column) -> Column:
    """Screen-sized image without camera data, or a phone-shaped PNG without camera data."""
    e = F.lower(ext)
    sizes = [f"{w}x{h}" for w, h in files.SCREEN_SIZES] + [f"{h}x{w}" for w, h in files.SCREEN_SIZES]
    known = F.concat_ws("x", width.cast("string"), height.cast("string")).isin(sizes)
    tall = (width > 700) & (height > 1200) & (height / width > 1.5) & (height / width < 2.5)
    wide = (height > 700) & (width > 1200) & (width / height > 1.5) & (width / height < 2.5)
    never = e.isin(".heic", ".heif") | e.isin(files.VIDEO_EXTENSIONS)
    seen = width.isNotNull() & height.isNotNull()
    return F.coalesce(
        ~never & seen & ~F.coalesce(has_camera, F.lit(False)) & (known | ((e == ".png") & (tall | wide))),
        F.lit(False),
    )


def media_category(ext: Column, width: Column, height: Column, has_camera: Column) -> Column:
    e = F.lower(ext)
    camera = F.coalesce(has_camera, F.lit(False))
    return (
        F.when(e.isin(files.VIDEO_EXTENSIONS), "Videos")
        .when(~e.isin(files.IMAGE_EXTENSIONS), "Other")
        .when(is_screenshot(ext, width, height, has_camera), "Screenshots")
        .when(e.isin(".heic", ".heif"), "Photos")
        .when(e.isin(".jpg", ".jpeg") & camera, "Photos")
        .when(e.isin(".jpg", ".jpeg", ".png"), "Saved_Images")
        .when(camera, "Photos")
        .otherwise("Other")
    )


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere to signed degrees."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def article_status(is_video: Column, has_shot: Column, has_html: Column) -> Column:
    return (
        F.when(is_video, "skipped").when(has_html, "done")
        .when(has_shot, "partial").otherwise("dead-link")
    )


# -- paths --------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1)))


def folder_parts(path: Column, root: str = "") -> Column:
    rel = relative_to(path, root) if root else path
    return F.filter(F.split(F.coalesce(parent(rel), F.lit("")), "/"), lambda p: p != "")


def folder_context(path: Column, root: str = "") -> Column:
    """Folders between the root and the file that mean something."""
    return F.filter(folder_parts(path, root), lambda p: ~F.lower(p).isin(files.GENERIC_FOLDERS))


def folder_project(parts: Column) -> Column:
    """First folder that is no date, no id and long enough, as a folder name; else empty."""
    uuid = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    real = F.filter(
        parts,
        lambda p: ~matches(p, r"^20\d{2}(-\d{2})?$") & (F.length(p) >= 3)
        & ~matches(p, uuid) & ~matches(p, r"^(user-)?[A-Za-z0-9]{20,}$"),
    )
    safe = F.transform(real, lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}_\s-]", "")))
    return F.coalesce(F.get(F.filter(safe, lambda s: s != ""), F.lit(0)), F.lit(""))


def sub_path(path: Column, project: Column, root: str = "") -> Column:
    """Folders below the one that names the project, else below the first meaningful one."""
    parts = folder_parts(path, root)
    wanted = F.lower(project)
    named = F.array_position(F.transform(parts, lambda p: F.contains(F.lower(p), wanted)), True)
    meant = F.array_position(F.transform(parts, lambda p: ~F.lower(p).isin(files.GENERIC_FOLDERS)), True)
    at = F.when(named > 0, named).otherwise(meant)
    below = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts), F.lit(1)))
    return F.when(at > 0, F.array_join(below, "/")).otherwise("")


def name_tokens(stem: Column) -> Column:
    """Meaningful tokens of a file name, dates and versions removed."""
    dates = F.regexp_replace(stem, r"20\d{2}[-_.]?\d{2}[-_.]?\d{0,2}", "")
    versions = F.regexp_replace(dates, r"(?i)\b(v\d+(\.\d+)?|rev\d+)\b", "")
    return F.filter(
        F.transform(F.split(versions, "[^a-zA-Z0-9]+"), F.lower),
        lambda t: (F.length(t) >= 4) & ~t.isin(files.IGNORED_TOKENS),
    )
