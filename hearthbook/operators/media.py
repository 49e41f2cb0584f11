"""Media, drives, document placement, detections and candidate picking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import media as fm, scores as sc
from hearthbook.functions.dates import file_date, period_key
from hearthbook.functions.names import folder_safe
from hearthbook.operators.classify import keyword_class
from hearthbook.operators.dictionary import match_dictionaries
from hearthbook.operators.ordering import unique_destinations
from hearthbook.rulesets import files as fr


def with_category(media: DataFrame) -> DataFrame:
    return media.withColumn("category", fm.media_category(F.col("ext"), F.col("width"), F.col("height"), F.col("has_camera")))


def media_stats(media: DataFrame) -> DataFrame:
    """Files per category and month."""
    return media.groupBy("category", period_key(F.col("taken_at"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("files"))


def gps_coverage(media: DataFrame) -> DataFrame:
    return media.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.count("lat").alias("with_gps"))


def face_histogram(media: DataFrame) -> DataFrame:
    return media.groupBy("num_faces").agg(F.count(F.lit(1)).alias("images"))


def detection_severity(
    detections: DataFrame, threshold: float, image: str = "image_id",
    sensitive: Sequence[str] = tuple(fr.SENSITIVE_LABELS), high: Sequence[str] = tuple(fr.HIGH_CONCERN_LABELS),
) -> DataFrame:
    """Flagged images with severity and number of sensitive detections."""
    kept = detections.filter(F.col("label").isin(list(sensitive)) & (F.col("score") >= threshold))
    worst = F.max(F.when(F.col("label").isin(list(high)), 1).otherwise(0))
    return kept.groupBy(image).agg(
        F.when(worst == 1, "HIGH").otherwise("MODERATE").alias("severity"), F.count(F.lit(1)).alias("detections"))


def detection_stats(detections: DataFrame, threshold: float, sensitive: Sequence[str] = tuple(fr.SENSITIVE_LABELS)) -> DataFrame:
    kept = detections.filter(F.col("label").isin(list(sensitive)) & (F.col("score") >= threshold))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("detections"))


# -- drives -------------------------------------------------------------------------------------


def directory_plan(files: DataFrame, folder: str, kind: str, min_files: int = 8, min_types: int = 2,
                   skip: Sequence[str] = tuple(fr.TYPE_FOLDER_NAMES)) -> DataFrame:
    """Folders and whether to split them by type.

    Counts per (folder, type) first, so one huge folder arrives as a few rows.
    """
    per_type = files.groupBy(folder, kind).agg(F.count(F.lit(1)).alias("n"))
    mixed = per_type.groupBy(folder).agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("types"))
    named = F.lower(F.substring_index(F.col(folder), "/", -1)).isin(list(skip))
    split = (F.col("files") >= min_files) & (F.col("types") >= min_types) & ~named
    return mixed.withColumn("split_by_type", split)


def flat_folder_plan(files: DataFrame, folder: str, min_files: int = 5) -> DataFrame:
    """Folders without sub-folders that hold enough files."""
    counted = files.groupBy(folder).agg(F.count(F.lit(1)).alias("files"))
    above = counted.select(fm.parent(F.col(folder)).alias(folder)).distinct()
    return counted.filter(F.col("files") >= min_files).join(above, folder, "left_anti")


def drive_destinations(files: DataFrame, plan: DataFrame, folder: str, kind: str) -> DataFrame:
    """Target folder of each file under a directory plan."""
    flags = plan.select(folder, "split_by_type")
    split = F.concat_ws("/", F.col(folder), F.col(kind))
    return files.join(flags, folder, "left").withColumn(
        "dest_dir", F.when(F.col("split_by_type"), split).otherwise(F.col(folder)))


# -- projects and placement ---------------------------------------------------------------------


def project_tokens(files: DataFrame, file_id: str, stem: Column, top: Column, lo: int = 3, hi: int = 12) -> DataFrame:
    """(file, token) with the best project token of each file.

    A token names a project when it is alphabetic, long enough, occurs ``lo`` to ``hi`` times and in
    two top folders. Counting stops mattering above ``hi``, and only partial counts are shuffled.
    """
    tokens = files.select(F.col(file_id), top.alias("_top"), F.posexplode(fm.name_tokens(stem)).alias("_at", "token"))
    per_top = tokens.groupBy("token", "_top").agg(F.count(F.lit(1)).alias("n"))
    good = per_top.groupBy("token").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("tops")).filter(
        F.col("uses").between(lo, hi) & (F.col("tops") >= 2)
        & (F.length("token") >= 5) & F.regexp_like("token", F.lit("^[a-z]+$")))
    ranked = tokens.join(good, "token").groupBy(file_id).agg(
        F.min(F.struct((-F.col("uses")).alias("u"), "_at", "token")).alias("_b"))
    return ranked.select(file_id, F.initcap("_b.token").alias("project"), (-F.col("_b.u")).alias("uses"))


def name_dictionary(entities: DataFrame) -> DataFrame:
    """Lower-case key and display name per known name."""
    return entities.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("display"))


def place(
    files: DataFrame, known: DataFrame, people: DataFrame, companies: DataFrame, root: str = "", min_score: float = 2.0
) -> DataFrame:
    """Target folder of every file: known folder, project folder, project token, content, category, type.

    ``files``: path, text, mod_time. Dictionaries have key and display. All lookups are one
    pass and one join; the cascade is one ``coalesce``.
    """
    path = F.col("path")
    stem = sc.stem_of(fm.file_name(path))
    base = (
        files.withColumn("_parts", fm.folder_context(path, root))
        .withColumn("_hint", F.array_join("_parts", " "))
        .withColumn("_folder", fm.folder_project(F.col("_parts")))
        .withColumn("_type", fm.file_type(sc.extension_of(fm.file_name(path))))
        .withColumn("_month", period_key(file_date(stem, F.col("mod_time")), "month"))
        .withColumn("_stem", stem)
    )
    media = F.col("_type").isin(fr.MEDIA_TYPES)
    body = F.when(media, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    content = F.concat_ws(" ", F.col("_hint"), F.col("_stem"), body)

    top = F.coalesce(F.get(fm.folder_parts(path, root), F.lit(0)), F.lit(""))
    tokens = project_tokens(base, "path", F.col("_stem"), top).select("path", "project")
    # all dictionaries are looked up in one pass over the texts, which are read beside them and never shuffled
    names = match_dictionaries(base, "path", {"hint": F.col("_hint"), "folder": F.col("_folder"), "content": content}, {
        "_known_folder": ("hint", known, 4), "_person_folder": ("folder", people, 1), "_company_folder": ("folder", companies, 1),
        "_known_text": ("content", known, 4), "_person_text": ("content", people, 1), "_company_text": ("content", companies, 1)})
    scored = keyword_class(base, content, F.col("_type"), min_score=min_score).join(tokens, "path", "left").join(names, "path", "left")

    def target(kind: str, name: Column, sub: Column | None = None) -> Column:
        parts = [F.lit(kind), name] + ([F.nullif(sub, F.lit(""))] if sub is not None else [])
        return F.when(name.isNotNull(), F.concat_ws("/", *parts))

    own_folder = (F.col("_folder") != "") & F.col("project").isNull()
    below = fm.sub_path(path, F.col("_folder"), root)
    underscored = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    by_category = F.when(media, F.concat_ws("/", "_type", "_month")).otherwise(F.concat_ws("/", "category", "_month"))
    dest = F.coalesce(
        target("Projects", underscored(F.col("_known_folder")), fm.sub_path(path, F.col("_known_folder"), root)),
        F.when(own_folder, F.coalesce(
            target("People", folder_safe(F.col("_person_folder")), below),
            target("Companies", folder_safe(F.col("_company_folder")), below),
            target("Projects", underscored(F.col("_folder")), below))),
        target("Projects", F.col("project")),
        target("Projects", underscored(F.col("_known_text")), fm.sub_path(path, F.lit(""), root)),
        target("People", folder_safe(F.col("_person_text"))),
        target("Companies", folder_safe(F.col("_company_text"))),
        by_category,
    )
    out = scored.withColumn("dest_dir", dest).withColumn("name", fm.file_name(path))
    return out.select(*files.columns, "name", "dest_dir")


def placement_manifest(placed: DataFrame, order: Sequence[Column], slice_by: Column, path: str = "path") -> DataFrame:
    """(source, destination) with collision-free names."""
    named = unique_destinations(placed, "dest_dir", "name", order, slice_by)
    return named.select(F.col(path).alias("source"), F.concat_ws("/", "dest_dir", "dest_name").alias("destination"))


# -- picking ------------------------------------------------------------------------------------


def hero_candidates(files: DataFrame) -> DataFrame:
    """Image candidates with their score. ``files``: work, folder (inside the work), name, size."""
    kept = files.filter(sc.hero_candidates_filter(F.col("name"), F.coalesce("folder", F.lit(""))))
    score = sc.hero_score(F.col("name"), sc.work_title(F.substring_index("work", "/", -1)), F.col("size"))
    return kept.withColumn("score", score + sc.path_bias(F.coalesce("folder", F.lit("")))).withColumn(
        "renderable", sc.extension_of(F.col("name")).isin(fr.PICK_RENDERABLE))


def apply_selections(selections: DataFrame, works: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every work or choice: picked, skipped, unknown_work, missing_file or pending."""
    s = selections.select("work_id", "choice").withColumn("_s", F.lit(True))
    w = works.select("work_id").withColumn("_w", F.lit(True))
    there = files.select("work_id", F.col("filename").alias("choice")).distinct().withColumn("_f", F.lit(True))
    joined = s.join(w, "work_id", "full_outer").join(there, ["work_id", "choice"], "left")
    status = (
        F.when(F.col("choice") == fr.SKIP_CHOICE, "skipped")
        .when(F.col("_s").isNull(), "pending")
        .when(F.col("_w").isNull(), "unknown_work")
        .when(F.col("_f").isNull(), "missing_file")
        .otherwise("picked")
    )
    return joined.select("work_id", "choice", status.alias("status"))


def selection_stats(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("works"))
