"""Chat exports, OCR texts, media listings, notes, rule files, selections and dictionaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hearthbook.functions.media import png_size
from hearthbook.functions.scores import extension_of, stem_of
from hearthbook.functions.text import strip
from hearthbook.session import materialise
from hearthbook.sources.json_array import json_elements

CHAT = (
    "title string, create_time double, update_time double, current_node string, mapping map<string,struct<id:string,"
    "parent:string,children:array<string>,message:struct<author:struct<role:string>,create_time:double,"
    "content:struct<content_type:string,parts:array<string>>>>>"
)


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with their node map. Structured parts become their text. One big array is read by many tasks."""
    rows = json_elements(spark, path).select(F.from_json("value", CHAT).alias("c")).select("c.*")

    def plain(part: Column) -> Column:
        kind = F.get_json_object(part, "$.content_type")
        is_object = F.startswith(part, F.lit("{")) & kind.isNotNull()
        return F.when(is_object, F.when(kind == "text", F.get_json_object(part, "$.text")).otherwise("")).otherwise(part)

    def node(_: Column, n: Column) -> Column:
        m = n["message"]
        parts = F.transform(m["content"]["parts"], plain)
        content = F.struct(m["content"]["content_type"].alias("content_type"), parts.alias("parts"))
        message = F.when(m.isNotNull(), F.struct(m["author"].alias("author"), m["create_time"].alias("create_time"), content.alias("content")))
        return F.struct(n["parent"].alias("parent"), message.alias("message"))

    return rows.withColumn("mapping", F.transform_values("mapping", node))


def _path() -> Column:
    return F.col("_metadata.file_path")


def read_ocr_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts laid out as category/month/stem.txt; the folders become columns."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    part = lambda i: F.try_url_decode(F.regexp_extract("_p", r"([^/]+)/([^/]+)/([^/]+)\.txt$", i))
    return rows.withColumn("_p", _path()).select(
        part(3).alias("stem"), part(2).alias("month"), part(1).alias("old_category"), F.col("value").alias("text"))


LISTED = "path string, is_folder boolean, length long, mod_time timestamp"


@functools.lru_cache(maxsize=16)
def _system(scheme: str, place: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), "") if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{place}/")


def _opened(path: str):
    """File system and path in it, as a task opens them; the path is taken as written."""
    scheme, place, inside = re.match(r"(?:([A-Za-z][\w+.-]*):(?://([^/]*))?)?(.*)", path, re.S).groups()
    system, root = _system(scheme or "file", place or "")
    return system, root.rstrip("/") + inside


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, without names that Spark's readers hide."""
    from pyarrow import fs

    kinds = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("mod_time", pa.timestamp("us", "UTC"))])
    for b in batches:
        for folder in b.column(0).to_pylist():
            system, inside = _opened(folder)
            found = system.get_file_info(fs.FileSelector(inside))
            for at in range(0, len(found), 10_000):
                part = [i for i in found[at:at + 10_000] if i.type in (fs.FileType.File, fs.FileType.Directory) and not (i.base_name.startswith(".") or i.base_name.startswith("_") and "=" not in i.base_name)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in part], pa.string()), pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_()),
                    pa.array([i.size or 0 for i in part], pa.int64()), pa.array([i.mtime for i in part], pa.timestamp("us", "UTC"))], schema=kinds)


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first bytes of the files marked to be opened, beside the listing."""
    for b in batches:
        heads = []
        for path, wanted in zip(b.column("path").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            if wanted:
                system, inside = _opened(path)
                with system.open_input_file(inside) as file:
                    heads.append(file.read(24))
            else:
                heads.append(None)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(heads, pa.binary())], names=[*b.schema.names[:-1], "head"])


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, mod_time) of the files below a folder: tasks list one level of folders after the other.

    The driver holds neither files nor folders, however many there are.
    """
    folders, levels = spark.createDataFrame([(path,)], "path string"), []
    while True:
        seen = materialise(folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_list_folders, LISTED), "listing")
        levels.append(seen.filter("not is_folder").drop("is_folder"))
        folders = seen.filter("is_folder").select("path")
        if not recursive or folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def list_media(spark: SparkSession, path: str, recursive: bool = True, with_size: bool = False,
               skip_folders: Sequence[str] = ()) -> DataFrame:
    """Files with extension, length and time. Only the heads of PNG files are read, and only where sizes are asked for."""
    name = F.substring_index("path", "/", -1)
    kept = list_files(spark, path, recursive).select(
        "path", name.alias("name"), extension_of(name).alias("ext"), stem_of(name).alias("stem"),
        "length", F.col("mod_time").cast("timestamp_ntz").alias("mod_time"))
    for folder in skip_folders:
        kept = kept.filter(~F.contains("path", F.lit(f"/{folder}/")))
    if not with_size:
        return kept.withColumn("width", F.lit(None).cast("int")).withColumn("height", F.lit(None).cast("int"))
    # files of one folder lie in one task's listing: their heads are read by all tasks
    marked = kept.withColumn("wanted", F.endswith(F.lower("name"), F.lit(".png"))).repartition(4 * spark.sparkContext.defaultParallelism)
    schema = T.StructType([*kept.schema.fields, T.StructField("head", T.BinaryType())])
    sized = marked.mapInArrow(_read_heads, schema).withColumn("_s", png_size(F.col("head")))
    return sized.withColumn("width", F.col("_s.width")).withColumn("height", F.col("_s.height")).drop("_s", "head")


def read_selections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(selections, works) of a picker export."""
    schema = "selections map<string,string>, works array<struct<id:string,rel_path:string,candidates:array<struct<filename:string,bytes:bigint>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    chosen = rows.select(F.explode("selections").alias("work_id", "choice"))
    works = rows.select(F.explode("works").alias("w")).select(F.col("w.id").alias("work_id"), "w.rel_path", "w.candidates")
    return chosen, works


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Pattern and category per line, split at the last bar; comments and blank lines are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")) & F.contains("value", F.lit("|")))
    return lines.select(F.regexp_extract("value", r"^(.*)\|[^|]*$", 1).alias("pattern"), F.substring_index("value", "|", -1).alias("category"))


# -- notes --------------------------------------------------------------------------------------

FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"


def frontmatter_map(text: Column) -> Column:
    """Scalar fields of the frontmatter."""
    lines = F.filter(F.split(F.regexp_extract(text, FRONT, 1), "\n"), lambda x: F.regexp_like(x, F.lit(r"^[A-Za-z_][\w-]*:")))
    pairs = F.transform(lines, lambda x: F.struct(
        F.substring_index(x, ":", 1).alias("k"), F.btrim(F.regexp_replace(x, r"^[^:]*:\s*", ""), F.lit(" \"'")).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, F.greatest(i, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def read_notes(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Notes with path below ``root``, title, frontmatter and body."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    full = F.try_url_decode(F.regexp_replace(_path(), r"\+", "%2B"))
    below = F.substring_index(full, root.rstrip("/") + "/", -1)
    staged = rows.withColumn("path", below).withColumn("fm", frontmatter_map(F.col("value")))
    field = lambda k: F.coalesce(F.try_element_at("fm", F.lit(k)), F.lit(""))
    return staged.select(
        "path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("title"), field("type").alias("type"),
        field("status").alias("status"), F.try_to_timestamp(field("last_updated"), F.lit("yyyy-MM-dd")).cast("date").alias("last_updated"),
        "fm", F.regexp_replace("value", FRONT, "").alias("body"), F.col("value").alias("content"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _aliases(front: pd.Series) -> pd.Series:
    try:
        import yaml
    except ImportError:
        yaml = None

    def one(text: str) -> list[str]:
        if not text or yaml is None:
            return []
        try:
            loaded = yaml.safe_load(text)
        except yaml.YAMLError:
            return []
        found = loaded.get("aliases") if isinstance(loaded, dict) else None
        if isinstance(found, str):
            return [found]
        return [str(a) for a in found if a] if isinstance(found, list) else []
    return front.map(one)


def read_people_notes(spark: SparkSession, path: str, root: str) -> DataFrame:
    """People pages with their aliases; unreadable frontmatter gives no aliases."""
    notes = read_notes(spark, path, root)
    return notes.select(F.col("title").alias("page"), "path", _aliases(F.regexp_extract("content", FRONT, 1)).alias("aliases"))


def page_names(people: DataFrame) -> DataFrame:
    """(page, name, rank): the page name first, then its aliases, pages in name order."""
    names = F.concat(F.array("page"), "aliases")
    return people.select("page", F.posexplode(names).alias("_i", "name")).withColumn("rank", F.struct("page", "_i")).drop("_i")


def bold_names(notes: DataFrame) -> DataFrame:
    """Names of bold list items in note bodies."""
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^- \*\*(.+?)\*\*"), F.lit(1)))
    return notes.select(found.alias("name")).select(F.regexp_replace(strip(F.col("name")), r"\s+", " ").alias("name"))


def read_name_dictionary(notes: DataFrame, prefix: str = "", strip_year: bool = False, min_len: int = 3) -> DataFrame:
    """Lower-case key and display name per file name, prefix or leading year removed."""
    name = F.regexp_replace("title", f"^{prefix}", "") if prefix else F.col("title")
    if strip_year:
        name = F.regexp_replace(name, r"^\d{4}\s*[-–—]\s*(?=.)", "")
    named = notes.select(F.btrim(name, F.lit(" -–—")).alias("display")).filter(F.length("display") >= min_len)
    return named.groupBy(F.lower("display").alias("key")).agg(F.min("display").alias("display"))


def read_since(df: DataFrame, ts: str, mark) -> DataFrame:
    """Rows above the high-water mark."""
    return df.filter(F.col(ts) > F.lit(mark)) if mark is not None else df
