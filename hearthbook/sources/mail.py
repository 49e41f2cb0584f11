"""Mailboxes, contact lists, address books, CRM tables, contact bundles and enrichment results."""

from __future__ import annotations

import email
import email.header
import email.utils
import hashlib
import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthbook.functions.dates import mail_date
from hearthbook.functions.text import blank_to_null, html_to_text
from hearthbook.rulesets import mail as rm

PERSON = "struct<name:string,addr:string>"
MESSAGE = (
    "msg_id string, sender string, sender_name string, recipients array<struct<name:string,addr:string,header:string>>, "
    "date_header string, subject string, body_plain string, body_html string, list_unsub string, precedence string"
)
THREAD = "struct<date:string,subject:string,direction:string,body_snippet:string>"
BUNDLE = (
    "email string, display_names array<string>, total_emails long, emails_sampled long, emails_from long, emails_to long, "
    "emails_cc long, first_contact string, last_contact string, phones_from_sig array<string>, titles_from_sig array<string>, "
    f"unique_subjects array<string>, source_account string, threads array<{THREAD}>, _bad string"
)
RESULT = (
    "email string, role_title string, relationship_type string, relationship_summary string, key_topics array<string>, "
    "projects_in_common array<string>, notable_context string, communication_style string, error string"
)


def _decode(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str) and "=?" not in value:
        return value  # no encoded word: decoding gives the header as it is
    try:
        return str(email.header.make_header(email.header.decode_header(str(value))))
    except (LookupError, ValueError, email.errors.HeaderParseError):
        return str(value)


# Addresses without quotes, comments or routes: read by one pattern, all others by the parser of the standard library.
_ADDR = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
_ONE = rf"(?:([A-Za-z0-9]+(?: [A-Za-z0-9]+)*) <({_ADDR})>|({_ADDR}))"
_EACH, _ALL = re.compile(_ONE), re.compile(rf"{_ONE}(?:,[ \n]*{_ONE})*")


def _addresses(text: str) -> list[tuple[str, str]]:
    if _ALL.fullmatch(text):
        return [(m[1] or "", m[2] or m[3]) for m in _EACH.finditer(text)]
    return email.utils.getaddresses([text])


def _sender(text: str) -> tuple[str, str]:
    m = _EACH.fullmatch(text)
    return (m[1] or "", m[2] or m[3]) if m else email.utils.parseaddr(text)


def _people(value, header: str) -> list[dict]:
    out = []
    text = _decode(value)
    for name, addr in _addresses(text) if text else ():
        if addr:
            out.append({"name": name.strip(), "addr": addr.lower().strip(), "header": header})
    return out


def _part(msg, kind: str) -> str | None:
    """First non-empty part of a content type, decoded."""
    for part in msg.walk():
        if part.get_content_type() == kind:
            payload = part.get_payload(decode=True)
            if payload:
                try:
                    return payload.decode(part.get_content_charset() or "utf-8", "replace")
                except LookupError:
                    return payload.decode("utf-8", "replace")
    return None


def _message(raw: str) -> dict:
    text = raw[5:] if raw.startswith("From ") else raw
    head, _, rest = text.partition("\n")
    msg = email.message_from_string(rest if ":" not in head.split(" ")[0] else text)
    name, addr = _sender(_decode(msg.get("From")))
    plain = _part(msg, "text/plain")
    return {
        "msg_id": hashlib.md5(((msg.get("Message-ID") or "") + raw).encode("utf-8", "replace")).hexdigest(),
        "sender": addr.lower().strip(), "sender_name": name,
        "recipients": _people(msg.get("To"), "to") + _people(msg.get("Cc"), "cc"),
        "date_header": _decode(msg.get("Date")), "subject": _decode(msg.get("Subject")),
        "body_plain": plain, "body_html": None if plain else _part(msg, "text/html"),
        "list_unsub": msg.get("List-Unsubscribe"), "precedence": msg.get("Precedence"),
    }


def read_mbox(spark: SparkSession, path: str, account: str = "", max_chars: int | None = None) -> DataFrame:
    """One row per message. The file is split at message starts, so one mailbox feeds many tasks.

    Tasks decode MIME; tag removal and date parsing stay column expressions. ``max_chars`` cuts
    bodies; by default they are whole.
    """
    raw = spark.read.option("lineSep", "\nFrom ").text(path).filter(F.length(F.trim("value")) > 0)

    schema = to_arrow_schema(T._parse_datatype_string(MESSAGE))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_message(v) for v in batch.column(0).to_pylist()], schema=schema)

    parsed = raw.select("value").mapInArrow(run, MESSAGE)
    body = F.coalesce("body_plain", html_to_text(F.col("body_html")), F.lit(""))
    whole = body if max_chars is None else F.substring(body, 1, max_chars)
    return parsed.select(
        "msg_id", "sender", "sender_name", "recipients", mail_date(F.col("date_header")).alias("ts"), "subject",
        whole.alias("body"), "list_unsub", "precedence", F.lit(account).alias("account"))


# -- contact lists ------------------------------------------------------------------------------


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place: file, start of the block in it, order inside the block."""
    return rows.withColumn("_at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a contact list."""
    return _csv(spark, path).select(F.lower(F.trim("email")).alias("email")).filter(F.col("email").isNotNull())


def read_vcf_emails(spark: SparkSession, path: str) -> DataFrame:
    """Addresses on the e-mail lines of a card file."""
    lines = spark.read.text(path).filter(F.startswith(F.upper("value"), F.lit("EMAIL")) & F.contains("value", F.lit(":")))
    addr = F.lower(F.trim(F.substring_index(F.trim("value"), ":", -1)))
    return lines.select(addr.alias("email")).filter(F.contains("email", F.lit("@")) & (F.length("email") > 5))


def _last_per_email(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Later rows of a file win, and rows of files later by name."""
    return df.groupBy("email").agg(F.max(F.struct("_at", *columns)).alias("_r")).select("email", *[F.col(f"_r.{c}") for c in columns])


def read_address_book(spark: SparkSession, path: str) -> DataFrame:
    """One row per address of an address book with repeated e-mail columns."""
    rows = _placed(_csv(spark, path))
    names = [c for c in rm.ADDRESS_BOOK_EMAILS if c in rows.columns]
    first, last = (F.coalesce(F.trim(c), F.lit("")) for c in ("First Name", "Last Name"))
    fields = {"gc_name": F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))}
    for new, old in rm.ADDRESS_BOOK_FIELDS.items():
        fields[new] = blank_to_null(F.col(f"`{old}`")) if old in rows.columns else F.lit(None).cast("string")
    flat = rows.select("_at", *[c.alias(k) for k, c in fields.items()],
                       F.explode(F.array(*[F.lower(F.trim(F.col(f"`{c}`"))) for c in names])).alias("email"))
    return _last_per_email(flat.filter(F.coalesce("email", F.lit("")) != ""), list(fields))


def address_book_emails(spark: SparkSession, path: str) -> DataFrame:
    """Every address in any value column of an address book."""
    rows = _csv(spark, path)
    names = [c for c in rows.columns if "mail" in c.lower() and "value" in c.lower()]
    long = rows.select(F.explode(F.array(*[F.lower(F.trim(F.col(f"`{c}`"))) for c in names])).alias("email"))
    return long.filter(F.contains("email", F.lit("@")) & (F.length("email") > 5))


def read_crm(spark: SparkSession, path: str) -> DataFrame:
    """CRM rows by address, blanks as NULL."""
    rows = _placed(_csv(spark, path))
    fields = {new: blank_to_null(F.col(f"`{old}`")) if old in rows.columns else F.lit(None).cast("string")
              for new, old in rm.CRM_FIELDS.items()}
    flat = rows.select("_at", F.lower(F.trim("Email")).alias("email"), *[c.alias(k) for k, c in fields.items()])
    return _last_per_email(flat.filter(F.coalesce("email", F.lit("")) != ""), list(fields))


# -- bundles and results ------------------------------------------------------------------------


def read_bundles(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Contact bundles of one or many folders; helper files, broken files and rows without address are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(BUNDLE).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_bad").json(paths)
    named = rows.withColumn("_file", F.col("_metadata.file_name"))
    helper = F.lit(False)
    for part in rm.NON_BUNDLE_PARTS:
        helper = helper | F.contains("_file", F.lit(part))
    return named.filter(~helper & F.col("_bad").isNull() & F.col("email").isNotNull()).drop("_bad", "_file")


def read_many(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_enrichments(spark: SparkSession, path: str) -> DataFrame:
    """Enrichment by address from result files that hold a list or a map; broken files are skipped, later files win."""
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    fields = RESULT.split(", ")
    listed = F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields)}>>")
    body = [f for f in fields if not f.startswith("email ")]
    keyed = F.from_json("value", f"map<string,struct<{', '.join(f.replace(' ', ':', 1) for f in body)}>>")
    names = [f.split(" ")[0] for f in body]
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    from_list = files.filter(is_list).select("_file", F.posexplode(listed).alias("_i", "_e")).select(
        "_file", "_i", F.lower(F.trim("_e.email")).alias("email"), *[F.col(f"_e.{n}").alias(n) for n in names])
    from_map = files.filter(~is_list).select("_file", F.explode(keyed).alias("_k", "_e")).select(
        "_file", F.lit(0).alias("_i"), F.lower(F.trim("_k")).alias("email"), *[F.col(f"_e.{n}").alias(n) for n in names])
    every = from_list.unionByName(from_map).filter(F.col("email").isNotNull())
    last = every.groupBy("email").agg(F.max(F.struct("_file", "_i", *names)).alias("_r"))
    return last.select("email", *[F.col(f"_r.{n}").alias(n) for n in names])
