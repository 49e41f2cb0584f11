"""Rendered texts: briefs, person pages, notes, parsed model answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook.functions.text import preview, strip, yaml_list

ENRICHMENT = (
    "role_title string, relationship_type string, relationship_summary string, key_topics array<string>, "
    "projects_in_common array<string>, notable_context string, communication_style string"
)


def parse_response(c: Column, schema: str = ENRICHMENT) -> Column:
    """Struct of the answer's fields plus ``error`` and ``raw`` when it is no JSON object."""
    t = strip(c)
    fenced = F.startswith(t, F.lit("```"))
    opened = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substr(t, F.lit(4)))
    body = F.when(fenced, strip(F.regexp_replace(opened, "```$", ""))).otherwise(t)
    parsed = F.from_json(body, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = parsed.isNull() | parsed["_bad"].isNotNull()
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    return F.struct(
        *[F.when(~bad, parsed[n]).alias(n) for n in names],
        F.when(bad, "JSON parse error").alias("error"),
        F.when(bad, F.substring(body, 1, 200)).alias("raw"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def contact_brief(tier: str, subjects_shown: dict[str, int] | None = None) -> Column:
    """Text that introduces a contact to a reader: tier ``A`` with excerpts, ``B`` with subjects only."""
    shown = (subjects_shown or {"A": 15, "B": 10})[tier]
    subjects = F.slice(F.coalesce("unique_subjects", F.array().cast("array<string>")), 1, shown)
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    parts = [
        _line("Contact: ", F.coalesce(F.get("display_names", F.lit(0)), F.lit("Unknown"))),
        _line("Email: ", F.col("email")),
        _line("Organization: ", F.col("best_org")),
    ]
    if tier == "A":
        parts.append(_line("Title: ", F.col("best_title")))
    parts.append(_line("Total emails: ", F.col("total_emails")))
    if tier == "A":
        parts += [_line("Emails from them: ", F.col("emails_from")), _line("Emails to them: ", F.col("emails_to"))]
    parts.append(F.concat(F.lit("Date range: "), day("first_contact"), F.lit(" to "), day("last_contact")))
    listed = F.transform(subjects, lambda s: F.concat(F.lit("  - "), s))
    head = F.lit("\nSubject lines:")
    if tier == "A":
        head = F.format_string("\nSubject lines (%d of %d):", F.size(subjects), F.size("unique_subjects"))
    parts.append(F.when(F.size(subjects) > 0, F.concat_ws("\n", head, F.array_join(listed, "\n"))))
    if tier == "A":
        label = lambda t: F.when(t["direction"] == "from", "FROM them").when(
            t["direction"] == "to", "TO them").otherwise("CC")
        excerpt = F.transform("threads", lambda t: F.concat_ws(
            "\n",
            F.concat(F.lit("\n["), F.coalesce(t["date"].cast("string"), F.lit("?")), F.lit("] "), label(t),
                     F.lit(" — Subject: "), F.coalesce(t["subject"], F.lit("(no subject)"))),
            F.nullif(preview(F.coalesce(t["body_snippet"], F.lit("")), 800), F.lit(""))))
        count = F.format_string("\nEmail excerpts (%d sampled):", F.size("threads"))
        parts.append(F.when(F.size("threads") > 0, F.concat_ws("\n", count, F.array_join(excerpt, "\n"))))
    return F.concat_ws("\n", *parts)


def _interaction_rows(threads: Column) -> Column:
    side = lambda t: F.when(t["direction"] == "from", "Inbound").when(
        t["direction"] == "to", "Outbound").otherwise("CC")
    return F.array_join(F.transform(F.slice(threads, 1, 5), lambda t: F.concat(
        F.lit("| "), F.coalesce(F.date_format(t["date"], "yyyy-MM-dd"), F.lit("")), F.lit(" | "),
        F.substring(F.coalesce(t["subject"], F.lit("(no subject)")), 1, 60), F.lit(" | "), side(t), F.lit(" |"))), "\n")


def _range() -> Column:
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("?"))
    return F.concat(day("first_contact"), F.lit(" to "), day("last_contact"))


def person_page(today: str, source: str = "email archive") -> Column:
    """New person page from a contact row with enrichment columns and threads."""
    kind = F.coalesce(F.nullif("relationship_type", F.lit("")), F.lit("unknown"))
    role = F.nullif(F.coalesce("role_title", F.lit("")), F.lit(""))
    who = F.concat_ws(" ", F.concat(role, F.lit(".")),
                      F.when(kind != "unknown", F.concat(F.lit("Relationship type: "), kind, F.lit("."))))
    style = F.concat(F.lit("Communication style: "), F.nullif("communication_style", F.lit("")))
    relation = F.concat_ws("\n", F.nullif("relationship_summary", F.lit("")), F.nullif("notable_context", F.lit("")), style)
    projects = F.coalesce("projects_in_common", F.array().cast("array<string>"))
    has_projects = F.size(projects) > 0
    listed = F.array_join(F.transform(projects, lambda p: F.concat(F.lit("- [["), p, F.lit("]]"))), "\n")
    yaml = F.array_join(F.transform(projects, lambda p: F.concat(F.lit("\n  - "), p)), "")
    rows = _interaction_rows(F.col("threads"))
    return F.concat(
        F.lit(f"---\ntype: person\nstatus: working\nlast_updated: {today}\naliases:\n  - "), F.col("email"),
        F.lit("\nemail_contact: "), F.col("email"), F.lit("\nrelated_projects:"),
        F.when(has_projects, yaml).otherwise(" []"), F.lit("\n---\n\n# "), F.col("name"),
        F.lit("\n\n## Who they are\n"),
        F.when(who == "", f"Contact from {source}.").otherwise(who),
        F.lit("\n\n## Relationship\n"),
        F.when(relation == "", F.concat(F.initcap(kind), F.lit(f" relationship via {source}."))).otherwise(relation),
        F.lit("\n\n## Key interactions\n| Date | Context | Notes |\n|------|---------|-------|\n"),
        F.when(rows == "", "| | | |").otherwise(rows),
        F.lit("\n\n## Projects in common\n"), F.when(has_projects, listed).otherwise("-"),
        F.lit(f"\n\n## Source notes\n- (Source: {source}, "), _range(), F.lit(")\n\n## Open questions\n-\n"))


UPDATE_MARK = "Email archive context"


def update_section(source: str = "email archive") -> Column:
    """Section appended to an existing person page."""
    def some(c: str) -> Column:
        return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    topics = F.nullif(F.array_join(F.coalesce("key_topics", F.array().cast("array<string>")), ", "), F.lit(""))
    rows = F.nullif(_interaction_rows(F.col("threads")), F.lit(""))
    return F.concat_ws(
        "\n", F.lit(f"\n## {UPDATE_MARK}"), F.concat(F.lit(f"(Source: {source}, "), _range(), F.lit(")")),
        F.concat(F.lit("Total correspondence: "), F.col("total_emails").cast("string"), F.lit(" emails")),
        F.concat(F.lit("Role: "), some("role_title")), F.concat(F.lit("\n"), some("relationship_summary")),
        F.concat(F.lit("\n"), some("notable_context")), F.concat(F.lit("\nKey topics: "), topics),
        F.concat(F.lit("\n### Email interactions\n| Date | Subject | Direction |\n|------|---------|-----------|\n"), rows))


def person_update(content: Column, section: Column, email: Column, today: str) -> Column:
    """Existing page with the section appended once; a page that has it stays as it is."""
    with_mail = F.when(F.contains(content, F.lit("email_contact:")), content).otherwise(
        F.regexp_replace(content, F.lit(r"\A(?s)(.*?)---\n\n#"),
                         F.concat(F.lit("$1email_contact: "), email, F.lit("\n---\n\n#"))))
    dated = F.regexp_replace(with_mail, r"last_updated:.*", f"last_updated: {today}")
    done = F.contains(content, F.lit(UPDATE_MARK))
    return F.when(done, content).otherwise(F.concat(dated, F.lit("\n"), section, F.lit("\n")))


# Labels of the entity sections of a text note, in order.
SECTIONS = [
    ("products", "Products"), ("services", "Services / Businesses"), ("people", "People"), ("prices", "Prices"),
    ("contacts", "Contacts"), ("phones", "Phone Numbers"), ("emails", "Emails"), ("urls", "URLs"),
    ("handles", "Social Handles"), ("addresses", "Addresses"), ("dates_mentioned", "Dates"),
    ("tickers", "Stock Tickers"), ("todos", "Action Items"), ("quotes", "Quotes"),
]


def text_note(stem: Column, month: Column, category: Column, score: Column, text: Column, image: Column | None = None) -> Column:
    """Note of one OCR text with frontmatter, entities, text and image. Needs the entity array columns."""
    from hearthbook.functions.text import category_name, slugify

    def tag(c: str, name: str) -> Column:
        return F.when(F.size(c) > 0, F.lit(name))
    tags = F.concat_ws(", ", F.lit("screenshot"), slugify(category, "tag"), tag("tickers", "stocks"),
                       tag("todos", "action-item"), tag("prices", "money"), tag("contacts", "contact"))
    front = [F.concat(F.lit('file: "'), stem, F.lit('"')), F.concat(F.lit('category: "'), category, F.lit('"')),
             F.concat(F.lit('month: "'), month, F.lit('"')), F.concat(F.lit("score: "), score.cast("string")),
             F.concat(F.lit("tags: ["), tags, F.lit("]"))]
    front += [F.concat(F.lit(f"{k}: "), yaml_list(F.col(k))) for k in
              ("phones", "emails", "urls", "handles", "dates_mentioned", "prices", "addresses", "tickers", "todos",
               "contacts", "quotes", "products", "services", "people")]

    def section(kind: str, label: str) -> Column:
        items = F.array_join(F.transform(kind, lambda v: F.concat(F.lit("- "), v)), "\n")
        one = F.concat(F.lit(f"- **{label}**: "), F.get(kind, F.lit(0)), F.lit("\n"))
        return F.when(F.size(kind) == 1, one).when(F.size(kind) > 1, F.concat(F.lit(f"**{label}**:\n"), items, F.lit("\n")))

    sections = F.concat_ws("\n", *[section(k, label) for k, label in SECTIONS])
    clean = strip(F.coalesce(text, F.lit("")))
    quoted = lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    long = F.concat(F.lit("## OCR Text\n\n"), quoted(F.substring(clean, 1, 500)),
                    F.lit("\n\n<details><summary>Full text</summary>\n\n"), quoted(clean), F.lit("\n\n</details>\n"))
    short = F.concat(F.lit("## OCR Text\n\n"), quoted(clean), F.lit("\n"))
    body = F.when(clean == "", None).when(F.length(clean) > 500, long).otherwise(short)
    return F.concat_ws(
        "\n", F.lit("---"), *front, F.lit("---"), F.lit(""), F.concat(F.lit("# "), stem, F.lit(" — "), category), F.lit(""),
        F.concat(F.lit("**Category**: [[Categories/"), category_name(category), F.lit("]]")),
        F.concat(F.lit("**Captured**: "), month), F.lit(""),
        F.when(sections != "", F.concat(F.lit("## Extracted Data\n\n"), sections)), body,
        F.concat(F.lit("## Screenshot\n![["), image, F.lit("]]\n")) if image is not None else F.lit(None).cast("string"))


