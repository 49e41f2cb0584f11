"""Chat exports: the current path through a tree of messages, summaries and topic statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions.text import strip
from hearthbook.operators.classify import multi_label, skip_conversation
from hearthbook.rulesets import chat
from hearthbook.session import materialise


def current_path(conversations: DataFrame) -> DataFrame:
    """Ordered messages with text on the way from the root to the current node of each export row.

    The node map of one conversation is one row, so the walk is an array fold inside the row.
    """
    node = lambda key: F.try_element_at("mapping", key)
    start = F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("path"))

    def step(acc: Column, _: Column) -> Column:
        known = F.map_contains_key(F.col("mapping"), F.coalesce(acc["at"], F.lit("")))
        return F.struct(
            F.when(known, node(acc["at"])["parent"]).alias("at"),
            F.when(acc["at"].isNotNull() & known, F.concat(F.array(acc["at"]), acc["path"])).otherwise(acc["path"]).alias("path"),
        )

    steps = F.sequence(F.lit(1), F.greatest(F.size("mapping"), F.lit(1)))
    rooted = F.exists(F.map_values("mapping"), lambda n: n["parent"].isNull())
    path = F.when(rooted, F.aggregate(steps, start, step, lambda acc: acc["path"]))
    walked = conversations.withColumn("_path", path)
    message = F.transform("_path", lambda k: node(k)["message"])
    text = lambda m: F.array_join(F.filter(
        F.transform(m["content"]["parts"], strip), lambda p: p != ""), "\n")
    rows = F.transform(
        F.filter(message, lambda m: m.isNotNull()),
        lambda m: F.struct(F.coalesce(m["author"]["role"], F.lit("unknown")).alias("role"), text(m).alias("text"),
                           m["create_time"].alias("timestamp")))
    said = F.filter(rows, lambda r: F.coalesce(r["text"], F.lit("")) != "")
    return walked.withColumn("messages", F.coalesce(said, F.array().cast(
        "array<struct<role:string,text:string,timestamp:double>>"))).drop("_path")


def path_rows(nodes: DataFrame, conv: str, node: str, parent: str, current: DataFrame) -> DataFrame:
    """Flat form of the walk: (conv, node, pos) on the current path, root first, for trees of any size.

    ``current`` has (conv, node). Ancestors double in reach each round, so a path of n nodes takes log2(n) equi-joins on
    (conv, node); no tree is gathered in one place. Trees without a current node and leaves that are none take no part, and
    a node leaves the table of jumps when its jump passes the root: each round carries only nodes as deep as its reach.
    """
    base = nodes.select(F.col(conv).alias("c"), F.col(node).alias("n"), F.col(parent).alias("up"))
    marked = current.select(F.col(conv).alias("c"), F.col(node).alias("n"), F.lit(0).cast("bigint").alias("dist"))
    deepest = base.groupBy("c").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
    inner = base.select("c", F.col("up").alias("n")).unionByName(marked.select("c", "n")).distinct()
    jump = base.filter("up IS NOT NULL").join(marked.select("c").distinct(), "c", "left_semi").join(inner, ["c", "n"], "left_semi")
    jump = materialise(jump, "path")
    reach = 1
    while reach < deepest:
        above = materialise(marked.join(jump, ["c", "n"]).select("c", F.col("up").alias("n"), (F.col("dist") + reach).alias("dist")), "path")
        if above.isEmpty():
            break
        marked = marked.unionByName(above)
        far = jump.select("c", F.col("n").alias("up"), F.col("up").alias("far"))
        jump = materialise(jump.join(far, ["c", "up"]).select("c", "n", F.col("far").alias("up")), "path")
        reach *= 2
    known = marked.join(base.select("c", "n"), ["c", "n"], "left_semi")
    length = known.groupBy("c").agg(F.max("dist").alias("_deep"))
    return known.join(length, "c").select(
        F.col("c").alias(conv), F.col("n").alias(node), (F.col("_deep") - F.col("dist")).alias("pos"))


def _cut(t: Column, n: int | None) -> Column:
    """A text cut to ``n`` letters with a mark, or whole if None."""
    return t if n is None else F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def summarise(messages: Column, said: int | None = chat.USER_TEXT_CUT, replied: int | None = chat.REPLY_TEXT_CUT) -> dict[str, Column]:
    """Columns of a chat summary from an ordered array of (role, text); texts are cut to ``said`` and ``replied`` letters, None keeps them whole."""
    def of(role: str) -> Column:
        return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["text"])

    replies = of("assistant")
    ends = F.when(F.size(replies) > 1, F.array(F.get(replies, F.lit(0)), F.element_at(replies, -1))).otherwise(replies)
    return {
        "user_messages": F.transform(of("user"), lambda t: _cut(t, said)),
        "key_responses": F.transform(ends, lambda t: _cut(t, replied)),
        "message_count": F.size(messages),
    }


def summarise_chat(conversations: DataFrame) -> DataFrame:
    """Title, day and summary of every export row with an ordered ``messages`` array."""
    from hearthbook.functions.dates import epoch_day

    cols = summarise(F.col("messages"))
    return conversations.select(
        F.coalesce("title", F.lit("Untitled")).alias("title"), epoch_day(F.col("create_time")).alias("date"),
        *[c.alias(k) for k, c in cols.items()])


def summarise_rows(messages: DataFrame, conv: str, pos: str, said: int | None = chat.USER_TEXT_CUT, replied: int | None = chat.REPLY_TEXT_CUT) -> DataFrame:
    """Summary facts of message rows: counts, sizes of texts cut to ``said``, first and last reply cut to ``replied``, by map-side aggregates."""
    reply = F.col("role") == "assistant"
    at = F.struct(F.col(pos).alias("p"), F.col("text").alias("t"))
    out = messages.groupBy(conv).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.sum(F.when(F.col("role") == "user", F.length(_cut(F.col("text"), said))).otherwise(0)).alias("user_chars"),
        F.min(F.when(reply, at)).alias("_first"), F.max(F.when(reply, at)).alias("_last"), F.count_if(reply).alias("replies"))
    return out.select(
        conv, "message_count", "user_messages", "user_chars",
        _cut(F.col("_first.t"), replied).alias("first_reply"),
        F.when(F.col("replies") > 1, _cut(F.col("_last.t"), replied)).alias("last_reply"))


def topic_index(conversations: DataFrame, rules=chat.DOMAIN_RULES, skip=tuple(chat.SKIP_PATTERNS), least: int = 3) -> DataFrame:
    """One row per (conversation, domain): skipped titles and short chats are left out."""
    kept = conversations.filter(~skip_conversation(F.col("title"), skip) & (F.col("message_count") >= least))
    return kept.withColumn("domain", F.explode(multi_label(F.col("title"), rules)))


def domain_stats(topics: DataFrame) -> DataFrame:
    return topics.groupBy("domain").agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("message_count").alias("messages"))
