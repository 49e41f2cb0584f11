"""Co-occurrence graph: edges from shared subjects, significance, degree, bridges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hearthbook.operators.ordering import cap_per_group, top_neighbours
from hearthbook.session import materialise


PARTS_PER_CORE = 8


def subject_members(df: DataFrame, subject: str, member: str, min_chars: int = 11) -> DataFrame:
    """(subject, member): who shares which normalised subject, each pair once."""
    norm = df.select(F.lower(F.trim(subject)).alias("subject"), F.col(member).alias("member"))
    norm = norm.filter(F.length("subject") >= min_chars) if min_chars else norm
    # many small parts: a task that gathers and sorts a part holds an eighth of what it would with one part per core
    parts = PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return norm.dropna().repartition(parts, "subject", "member").groupBy("subject", "member").agg(F.lit(1).alias("_one")).drop("_one")


def subject_groups(df: DataFrame, subject: str, member: str, lo: int = 2, hi: int = 20, min_chars: int = 11) -> DataFrame:
    """Sorted member array of every subject shared by ``lo`` to ``hi`` members."""
    return member_groups(subject_members(df, subject, member, min_chars), lo, hi)


def member_groups(members: DataFrame, lo: int = 2, hi: int = 20) -> DataFrame:
    """Member arrays of (subject, member) pairs.

    At most ``hi + 1`` members per subject leave a task: that is enough to see that a subject is a
    mass mail, so a subject that holds a third of all rows costs no more than any other.
    """
    seen = cap_per_group(members, ["subject"], [F.asc("member")], hi + 1)
    groups = seen.groupBy("subject").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return groups.filter(F.size("members").between(lo, hi))


def pair_changes(old: DataFrame, new: DataFrame, lo: int = 2, hi: int = 20) -> DataFrame:
    """(source, target, weight) by which ``new`` (subject, member) pairs change the weights that ``old`` ones gave.

    Only subjects with new members are looked at: their old members meet the new ones, and a subject that grows
    beyond ``hi`` members takes its old pairs back.
    """
    fresh = new.select("subject", "member").distinct().join(old, ["subject", "member"], "left_anti")
    touched = fresh.select("subject").distinct()
    before = old.join(touched, "subject", "left_semi").select("subject", "member")
    after = before.unionByName(fresh)
    signed = [cooccurrence_pairs(member_groups(m, lo, hi)).select("source", "target", F.lit(v).alias("v")) for m, v in ((after, 1), (before, -1))]
    changes = signed[0].unionByName(signed[1]).groupBy("source", "target").agg(F.sum("v").alias("weight"))
    return changes.filter("weight <> 0")


def changed_weights(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """Edge weights after changes; edges that nothing supports any more are gone."""
    both = weights.select("source", "target", "weight").unionByName(changes.select("source", "target", "weight"))
    return both.groupBy("source", "target").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def cooccurrence_pairs(groups: DataFrame) -> DataFrame:
    """(source, target, subject) for each pair of members, source before target; at most 190 per subject."""
    pairs = F.flatten(F.transform("members", lambda a, i: F.transform(
        F.slice("members", i + 2, F.size("members")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return groups.select("subject", F.inline(pairs))


def edge_weights(pairs: DataFrame) -> DataFrame:
    """Weight of each edge."""
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def edge_samples(pairs: DataFrame, samples: int = 5, width: int = 80) -> DataFrame:
    """First ``samples`` shared subjects of each edge."""
    first = cap_per_group(pairs, ["source", "target"], [F.asc("subject")], samples)
    return first.groupBy("source", "target").agg(
        F.array_sort(F.collect_list(F.substring("subject", 1, width))).alias("shared_subjects"))


def significant(edges: DataFrame, nodes: DataFrame, min_weight: int = 2, busy: int = 20) -> DataFrame:
    """Edges of weight two and more, and single ones between two busy contacts."""
    many = nodes.filter(F.col("total_emails") >= busy).select("id").distinct()
    ends = [many.select(F.col("id").alias(end), F.lit(True).alias(f"_busy_{end}")) for end in ("source", "target")]
    # one pass over the edges: both ends are looked up, strong edges pass anyway
    seen = edges.join(ends[0], "source", "left").join(ends[1], "target", "left")
    kept = seen.filter((F.col("weight") >= min_weight) | (F.col("_busy_source") & F.col("_busy_target")))
    return kept.select(*edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("connections"))


def attach_nodes(edges: DataFrame, nodes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Node columns on both ends, prefixed by the end."""
    out = edges
    for end in ("source", "target"):
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])
        out = out.join(side, end, "left")
    return out


def bridge_score(edges: DataFrame, nodes: DataFrame, top: int = 20) -> DataFrame:
    """Twice the organisations plus the relationship types among the strongest neighbours."""
    near = top_neighbours(edges, top).join(
        nodes.select(F.col("id").alias("neighbour"), F.nullif("org", F.lit("")).alias("org"),
                     F.nullif("relationship_type", F.lit("")).alias("kind")), "neighbour", "left")
    return near.groupBy("node").agg(
        (F.size(F.collect_set("org")) * 2 + F.size(F.collect_set("kind"))).cast("bigint").alias("bridge_score"))


def connectors(edges: DataFrame, nodes: DataFrame, k: int = 500, shown: int = 5) -> DataFrame:
    """Best connected contacts with bridge score and their strongest neighbours. The edges are stored once and read four times."""
    edges = materialise(edges, "edges")
    top = degree(edges).orderBy(F.desc("connections"), F.asc("node")).limit(k)
    wanted = top.select("node")
    both = top_neighbours(edges, shown).join(F.broadcast(wanted), "node", "left_semi")
    label = both.join(nodes.select(F.col("id").alias("neighbour"), F.col("name").alias("n_name")), "neighbour", "left")
    text = F.concat(F.coalesce("n_name", F.col("neighbour").cast("string")), F.lit("("), F.col("weight"), F.lit(")"))
    near = label.groupBy("node").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), ", ").alias("top_connections"))
    info = nodes.select(F.col("id").alias("node"), "name", "total_emails", "relationship_type")
    return top.join(bridge_score(edges, nodes), "node", "left").join(near, "node", "left").join(info, "node", "left")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the number of nodes and edges."""
    sides = nodes.select(F.lit("n").alias("side")).unionByName(edges.select(F.lit("e").alias("side")))
    return sides.agg(F.count_if(F.col("side") == "n").alias("total_nodes"),
                     F.count_if(F.col("side") == "e").alias("total_edges"))
