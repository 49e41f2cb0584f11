"""Positions, running totals and carried values inside groups of any size.

A plain window over a group sends the group to one task. Here every group is cut into slices by a
value that grows with the order (a day of a time stamp, a block of an id). Rows are windowed inside
their slice; one small row per (group, slice) carries what earlier slices add. A group that holds a
third of the table is then worked on by as many tasks as it has slices.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

KEY = "__group_slice"
ID_BLOCK_BITS = 16


def slice_of(df: DataFrame, column: str) -> Column:
    """A slice that grows with ``column``: the day of a time, a block of an integer."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.to_date(F.col(column))
    if isinstance(kind, T.IntegralType):
        return F.shiftright(F.col(column).cast("bigint"), ID_BLOCK_BITS)
    raise ValueError(f"give slice_by for {column}: it must grow with the order")


def keyed(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    """Add one struct of the group keys and the slice.

    Structs compare equal also where a key is NULL, and both the join and the window that follow
    ask for the same partitioning by it, so rows move once.
    """
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return df.withColumn(KEY, F.struct(*fields, slice_by.alias("s")))


def whole_group(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(f"{KEY}.k{i}") for i in range(len(keys))])


def earlier_slices(keys: Sequence[str]):
    return whole_group(keys).orderBy(f"{KEY}.s").rowsBetween(Window.unboundedPreceding, -1)


def inside_slice(order: Sequence[Column]):
    return Window.partitionBy(KEY).orderBy(*order)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    name: str = "pos",
    per_group: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """1-based position of each row in its group, in ``order``.

    ``per_group`` adds values of the whole group: (aggregate over rows, how slices merge).
    ``slice_by`` must grow with the first order column.
    """
    extras = per_group or {}
    sliced = keyed(df, keys, slice_by)
    parts = sliced.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"), *[agg.alias(k) for k, (agg, _) in extras.items()]
    )
    offsets = parts.select(
        KEY,
        F.coalesce(F.sum("_n").over(earlier_slices(keys)), F.lit(0)).alias("_before"),
        *[merge(F.col(k)).over(whole_group(keys)).alias(k) for k, (_, merge) in extras.items()],
    )
    pos = F.row_number().over(inside_slice(order)) + F.col("_before")
    return sliced.join(offsets, KEY).withColumn(name, pos).drop("_before", KEY)


def running_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, slice_by: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row."""
    sliced = keyed(df, keys, slice_by).withColumn("_v", value)
    parts = sliced.groupBy(KEY).agg(F.sum("_v").alias("_n"))
    offsets = parts.select(KEY, F.coalesce(F.sum("_n").over(earlier_slices(keys)), F.lit(0)).alias("_before"))
    earlier = inside_slice(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_v").over(earlier), F.lit(0)) + F.col("_before")
    return sliced.join(offsets, KEY).withColumn(name, total).drop("_before", "_v", KEY)


def carry_forward(
    df: DataFrame, column: str, order: Sequence[Column], keys: Sequence[str], slice_by: Column
) -> DataFrame:
    """Fill ``column`` with the last value seen so far in the group."""
    sliced = keyed(df, keys, slice_by)
    at = F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_c")))
    parts = sliced.groupBy(KEY).agg(F.max(at)["_c"].alias("_last"))
    carried = parts.select(KEY, F.last("_last", ignorenulls=True).over(earlier_slices(keys)).alias("_carried"))
    so_far = inside_slice(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(so_far), F.col("_carried"))
    return sliced.join(carried, KEY).withColumn(column, filled).drop("_carried", KEY)


# -- rows kept per group ------------------------------------------------------------------------


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows of each group. Spark limits each group before the shuffle as well."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key."""
    return cap_per_group(df, keys, order, 1)


def best_row(df: DataFrame, keys: Sequence[str], score: Column, tie: Sequence[Column]) -> DataFrame:
    """Row with the highest score of each group; ties go by ``tie``."""
    return cap_per_group(df, keys, [score.desc(), *tie], 1)


def top_neighbours(edges: DataFrame, n: int) -> DataFrame:
    """Strongest ``n`` neighbours of each node, ranked."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight").unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "weight")
    )
    return cap_per_group(both, ["node"], [F.desc("weight"), F.asc("neighbour")], n, "rank")


def rank_candidates(df: DataFrame, work: str, score: str, tie: str, slice_by: Column | None = None) -> DataFrame:
    """Rank of each candidate inside its work, best first."""
    by = slice_by if slice_by is not None else -F.col(score)
    return number_rows(df, [work], [F.desc(score), F.asc(tie)], by, "rank")


def rank_tiers(df: DataFrame, score: str, tie: str, sizes: Sequence[int] = (25, 35, 40)) -> DataFrame:
    """Overall top list cut into tiers of the given sizes."""
    top = df.orderBy(F.desc(score), F.asc(tie)).limit(sum(sizes))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))
    tier, upto = F.when(F.lit(False), 0), 0
    for i, size in enumerate(sizes, 1):
        upto += size
        tier = tier.when(F.col("rank") <= upto, i)
    return ranked.withColumn("tier", tier)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column) -> DataFrame:
    return number_rows(df, keys, order, slice_by, "pos")


def stratified_sample(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    full: int = 20,
    first: int = 5,
    middle: int = 10,
    last: int = 5,
    slice_by: Column | None = None,
) -> DataFrame:
    """All rows of small groups; of large ones the first, the last, evenly spread ones and the longest.

    ``order`` must be unique inside a group.
    """
    by = slice_by if slice_by is not None else slice_of(df, order)
    longest = F.struct((-F.length(F.col(text))).alias("n"), F.col(order).alias("o"))
    numbered = number_rows(
        df, keys, [F.asc_nulls_first(order)], by, "pos",
        {"_total": (F.count(F.lit(1)), F.sum), "_longest": (F.min(longest), F.min)},
    )
    pos, total = F.col("pos"), F.col("_total")
    step = F.greatest(F.lit(1), F.floor((total - first - last) / middle))
    offset = pos - (first + 1)
    in_middle = (pos > first) & (pos <= total - last) & (offset % step == 0) & (offset / step < middle)
    keep = (
        (total <= full) | (pos <= first) | (pos > total - last) | in_middle
        | (longest == F.col("_longest"))
    )
    return numbered.filter(keep).drop("_total", "_longest")


def char_budget(
    df: DataFrame, keys: Sequence[str], order: str, text: str, budget: int = 50000, slice_by: Column | None = None
) -> DataFrame:
    """Rows of each group until ``budget`` characters are used; the crossing row is cut."""
    by = slice_by if slice_by is not None else slice_of(df, order)
    used = running_before(df, keys, [F.asc_nulls_first(order)], F.length(F.col(text)), by, "_used")
    left = (F.lit(budget) - F.col("_used")).cast("int")
    return used.filter(F.col("_used") <= budget).withColumn(text, F.substr(F.col(text), F.lit(1), left)).drop("_used")


def day_marker(df: DataFrame, ts: str, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Flag the first row of each day inside a group: where a rendered thread starts a new day."""
    w = Window.partitionBy(*keys, F.to_date(ts)).orderBy(F.asc(ts), *[F.asc(t) for t in tie])
    return df.withColumn("new_day", F.row_number().over(w) == 1)


def free_numbers(wanting: DataFrame, used: DataFrame, keys: Sequence[str], first: int, name: str = "__free_no") -> DataFrame:
    """The j-th row of a group (``_j`` from 0) takes the j-th number from ``first`` on that ``used`` (keys, no) does not hold.

    A used number has as many free ones below it as its distance from ``first`` less the used ones below. Rows and used
    numbers are laid on that scale together, and a row's number is its place plus the used ones up to it: no rounds, and
    neither a group nor its used numbers meet in one task.
    """
    block = lambda c: F.shiftright(F.col(c), ID_BLOCK_BITS)
    held = used.select(*keys, F.col("no").cast("long").alias("no")).filter(F.col("no") >= first).distinct()
    held = number_rows(held, keys, [F.asc("no")], block("no"), "_i")
    marks = held.select(*keys, (F.col("no") - first - F.col("_i") + 1).alias("__free_j"), F.lit(1).alias("__free_used"))
    rows = wanting.withColumn("__free_used", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    counted = running_before(rows, keys, [F.asc("__free_j"), F.desc("__free_used")], F.col("__free_used"), block("__free_j"), "__free_skip")
    return counted.filter("__free_used = 0").withColumn(name, F.col("__free_j") + first + F.col("__free_skip")).drop("__free_used", "__free_skip")


def unique_destinations(
    df: DataFrame,
    folder: str,
    name: str,
    order: Sequence[Column],
    slice_by: Column,
    first_suffix: int = 1,
    mark: str = "_",
    max_bytes: int = 255,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Collision-free file names per folder: the n-th namesake gets a number, long stems are cut.

    The first of a name keeps it, unless ``taken`` (folder, name) already holds it. The others take, in ``order``, the
    lowest numbers that neither a name of ``taken`` nor one that a file keeps has. Names built from different stems can
    only be alike where an extension ends as a number does; what clashes so goes into a further round. Rows without a
    name get none.
    """
    from hearthbook.functions.scores import extension_of, stem_of
    from hearthbook.session import materialise

    if not mark or mark[-1].isdigit():
        raise ValueError("a mark must end in something other than a digit, or numbers cannot be told from stems")
    extension = lambda c: F.when(extension_of(c) == "", "").otherwise(F.regexp_extract(c, r"(\.[^.]*)$", 1))
    stem, ext = stem_of(F.col(name)), extension(F.col(name))
    room = F.lit(max_bytes - 5) - F.octet_length(ext)
    cut = F.make_valid_utf8(F.substr(stem.cast("binary"), F.lit(1), room).cast("string"))
    fitted = F.when(F.octet_length(stem) > room, F.regexp_replace(cut, "�+$", "")).otherwise(stem)
    # folder, stem and extension travel as structs: they are equal also where the folder is null
    base = df.withColumn("__free_group", F.struct(F.col(folder).alias("f"), fitted.alias("s"), ext.alias("e")))
    whole = lambda f, n: F.struct(f.alias("f"), n.alias("n"))
    kept = whole(F.col("__free_group.f"), F.concat("__free_group.s", "__free_group.e"))
    numbered = number_rows(base.filter(F.col(name).isNotNull()), ["__free_group"], order, slice_by, "__free_nth").withColumn("__free_kept", kept)
    blocked = F.lit(False)
    if taken is not None:
        given = taken.select(whole(F.col(taken.columns[0]), F.col(taken.columns[1])).alias("__free_kept")).distinct()
        numbered = numbered.join(given.withColumn("__free_blocked", F.lit(True)), "__free_kept", "left")
        blocked = F.coalesce("__free_blocked", F.lit(False))
    numbered = numbered.withColumn("__free_j", F.col("__free_nth") - F.when(blocked, 1).otherwise(2)).drop("__free_blocked")
    numbered = materialise(numbered, "names")
    natural = numbered.filter("__free_j < 0").withColumn("dest_name", F.col("__free_kept.n"))
    used = natural.select("__free_kept") if taken is None else natural.select("__free_kept").unionByName(given)

    def numbers(names: DataFrame) -> DataFrame:
        """(group, no) of the names that end in the mark and a number."""
        parts = names.select(F.col("__free_kept.f").alias("f"), stem_of(F.col("__free_kept.n")).alias("s"), extension(F.col("__free_kept.n")).alias("e"))
        tail = "^(?s)(.*)" + re.escape(mark) + r"(0|[1-9][0-9]{0,17})$"
        found = parts.select("f", F.regexp_extract("s", tail, 1).alias("s"), F.regexp_extract("s", tail, 2).alias("no"), "e").filter("no <> ''")
        return found.select(F.struct("f", "s", "e").alias("__free_group"), F.col("no").cast("long").alias("no"))

    left, done = numbered.filter("__free_j >= 0"), [natural]
    while True:
        held = numbers(used).join(left.select("__free_group").distinct(), "__free_group", "left_semi")
        tried = free_numbers(left, held, ["__free_group"], first_suffix)
        tried = tried.withColumn("dest_name", F.concat("__free_group.s", F.lit(mark), F.col("__free_no").cast("string"), "__free_group.e")).drop("__free_no")
        tried = materialise(tried.withColumn("__free_kept", whole(F.col("__free_group.f"), F.col("dest_name"))), "names")
        best = tried.groupBy("__free_kept").agg(F.min(F.struct("__free_group", "__free_j")).alias("__free_best"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        if best.isEmpty():
            done.append(tried)
            break
        judged = materialise(tried.join(best, "__free_kept", "left").withColumn(
            "__free_free", F.coalesce(F.struct("__free_group", "__free_j") == F.col("__free_best"), F.lit(True))).drop("__free_best"), "names")
        done.append(judged.filter("__free_free").drop("__free_free"))
        used = used.unionByName(done[-1].select("__free_kept"))
        left = number_rows(judged.filter("not __free_free").drop("__free_free", "__free_j", "dest_name"), ["__free_group"], [F.asc("__free_nth")], F.shiftright("__free_nth", ID_BLOCK_BITS), "__free_j")
        left = left.withColumn("__free_j", F.col("__free_j") - 1)
    nameless = base.filter(F.col(name).isNull()).withColumn("dest_name", F.lit(None).cast("string"))
    out = nameless.select(*df.columns, "dest_name")
    for d in done:
        out = out.unionByName(d.select(*df.columns, "dest_name"))
    return out


def batch(df: DataFrame, order: Sequence[Column], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` in order: the work list of one run."""
    return df.orderBy(*order).offset(start).limit(size)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_by(df: DataFrame, score: str, tie: str) -> DataFrame:
    """All rows, best score first, in a fixed order."""
    return df.orderBy(F.desc(score), F.asc(tie))


def chronological(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_first(ts), *[F.asc(t) for t in tie])


def by_severity(df: DataFrame) -> DataFrame:
    return df.orderBy("severity", "month")
