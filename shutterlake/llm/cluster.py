"""Classes of similar items from banded sketches, for any exact measure.

Items that share a band key are candidates. No bucket is turned into all of its pairs. Each bucket names two leaders,
the member that meets most others in all its buckets and one by a hash of the bucket's own, and members are compared
with leaders; links give components, and whatever shares a component needs no further comparison. Then the buckets that
still hold more than one component are finished exactly: a prefix-filtered join finds whatever member outside a bucket's
largest component may resemble a member of another, so no link between different items of one bucket is lost. Candidates
whose sketches agree in less than `floor` of their positions are not verified; at 48 positions a true pair of 0.8 falls
below one half about once in ten million.

Work tables are settled in the shared checkpoint folder. Hot buckets and hot leaders stand on the skewed side of joins
with a unique key on the other side, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import settled, small_side, written

#: Rows of a file of the settled edges, and items to a file of the work tables: their number follows the data, not the
#: partitions of the shuffles before, so that small tables do not end up as hundreds of small files.
ROWS_PER_FILE = 500_000
ITEMS_PER_FILE = 2_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the smallest id it is connected with.

    Alternates large-star and small-star steps, which only take minima and join them back, until nothing changes.
    """
    edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state, files = None, 1 + edges.count() // ROWS_PER_FILE
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Every row leads from an id to a smaller one; rows that arise twice are dropped once, at the end.
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            "u", "m", F.explode(F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("v"))).alias("w"))
        edges = settled(small.select(F.col("m").alias("a"), F.col("w").alias("b")).distinct().coalesce(files))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    pairs = edges.groupBy("b").agg(F.min("a").alias("root"))
    return settled(pairs.select(F.col("b").alias("id"), "root").union(pairs.select(F.col("root").alias("id"), "root").distinct()).coalesce(files))


def agreement(a: Column, b: Column) -> Column:
    """Share of the positions at which two sketches agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def _with_sketches(pairs: DataFrame, sketches: DataFrame, ratio: float, floor: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold, with the sketches' agreement."""
    side = lambda n: sketches.select(F.col("id").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(F.least("size_a", "size_b") >= ratio * F.greatest("size_a", "size_b"))
        .withColumn("agrees", agreement(F.col("sketch_a"), F.col("sketch_b"))).where(F.col("agrees") >= floor)
        .select("a", "b", "agrees")
    )


def _labelled(rows: DataFrame, found: DataFrame, name: str, label: str) -> DataFrame:
    """rows with the component of the id in column `name`; an id without links is its own component."""
    return rows.join(found.select(F.col("id").alias(name), F.col("root").alias(label)), name, "left").withColumn(label, F.coalesce(label, name))


def similar_classes(
    sketches: DataFrame, verify: Callable[[DataFrame], DataFrame], contents: Callable[[DataFrame], DataFrame],
    threshold: float = 0.8, floor: float = 0.5, size_ratio: float | None = None,
) -> DataFrame:
    """(id, root) of all items in classes of two and more.

    sketches: (id, size, sketch array<int>, bands array<bigint>), one row per item. verify takes pairs (a, b) and
    returns those whose exact similarity reaches the threshold. contents takes ids and returns (id, element, weight,
    total): what each item holds, and the sum of its weights. Sizes of a true pair differ by the threshold at most,
    or by `size_ratio` where they are only bounds.
    """
    files = 1 + sketches.count() // ITEMS_PER_FILE

    def kept(frame: DataFrame) -> DataFrame:
        return settled(frame.coalesce(files))

    rows = sketches.select(F.explode("bands").alias("band"), "id")
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = kept(rows.join(shared, "band"))
    # The item that meets most others, over all its buckets, is the likeliest to resemble each of them.
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    known = members.join(met, "id")
    leaders = known.groupBy("band").agg(
        F.max(F.struct("met", "id")).alias("hub"), F.min(F.struct(F.xxhash64("band", "id").alias("order"), "id")).alias("any"))
    led = members.select("band", "id").join(leaders.select("band", F.explode(F.array("hub.id", "any.id")).alias("leader")), "band")
    pairs = led.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    ratio = size_ratio or threshold * 0.999  # sizes are rounded
    small = kept(sketches.select("id", "size", "sketch").join(small_side(kept(members.select("id").distinct())), "id", "left_semi"))
    star = kept(_with_sketches(pairs, small, ratio, floor))

    # First the likeliest leader of each member, then the other leaders of other components, then what is left over.
    best = kept(star.groupBy("a").agg(F.max_by("b", F.struct("agrees", "b")).alias("b")))
    links = kept(verify(best))
    # Which of these are connected is only needed roughly here: by the leader, or its own.
    near = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    found = near.join(near.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    rest = _labelled(_labelled(star.select("a", "b"), found, "a", "ca"), found, "b", "cb").where("ca <> cb").select("a", "b")
    links = kept(links.union(verify(rest.join(best, ["a", "b"], "left_anti"))))
    found = components(links)

    placed = kept(_labelled(members.select("band", "id"), found, "id", "c"))
    counts = placed.groupBy("band", "c").agg(F.count("*").alias("n"))
    largest = counts.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_rows = kept(placed.join(largest, "band"))
    left = _left_over(open_rows, small, contents, threshold * 0.999, floor, kept)
    tried = star.select("a", "b").union(star.select(F.col("b"), F.col("a")))
    last = kept(verify(left.join(tried, ["a", "b"], "left_anti")))
    return components(links.union(last))


def _left_over(
    open_rows: DataFrame, small: DataFrame, contents: Callable[[DataFrame], DataFrame], least_similarity: float, floor: float,
    kept: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Pairs (a, b) of the open buckets' members of different components that may be similar.

    A prefix-filtered join: elements are ordered by the number of open items that hold them. Items of total weights s
    and t reach the similarity j only if they share a weight of j / (1 + j) * (s + t), so what they share first
    in that order lies before the place in either item from which on less weight than that is left. The many
    copies of an original that were changed too much to resemble it or each other part already there, as the changes come first.
    """
    ids = kept(open_rows.select("id").distinct())
    listed = written(contents(ids), "contents")
    counts = listed.groupBy("element").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy("n", "element").rowsBetween(Window.unboundedPreceding, -1)
    need = least_similarity / (1 + least_similarity)
    # Within one item's own elements; a partner weighs at least the threshold's share of it.
    first = kept(
        listed.join(counts, "element").withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .where(F.col("before") <= F.col("total") * (1 - need * (1 + least_similarity))).where("n > 1").select("id", "element", "before", "total"))
    members = open_rows.groupBy("id").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("main")).alias("outside"))
    rows = kept(first.join(members, "id"))
    x, y = rows.where("outside").alias("x"), rows.alias("y")
    shared = need * (F.col("x.total") + F.col("y.total"))
    may_share = (
        (F.col("x.element") == F.col("y.element")) & (F.col("x.c") != F.col("y.c"))
        & (F.col("x.before") <= F.col("x.total") - shared) & (F.col("y.before") <= F.col("y.total") - shared)
    )
    pairs = x.join(y, may_share).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return _with_sketches(pairs, small, 0.0, floor).select("a", "b")
