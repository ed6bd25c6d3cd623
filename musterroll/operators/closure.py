"""Everything that roots own, directly or through others.

Ownership is a forest almost everywhere: one owner per child. Pointers to owners are then
doubled, so the number of rounds is the logarithm of the depth, and only nodes that own
something take part. Where such a node has several owners the search goes level by level,
which is bounded by its result whatever the graph looks like.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from musterroll.operators.heat import small_side
from musterroll.session import written


def _counted(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written, and sums over its rows taken by the same job."""
    seen = Observation()
    one = {name: F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias(name) for name, value in sums.items()}
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *one.values()), label)
    return table, seen.get


def _nearest(pointers: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The nearest root above each node that has one, with its distance.

    ``pointers`` has ``node, up, depth, done``; a pointer is done at a root. Each round
    replaces a pointer by that of the node it points to. Pointers that end at a node
    without owner vanish; those that go round in a circle stay open, so the search ends
    when a round closes none.
    """
    while sizes["open"]:
        ahead = pointers.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = pointers.where(~F.col("done")).join(small_side(ahead, sizes["rows"]), "up")
        moved = moved.select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        before = sizes["open"]
        pointers, sizes = _counted(pointers.where("done").unionByName(moved), "pointers", open=~F.col("done"))
        if sizes["open"] == before:
            break
    return pointers.where("done").select(F.col("up").alias("root"), "node", "depth")


def _all_above(pairs: DataFrame) -> DataFrame:
    """All roots above each root, from the nearest one of each, by squaring."""
    pairs, sizes = _counted(pairs, "roots")
    while sizes["rows"]:
        below = pairs.select(F.col("root").alias("node"), F.col("node").alias("lowest"), F.col("depth").alias("more"))
        longer = pairs.join(below, "node").select(
            "root", F.col("lowest").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        longer = longer.where("root <> node").unionByName(pairs)
        before = sizes["rows"]
        pairs, sizes = _counted(longer.groupBy("root", "node").agg(F.min("depth").alias("depth")), "roots")
        if sizes["rows"] == before:
            break
    return pairs


def _by_levels(links: DataFrame, roots: DataFrame) -> DataFrame:
    level, sizes = _counted(
        roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "level")
    seen = level
    for depth in count(1):
        if not sizes["rows"]:
            return seen
        reached = links.join(small_side(level, sizes["rows"]), level["node"] == links["up"])
        reached = reached.select("root", links["node"]).distinct()
        fresh = reached.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        level, sizes = _counted(fresh, "level")
        seen = seen.unionByName(level)


def owned_closure(
    edges: DataFrame, roots: DataFrame, parent: str = "parent_id", child: str = "child_id",
    max_depth: int | None = None,
) -> DataFrame:
    """Every descendant of each root with its depth; the root itself is depth zero.

    ``root, node, depth``, one row per pair; a node reached twice keeps its least depth,
    which also ends cycles. Edges without one of their ends, and from a node to itself, say
    nothing. Nodes below ``max_depth``, if one is given, are an error.

    The edges are read twice: for the links among nodes that own something, which are
    doubled, and for the last step from these to everything else. Roots are where pointers
    stop, so a round moves one row per node; roots below roots are resolved among
    themselves.
    """
    up, node = F.col(parent).alias("up"), F.col(child).alias("node")
    links = edges.select(node, up).where(F.col("node") != F.col("up"))
    roots = roots.select("root").where(F.col("root").isNotNull()).distinct()
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast(links.schema["up"].dataType).alias("up")
    # One shuffle tells for each node its owners, whether it owns something and whether it is a root.
    facts = links.select("node", "up", no.alias("owns"), no.alias("is_root"))
    facts = facts.union(links.select("up", none, yes, no)).union(roots.select("root", none, no, yes))
    inner = facts.groupBy("node").agg(
        F.min("up").alias("up"), F.max("up").alias("other"), F.max("owns").alias("owns"), F.max("is_root").alias("nested"),
    ).where("owns AND up IS NOT NULL")
    tops = roots.select(F.col("root").alias("up"), yes.alias("to_root"))
    inner = inner.join(tops, "up", "left").select(
        "node", "up", F.lit(1).alias("depth"), F.col("to_root").isNotNull().alias("done"),
        (F.col("other") != F.col("up")).alias("several"), "nested")
    inner, sizes = _counted(inner, "inner", open=~F.col("done"), several=F.col("several"), nested=F.col("nested"))
    if sizes["several"]:
        found = _by_levels(links, roots)
    else:
        nearest = _nearest(inner.drop("several", "nested"), sizes)
        own = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        # Only what owns something is on the left, far less than there is to own.
        step = own.unionByName(nearest).withColumnRenamed("node", "up").join(links, "up")
        found = own.unionByName(step.select("root", "node", (F.col("depth") + 1).alias("depth")))
        if sizes["nested"]:
            pairs = nearest.join(roots, nearest["node"] == roots["root"], "left_semi").where("root <> node")
            above = _all_above(pairs.select("root", "node", "depth")).select(
                F.col("root").alias("top"), F.col("node").alias("root"), F.col("depth").alias("more"))
            higher = found.join(above, "root").select(
                F.col("top").alias("root"), "node", (F.col("depth") + F.col("more")).alias("depth"))
            found = found.unionByName(higher)
        found = found.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    if max_depth is not None:
        found, sizes = _counted(found, "closure", deeper=F.col("depth") > max_depth)
        if sizes["deeper"]:
            raise ValueError(f"{sizes['deeper']} nodes lie deeper than {max_depth} levels")
    return found
