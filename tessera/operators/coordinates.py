"""Coordinates of taxonomy nodes: sparse vectors in which squared distance is the taxonomy's distance, and their signed fold into fewer dimensions.

Every node is an axis. A node's coordinate has, on its own axis and on that of each
node above it in the canonical tree, the root of the information that the step to
that axis adds. What two nodes share cancels, so the squared distance of two
coordinates is IC(a) + IC(b) - 2 IC(lowest common ancestor). Coordinates have as many
elements as the node has ancestors; they are rows (node, axis, weight), so that
distances are an equi-join on the axis and nothing dense is made.

A fold adds every axis, with a sign, into one of D slots that a hash of its name
says. Distances then carry noise from axes that share a slot, which falls as D grows.

Defined cases: a node of several parents hangs under the one of greatest information
(of equal ones, the least name), so that the tree is the same each time; a root's
axis has the root of its own information (nothing, if it counts everything); a step
that adds no information is no element; a node without any has no rows, and distance
0 from itself; repeated pairs are answered once; a null in a pair gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import closure
from tessera.steps import Steps


def canonical(tree: DataFrame, ic: DataFrame) -> DataFrame:
    """(node, parent): one parent of every node, null for a root. tree (node, parent, ...), ic (node, ic)."""
    up = ic.select(F.col("node").alias("parent"), F.col("ic").alias("parent_ic"))
    above = tree.select("node", "parent").distinct().join(up, "parent", "left")
    known = F.struct(F.col("parent").isNull().alias("none"), (-F.col("parent_ic")).alias("less"), F.col("parent").alias("parent"))
    return above.groupBy("node").agg(F.min(known).alias("k")).select("node", F.col("k.parent").alias("parent"))


def sparse(tree: DataFrame, ic: DataFrame) -> DataFrame:
    """(node, axis, weight) of every node of the tree."""
    steps = Steps(tree.sparkSession)
    lines = steps.written(canonical(tree, ic), "canonical")
    at = ic.select("node", "ic")
    over = at.select(F.col("node").alias("parent"), F.col("ic").alias("parent_ic"))
    added = F.greatest(F.col("ic") - F.coalesce("parent_ic", F.lit(0.0)), F.lit(0.0))
    axes = lines.join(at, "node").join(over, "parent", "left").select(F.col("node").alias("axis"), F.sqrt(added).alias("weight")).filter("weight > 0")
    above = closure(lines).select("node", F.col("ancestor").alias("axis"))
    out = steps.written(above.join(axes, "axis").select("node", "axis", "weight"), "coordinates")
    steps.over(out)
    return out


def distances_in(pairs: DataFrame, spaces: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """pairs (a, b) with a column for each of some spaces {name: (coordinates, their column of axes)}: the squared distance there.

    A node's elements of all spaces travel in one row, so that a pair is met twice
    however many elements and spaces there are.
    """
    zero = F.lit(0.0)
    rows = [c.select("node", F.lit(name).alias("space"), F.struct(F.col(axis).cast("string").alias("axis"), F.col("weight").alias("w")).alias("x")) for name, (c, axis) in spaces.items()]
    lists = reduce(DataFrame.unionByName, rows).groupBy("node").agg(*[F.collect_list(F.when(F.col("space") == name, F.col("x"))).alias(name) for name in spaces])
    norm = lambda x: F.aggregate(x, zero, lambda s, e: s + e["w"] * e["w"])
    packed = lists.select("node", F.struct(*[F.struct(F.map_from_entries(name).alias("at"), norm(F.col(name)).alias("norm2")).alias(name) for name in spaces]).alias("of"))
    each = pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    of = lambda end: packed.select(F.col("node").alias(end), F.col("of").alias(f"of_{end}"))
    known = of("b").join(each.select("b").distinct(), "b", "left_semi")  # often few
    met = each.join(of("a").hint("merge"), "a", "left").join(known, "b", "left")

    def d2(name: str) -> Column:
        a, b = F.col("of_a")[name], F.col("of_b")[name]
        xy = F.aggregate(F.map_entries(b["at"]), zero, lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(a["at"], e["key"]), zero))
        return F.greatest(F.coalesce(a["norm2"], zero) + F.coalesce(b["norm2"], zero) - 2 * F.coalesce(xy, zero), zero)

    return met.select("a", "b", *[d2(name).alias(name) for name in spaces])


def distances(pairs: DataFrame, coordinates: DataFrame, axis: str = "axis") -> DataFrame:
    """pairs (a, b) with d2, the squared distance of their coordinates (node, axis, weight)."""
    return distances_in(pairs, {"d2": (coordinates, axis)})


def slot(name: Column, width: int, seed: str = "axis") -> tuple[Column, Column]:
    """(slot under width, sign) of a name: from the first 15 and the next hexadecimal digits of an MD5 of seed and name."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary"))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(digest, 16, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    return F.pmod(number, F.lit(width)), sign


def folded(coordinates: DataFrame, width: int, seed: str = "axis") -> DataFrame:
    """(node, slot, weight) of coordinates (node, axis, weight), folded into width slots; no more rows than before."""
    at, sign = slot(F.col("axis"), width, seed)
    return coordinates.select("node", at.alias("slot"), (sign * F.col("weight")).alias("w")).groupBy("node", "slot").agg(F.sum("w").alias("weight"))


def ranks(values: DataFrame, slices: int = 64) -> DataFrame:
    """(col, v, rank) of values (col, v, n), n rows of column col with value v: ranks from 1 in each column, equal values sharing their average.

    Values are counted within slices of their order, so that no task sorts them
    all. What is read twice is written before, and the offsets have a row for each
    slice and column.
    """
    steps = Steps(values.sparkSession)
    counts = steps.written(values.groupBy("col", "v").agg(F.sum("n").alias("n")), "counts")
    dealt = steps.written(counts.repartitionByRange(slices, "col", "v").withColumn("slice", F.spark_partition_id()), "slices")
    sizes = dealt.groupBy("col", "slice").agg(F.sum("n").alias("s"))
    offset = sizes.select("col", "slice", (F.sum("s").over(W.partitionBy("col").orderBy("slice")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("slice", "col").orderBy("v"))
    ranked = dealt.withColumn("to", inside).join(F.broadcast(offset), ["col", "slice"])
    out = steps.written(ranked.select("col", "v", (F.col("before") + F.col("to") - (F.col("n") - 1) / 2).alias("rank")), "ranks")
    steps.over(out)
    return out


def average_ranks(df: DataFrame, value: str, name: str, slices: int = 64) -> DataFrame:
    """df with the rank of value from 1, equal values sharing their average."""
    v = F.col(value)
    ranked = ranks(df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("col", F.lit(value)), slices)
    return df.join(ranked.select(F.col("v").alias("_v"), F.col("rank").alias(name)).hint("merge"), v == F.col("_v")).drop("_v")


def rank_correlations(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """(y, rho): the correlation of the average ranks of a column of numbers with each of others, over rows that have both; null if either has one value, no row without any.

    Equal pairs of values are counted first; their ranks are met by sorted joins, and nothing that grows is broadcast.
    """
    steps = Steps(df.sparkSession)
    double = lambda c: F.col(c).cast("double")
    each = df.select(double(x).alias("vx"), F.explode(F.array(*[F.struct(F.lit(y).alias("y"), double(y).alias("vy")) for y in ys])).alias("p")).select("vx", "p.*")
    joint = steps.written(each.filter("vx IS NOT NULL AND vy IS NOT NULL").groupBy("y", "vx", "vy").agg(F.count(F.lit(1)).alias("n")), "joint")
    side = lambda v: joint.select(F.concat(F.lit(f"{v}|"), "y").alias("col"), F.col(v).alias("v"), "n")
    ranked = ranks(side("vx").unionByName(side("vy")))
    of = lambda v, name: ranked.filter(F.startswith("col", F.lit(f"{v}|"))).select(F.substring("col", 4, 1 << 20).alias("y"), F.col("v").alias(v), F.col("rank").alias(name)).hint("merge")
    middle = joint.groupBy("y").agg(((F.sum("n") + 1) / 2).alias("m"))  # a row per column
    met = joint.join(of("vx", "rx"), ["y", "vx"]).join(of("vy", "ry"), ["y", "vy"]).join(F.broadcast(middle), "y")
    dx, dy, n = F.col("rx") - F.col("m"), F.col("ry") - F.col("m"), F.col("n")
    sums = met.groupBy("y").agg(F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"), F.sum(n * dx * dy).alias("xy"))
    out = steps.written(sums.select("y", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("rho")), "rho")
    steps.over(out)
    return out


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, the correlation of the average ranks of two columns of numbers; null if either has one value."""
    return rank_correlations(df, x, [y]).agg(F.max("rho").alias("rho"))
