"""Taxonomy geometry and propagation over labelled edges.

A taxonomy is (node, parent, own): a row for every parent of a node, of any
number and depth; own is the node's own count. The ancestor closure is built
level by level, each level one equi-join that is written, until nothing new is
above. Information content is -ln of the share of a node's cumulative count; the
distance of two nodes is IC(a) + IC(b) - 2 IC(common ancestor of greatest IC).
Propagation keeps what an attenuation exp(-d / xi) leaves at or over a gap, and
drops the rest whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.metrics import exact_median
from tessera.steps import Steps


def closure(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, up): every node with itself and all its ancestors, at the least number of steps; to any depth unless one is stated. Cycles end where they come back."""
    steps = Steps(tree.sparkSession)
    above = steps.written(tree.filter("parent IS NOT NULL").select(F.col("node").alias("child"), "parent").distinct(), "parents")
    levels = [steps.written(tree.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")), "closure")]
    while depth is None or len(levels) <= depth:
        met = levels[-1].join(above, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        known = reduce(DataFrame.unionByName, levels).select("node", "ancestor")
        level = steps.written(met.join(known, ["node", "ancestor"], "left_anti").withColumn("up", F.lit(len(levels))), "closure")
        if level.limit(1).count() == 0:
            break
        levels.append(level)
    out = steps.written(reduce(DataFrame.unionByName, levels), "closure")
    steps.over(out)
    return out


def own_counts(tree: DataFrame) -> DataFrame:
    """(node, own), a node with several parents once."""
    return tree.groupBy("node").agg(F.max("own").alias("own"))


def information_content(tree: DataFrame, above: DataFrame, smooth: int = 1) -> DataFrame:
    """(node, cum, ic, se): counts with smooth added to every node and summed up the tree, every descendant once; se of the share is sqrt((1 - p) / n)."""
    counts = above.join(own_counts(tree).select("node", (F.col("own") + smooth).alias("c")), "node").groupBy("ancestor").agg(F.sum("c").alias("cum"))
    total = counts.agg(F.max("cum").alias("total"))
    p = F.col("cum") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).select(
        F.col("ancestor").alias("node"), F.col("cum"), (-F.log(p)).alias("ic"), F.sqrt((1 - p) / F.col("cum")).alias("se")
    )


def resnik(tree: DataFrame, above: DataFrame) -> DataFrame:
    """(node, ic, status): unsmoothed; without a count there is no reading but a reason."""
    counts = above.join(own_counts(tree), "node").groupBy("ancestor").agg(F.sum("own").alias("cum"))
    root = counts.agg(F.max("cum").alias("root"))
    ic = -F.log(F.col("cum") / F.col("root"))
    return counts.crossJoin(F.broadcast(root)).select(
        F.col("ancestor").alias("node"), F.when(F.col("cum") > 0, ic).alias("ic"), F.when(F.col("cum") > 0, "measured").otherwise("zero_frequency").alias("status")
    )


def measured(words: DataFrame, ic: DataFrame, size: int) -> DataFrame:
    """(word, ic, status) of words (word, pos, at): read from ic (node, ic) of a table with positions below size; without a reading there is a reason."""
    reason = (
        F.when(F.col("pos").isNull(), "no_pos").when(F.col("at").isNull() | (F.col("at") < 0) | (F.col("at") >= size), "out_of_range")
        .when(F.col("ic").isNull(), "zero_frequency").otherwise("measured")
    )
    rows = words.join(ic.select(F.col("node").alias("word"), "ic"), "word", "left").withColumn("status", reason)
    return rows.select("word", F.when(F.col("status") == "measured", F.col("ic")).alias("ic"), "status")


def geometry(tree: DataFrame, ic: DataFrame) -> DataFrame:
    """One row: d_edge (exact median of positive IC steps), d_max over all roots, mu, xi, gap; null where there is no contrast."""
    up = ic.select(F.col("node").alias("parent"), F.col("ic").alias("parent_ic"))
    steps = tree.join(ic, "node").join(up, "parent").select((F.col("ic") - F.col("parent_ic")).alias("d")).filter("d > 0")
    edge = exact_median(steps, "d").withColumnRenamed("median", "d_edge")
    root = tree.filter("parent IS NULL").join(ic, "node").agg(F.min("ic").alias("root_ic"))
    most = ic.agg(F.max("ic").alias("max_ic"))
    one = edge.crossJoin(root).crossJoin(most).withColumn("d_max", 2 * F.col("max_ic") - 2 * F.col("root_ic"))
    return constants(one)


def forest_geometry(tree: DataFrame, above: DataFrame, ic: DataFrame) -> DataFrame:
    """geometry of several trees: d_max is the greatest over the roots of twice the span of IC below each."""
    up = ic.select(F.col("node").alias("parent"), F.col("ic").alias("parent_ic"))
    steps = tree.join(ic, "node").join(up, "parent").select((F.col("ic") - F.col("parent_ic")).alias("d")).filter("d > 0")
    roots = tree.filter("parent IS NULL").select(F.col("node").alias("ancestor")).join(ic.select(F.col("node").alias("ancestor"), F.col("ic").alias("root_ic")), "ancestor")
    spans = above.join(roots, "ancestor").join(ic.select("node", "ic"), "node").groupBy("ancestor").agg((2 * (F.max("ic") - F.first("root_ic"))).alias("span"))
    return constants(exact_median(steps, "d").withColumnRenamed("median", "d_edge").crossJoin(spans.agg(F.max("span").alias("d_max"))))


def constants(one: DataFrame) -> DataFrame:
    """d_edge and d_max with what follows from them: mu = ln(d_max / d_edge), xi = 1 / mu, gap = exp(-d_max / xi)."""
    mu = F.when((F.col("d_edge") > 0) & (F.col("d_max") > F.col("d_edge")), F.log(F.col("d_max") / F.col("d_edge")))
    xi = 1 / mu
    return one.select("d_edge", "d_max", mu.alias("mu"), xi.alias("xi"), F.exp(-F.col("d_max") / xi).alias("gap"))


def distances(pairs: DataFrame, above: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs (a, b) with jc: through the common ancestor of greatest IC. Pairs without a common ancestor drop out."""
    with_ic = above.join(ic.select(F.col("node").alias("ancestor"), F.col("ic").alias("anc_ic")), "ancestor")
    left = with_ic.select(F.col("node").alias("a"), "ancestor", "anc_ic")
    right = above.select(F.col("node").alias("b"), "ancestor")
    lca = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.max("anc_ic").alias("lca_ic"))
    own = ic.select("node", "ic")
    return (
        lca.join(own.select(F.col("node").alias("a"), F.col("ic").alias("ic_a")), "a").join(own.select(F.col("node").alias("b"), F.col("ic").alias("ic_b")), "b")
        .select("a", "b", (F.col("ic_a") + F.col("ic_b") - 2 * F.col("lca_ic")).alias("jc"))
    )


def attenuate(d: Column, length: Column | float) -> Column:
    return F.exp(-F.greatest(d, F.lit(0.0)) / length)


def horizon(weight: Column, xi: Column | float, gap: Column | float) -> Column:
    """How far a weight reaches before it falls to the gap; 0 below the gap."""
    return F.when(weight >= gap, xi * F.log(weight / gap)).otherwise(0.0)


def propagate(fired: DataFrame, targets: DataFrame, above: DataFrame, ic: DataFrame, xi: float, gap: float) -> DataFrame:
    """(target, energy, nearest): sum of energy times attenuation over the fired concepts whose attenuation reaches the gap.

    fired (concept, energy); targets (target, weight). Pairs meet at the ancestors
    that they share, and only where the distance through that ancestor still
    reaches the gap; the least of these is their distance. nearest is the least
    admitted distance, infinity if none is.
    """
    at = ic.select("node", "ic")
    needs = fired.groupBy("concept").agg(F.sum("energy").alias("energy")).join(at.withColumnsRenamed({"node": "concept", "ic": "ic_a"}), "concept")
    needs = needs.join(above, F.col("concept") == F.col("node")).select("concept", "energy", "ic_a", "ancestor")
    offers = targets.select("target").join(at.withColumnsRenamed({"node": "target", "ic": "ic_b"}), "target").join(above, F.col("target") == F.col("node"))
    offers = offers.join(at.withColumnsRenamed({"node": "ancestor", "ic": "anc_ic"}), "ancestor").select("target", "ancestor", (F.col("ic_b") - 2 * F.col("anc_ic")).alias("rest"))
    d = F.col("ic_a") + F.col("rest")
    met = needs.join(offers, "ancestor").filter(attenuate(d, xi) >= gap).groupBy("target", "concept").agg(F.min(d).alias("jc"), F.first("energy").alias("energy"))
    got = met.groupBy("target").agg(F.sum(F.col("energy") * attenuate(F.col("jc"), xi)).alias("sum"), F.min("jc").alias("near"))
    return targets.join(got, "target", "left").select(
        "target", (F.coalesce("sum", F.lit(0.0)) * F.col("weight")).alias("energy"), F.coalesce("near", F.lit(math.inf)).alias("nearest")
    )


def spread(seeds: DataFrame, above: DataFrame, ic: DataFrame, xi: float, gap: float) -> DataFrame:
    """(concept, energy): seeds (concept, energy) climb the tree, losing exp(-distance); pruned at each seed's horizon, summed over seeds."""
    at = ic.select("node", "ic")
    climb = (
        seeds.join(above, F.col("concept") == F.col("node")).drop("node")
        .join(at.select(F.col("node").alias("concept"), F.col("ic").alias("ic_here")), "concept")
        .join(at.select(F.col("node").alias("ancestor"), F.col("ic").alias("ic_up")), "ancestor")
        .withColumn("d", F.greatest(F.col("ic_here") - F.col("ic_up"), F.lit(0.0)))
        .filter(F.col("d") <= horizon(F.col("energy"), xi, gap))
    )
    return climb.groupBy(F.col("ancestor").alias("concept")).agg(F.sum(F.col("energy") * F.exp(-F.col("d"))).alias("energy"))


def step_costs(tree: DataFrame, ic: DataFrame) -> DataFrame:
    """(node, parent, cost): what a step up costs, the information it loses, never under 0."""
    at = ic.select("node", "ic")
    up = at.withColumnsRenamed({"node": "parent", "ic": "ic_up"})
    return tree.filter("parent IS NOT NULL").select("node", "parent").distinct().join(at, "node").join(up, "parent").select("node", "parent", F.greatest(F.col("ic") - F.col("ic_up"), F.lit(0.0)).alias("cost"))


def spread_nearest(seeds: DataFrame, costs: DataFrame, xi: float, gap: float, hops: int | None = None) -> DataFrame:
    """(concept, energy): seeds (concept, energy) climb a graph of several parents (node, parent, cost), each reaching every node by its cheapest path.

    A path ends at the seed's horizon, or after hops steps without a horizon where
    hops is stated. exp(-cost) of a seed's energy arrives, summed over seeds. Each
    round moves only what got cheaper in the one before, and is written.
    """
    steps = Steps(seeds.sparkSession)
    costs = steps.written(costs, "costs")
    start = seeds.groupBy("concept").agg(F.sum("energy").alias("energy"))
    start = start if hops is not None else start.filter(F.col("energy") >= gap)
    reach = F.lit(math.inf) if hops is not None else horizon(F.col("energy"), xi, gap)
    best = steps.written(start.select(F.col("concept").alias("seed"), F.col("concept").alias("at"), "energy", reach.alias("reach"), F.lit(0.0).alias("d")), "reached")
    front, k = best, 0
    while hops is None or k < hops:
        k += 1
        moved = front.join(costs, F.col("at") == F.col("node")).select("seed", F.col("parent").alias("at"), "energy", "reach", (F.col("d") + F.col("cost")).alias("d")).filter("d <= reach")
        least = moved.groupBy("seed", "at").agg(F.first("energy").alias("energy"), F.first("reach").alias("reach"), F.min("d").alias("d"))
        held = best.select("seed", "at", F.col("d").alias("known"))
        front = steps.written(least.join(held, ["seed", "at"], "left").filter("known IS NULL OR d < known").drop("known"), "front")
        if front.limit(1).count() == 0:
            break
        best = steps.written(best.unionByName(front).groupBy("seed", "at").agg(F.first("energy").alias("energy"), F.first("reach").alias("reach"), F.min("d").alias("d")), "reached")
    out = steps.written(best.groupBy(F.col("at").alias("concept")).agg(F.sum(F.col("energy") * F.exp(-F.col("d"))).alias("energy")), "spread")
    steps.over(out)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "label").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))


def discharge(fired: DataFrame, edges: DataFrame, above: DataFrame, ic: DataFrame, xi: float, gap: float, skip: tuple[str, ...] = ()) -> DataFrame:
    """(concept, energy): one sideways hop along edges, both ways, within the horizon; the greater of what was and what arrives stays."""
    hops = both_ways(edges.filter(~F.col("label").isin(*skip)) if skip else edges).join(fired, F.col("src") == F.col("concept"))
    near = distances(hops.select(F.col("src").alias("a"), F.col("dst").alias("b")), above, ic)
    got = (
        hops.join(near, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")))
        .filter(F.col("jc") <= horizon(F.col("energy"), xi, gap))
        .select(F.col("dst").alias("concept"), (F.col("energy") * F.exp(-F.col("jc"))).alias("energy"))
    )
    return fired.select("concept", "energy").unionByName(got).groupBy("concept").agg(F.max("energy").alias("energy"))


def hop_costs(edges: DataFrame) -> DataFrame:
    """edges with cost: ln of the source's edges of that label."""
    out = edges.groupBy("src", "label").agg(F.count(F.lit(1)).alias("fan"))
    return edges.join(out, ["src", "label"]).withColumn("cost", F.log("fan"))


def associate(fired: DataFrame, edges: DataFrame, xi: float, gap: float) -> DataFrame:
    """(concept, energy): one hop along edges at energy * exp(-cost / xi), kept at or over the gap; the greatest path counts."""
    able = fired.filter(F.col("energy") >= gap)
    hops = hop_costs(edges).join(able, F.col("src") == F.col("concept")).select(F.col("dst").alias("concept"), (F.col("energy") * F.exp(-F.col("cost") / xi)).alias("energy"))
    return fired.select("concept", "energy").unionByName(hops.filter(F.col("energy") >= gap)).groupBy("concept").agg(F.max("energy").alias("energy"))


def rank_fired(fired: DataFrame, ic: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(concept, share, rank_score, salience): share of the positive energy, plus what memory (concept, present, past) adds; salience is energy times IC (1 where unowned)."""
    total = fired.agg(F.sum(F.greatest("energy", F.lit(0.0))).alias("total"))
    out = fired.crossJoin(F.broadcast(total)).join(ic.select(F.col("node").alias("concept"), "ic"), "concept", "left").withColumn("share", F.when(F.col("total") > 0, F.col("energy") / F.col("total")))
    if memory is not None:
        out = out.join(memory, "concept", "left")
        extra = F.coalesce("present", F.lit(0.0)) + F.coalesce("past", F.lit(0.0))
    else:
        extra = F.lit(0.0)
    return out.select("concept", "energy", "share", (F.col("share") + extra).alias("rank_score"), (F.col("energy") * F.coalesce("ic", F.lit(1.0))).alias("salience"))


def signed_sum(fired: DataFrame, edges: DataFrame, signs: DataFrame) -> DataFrame:
    """(concept, energy): couplings with a sign add energy * sign to the far concept (opposites subtract)."""
    far = edges.join(F.broadcast(signs), "label").join(fired, F.col("src") == F.col("concept")).select(F.col("dst").alias("concept"), (F.col("energy") * F.col("sign")).alias("energy"))
    return fired.select("concept", "energy").unionByName(far).groupBy("concept").agg(F.sum("energy").alias("energy"))


def coherent_core(names: DataFrame, anchors: DataFrame, above: DataFrame, ic: DataFrame, xi: float) -> DataFrame:
    """Of each group's names the anchors and those within xi of one; groups of under three names, or without an anchor, stay whole.

    names (grp, name); anchors (grp, anchor).
    """
    pairs = names.join(anchors, "grp").select(F.col("name").alias("a"), F.col("anchor").alias("b"), "grp")
    near = distances(pairs, above, ic)
    least = pairs.join(near, ["a", "b"]).groupBy("grp", F.col("a").alias("name")).agg(F.min("jc").alias("d"))
    sizes = names.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy("grp").agg(F.count(F.lit(1)).alias("n_anchors")), "grp", "left")
    return names.join(sizes, "grp").join(least, ["grp", "name"], "left").filter((F.col("n") < 3) | F.col("n_anchors").isNull() | (F.col("d") <= xi)).select("grp", "name", "d")


def fired_field(words: DataFrame, senses: DataFrame, above: DataFrame, ic: DataFrame) -> DataFrame:
    """(sense, energy): every word's bits split over its senses by the support that other words' senses give them.

    words (word, bits); senses (word, sense, prior). Support is the prior-weighted
    similarity exp(-distance) to all senses of other words; a word whose senses
    get none is split by its priors. A sense of several words adds them up.
    The sums go up the tree once, so no pair of senses is made.
    """
    s = senses.join(words, "word")
    a = s.select("word", "sense", "prior", "bits", F.col("sense").alias("a"))
    own_ic = F.max(F.when(F.col("up") == 0, F.col("anc_ic"))).over(W.partitionBy("word", "a"))
    climb = (
        s.join(above, F.col("sense") == F.col("node")).join(ic.select(F.col("node").alias("ancestor"), F.col("ic").alias("anc_ic")), "ancestor")
        .select("word", F.col("sense").alias("a"), "prior", "ancestor", "up", "anc_ic").withColumn("own_ic", own_ic).withColumn("m", F.col("prior") * F.exp(-F.col("own_ic")))
    )
    under = climb.groupBy("ancestor", "word").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    here = lambda c: F.sum(c).over(W.partitionBy("ancestor")) - F.col(c)
    others = under.select("ancestor", "word", here("n").alias("n"), F.when(here("n") > 0, here("m")).otherwise(0.0).alias("m"))
    # senses of other words whose lowest common ancestor with a is this one: those under it less those under the one below
    below = W.partitionBy("word", "a").orderBy("up")
    less = lambda c: F.col(c) - F.coalesce(F.lag(c).over(below), F.lit(0))
    met = climb.drop("m").join(others, ["ancestor", "word"]).select("word", "a", (2 * F.col("anc_ic") - F.col("own_ic")).alias("e"), less("n").alias("n"), less("m").alias("m")).filter("n > 0")
    support = met.groupBy("word", "a").agg(F.sum(F.col("m") * F.exp("e")).alias("support"))
    per = W.partitionBy("word")
    full = a.join(support, ["word", "a"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    total, prior = F.sum("support").over(per), F.sum("prior").over(per)
    share = F.when(total > 0, F.col("support") / total).otherwise(F.col("prior") / prior)
    return full.select("sense", (share * F.col("bits")).alias("e")).groupBy("sense").agg(F.sum("e").alias("energy"))


def rendered(leads: DataFrame, glosses: DataFrame) -> DataFrame:
    """(concept, sentence, cites): each lead's gloss with a capital and a full stop; of equal glosses the first concept speaks. glosses (concept, gloss)."""
    said = leads.join(glosses, "concept").select("concept", F.trim("gloss").alias("g")).filter("g <> ''")
    one = said.groupBy("g").agg(F.min("concept").alias("concept"), F.array_join(F.array_sort(F.collect_list("concept")), ",").alias("cites"))
    return one.select("concept", F.concat(F.upper(F.substring("g", 1, 1)), F.expr("substring(g, 2)"), F.when(F.col("g").endswith("."), "").otherwise(".")).alias("sentence"), "cites")
