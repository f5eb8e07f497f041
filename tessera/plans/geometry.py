"""Queries of taxonomy geometry and propagation. The tree is root > region > nation > customer; the graph adds market segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.model import EDGES_SQL, TAXONOMY_DAG_SQL, TAXONOMY_SQL, edges, table, taxonomy, taxonomy_dag
from tessera.operators import graph as G
from tessera.operators import resolve
from tessera.steps import written

#: Attenuation length and floor used by the propagation queries.
XI, GAP = 2.0, 0.05


def _tree(spark, sf, of=taxonomy):
    """(taxonomy, closure, information content), each written once and read back by all that follows."""
    tree = written(of(spark, sf), "taxonomy")
    above = G.closure(tree)
    return tree, above, written(G.information_content(tree, above), "information")


def _seeds(spark, sf):
    """All customers as seeds, with energies of one upwards."""
    return table(spark, sf, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("concept"), (1 + F.col("c_custkey") / 10).alias("energy"))


def a12_closure(spark, sf):
    return G.closure(taxonomy(spark, sf))


def a12_information_content(spark, sf):
    _, _, ic = _tree(spark, sf)
    return ic.select("node", "cum", F.round("ic", 6).alias("ic"), F.round("se", 6).alias("se"))


def a13_resnik(spark, sf):
    tree = taxonomy(spark, sf)
    return G.resnik(tree, G.closure(tree)).select("node", F.round("ic", 6).alias("ic"), "status")


def a11_geometry(spark, sf):
    tree, _, ic = _tree(spark, sf)
    g = G.geometry(tree, ic)
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


def f7_distances(spark, sf):
    """Every pair of nations, and of nations and regions."""
    tree, above, ic = _tree(spark, sf)
    n = tree.filter("node LIKE 'nation-%' OR node LIKE 'region-%'").select("node")
    pairs = n.select(F.col("node").alias("a")).crossJoin(F.broadcast(n.select(F.col("node").alias("b")))).filter("a < b")
    return G.distances(pairs, above, ic).select("a", "b", F.round("jc", 6).alias("jc"))


def f8_attenuation(spark, sf):
    o = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("d"), ((F.pmod("c_custkey", F.lit(10)) + 1) / 20).alias("w"))
    return o.select("c_custkey", F.round(G.attenuate(F.col("d"), XI), 6).alias("attenuated"), F.round(G.horizon(F.col("w"), XI, GAP * 3), 6).alias("horizon"))


def f9_hop_costs(spark, sf):
    return G.hop_costs(edges(spark, sf)).groupBy("label", "fan").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cost"), 6).alias("cost"))


def j10_propagate(spark, sf):
    tree, above, ic = _tree(spark, sf)
    targets = tree.filter("node LIKE 'nation-%'").select(F.col("node").alias("target"), F.lit(1.0).alias("weight"))
    p = G.propagate(_seeds(spark, sf), targets, above, ic, XI, GAP)
    return p.select("target", F.round("energy", 6).alias("energy"), F.round("nearest", 6).alias("nearest"))


def g1_spread(spark, sf):
    _, above, ic = _tree(spark, sf)
    return G.spread(_seeds(spark, sf), above, ic, XI, GAP).select("concept", F.round("energy", 6).alias("energy"))


def g2_discharge(spark, sf):
    """Sideways along orders that customers of one nation share a segment with: here along the based-in and lives-in edges."""
    _, above, ic = _tree(spark, sf)
    e = edges(spark, sf).filter("label IN ('lives_in', 'part_of')")
    return G.discharge(_seeds(spark, sf), e, above, ic, XI, GAP, skip=("part_of",)).select("concept", F.round("energy", 6).alias("energy"))


def g3_associate(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("concept"), F.lit(1.0).alias("energy"))
    return G.associate(s, edges(spark, sf), XI, 0.01).select("concept", F.round("energy", 6).alias("energy"))


def j9_signed(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("concept"), F.lit(1.0).alias("energy"))
    signs = spark.createDataFrame([("based_in", 1.0), ("supplies", -0.5)], "label string, sign double")
    return G.signed_sum(s, edges(spark, sf), signs).select("concept", F.round("energy", 6).alias("energy"))


def w5_rank_fired(spark, sf):
    _, above, ic = _tree(spark, sf)
    fired = G.spread(_seeds(spark, sf), above, ic, XI, GAP)
    r = G.rank_fired(fired, ic)
    return r.select("concept", *[F.round(c, 6).alias(c) for c in ("energy", "share", "rank_score", "salience")])


def w12_sense_prior(spark, sf):
    """Parts as senses of their brand, in key order: tagged ones weigh 1 + count, the others 1 / (1 + rank)."""
    from pyspark.sql import Window as W

    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("tagged"))
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return p.withColumn("sense_rank", rank).select("p_partkey", "sense_rank", F.round(F.when(F.col("tagged").isNotNull(), 1.0 + F.col("tagged")).otherwise(1 / (1 + F.col("sense_rank"))), 6).alias("prior"))


def f23_coherent_core(spark, sf):
    """Customers by market segment and key decade, held against the first customer of each group."""
    tree, above, ic = _tree(spark, sf)
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 20)).alias("grp"), "c_custkey")
    names = c.select("grp", F.concat(F.lit("customer-"), "c_custkey").alias("name"))
    anchors = c.groupBy("grp").agg(F.min("c_custkey").alias("k")).select("grp", F.concat(F.lit("customer-"), "k").alias("anchor"))
    return G.coherent_core(names, anchors, above, ic, 8.5).select("grp", "name", F.round("d", 6).alias("d"))


def g4_fired_field(spark, sf):
    """Market segments as words, customers as their senses, priors by rank."""
    from pyspark.sql import Window as W

    _, above, ic = _tree(spark, sf)
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    n = c.groupBy(F.col("c_mktsegment").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    words = n.select("word", (-F.log2(F.col("n") / F.sum("n").over(W.partitionBy()))).alias("bits"))
    rank = F.row_number().over(W.partitionBy("c_mktsegment").orderBy("c_custkey"))
    senses = c.select(F.col("c_mktsegment").alias("word"), F.concat(F.lit("customer-"), "c_custkey").alias("sense"), (1 / rank).alias("prior"))
    return G.fired_field(words, senses, above, ic).select("sense", F.round("energy", 6).alias("energy"))


def _recognised(spark, sf):
    """Seeds spread over the tree, ranked, and cut where the signal ends."""
    _, above, ic = _tree(spark, sf)
    fired = G.spread(_seeds(spark, sf), above, ic, XI, GAP)
    ranked = G.rank_fired(fired, ic).select(F.lit("q").alias("q"), "concept", F.round("rank_score", 9).alias("score"))
    return resolve.leading(ranked, "q", "score", "concept")


def g5_recognise(spark, sf):
    return _recognised(spark, sf).select("concept", "rank", F.round("score", 6).alias("score"))


def g6_compose(spark, sf):
    """The leads said by name, with what they cite."""
    names = (
        table(spark, sf, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("concept"), F.lower("n_name").alias("gloss"))
        .unionByName(table(spark, sf, "region").select(F.concat(F.lit("region-"), "r_regionkey").alias("concept"), F.lower("r_name").alias("gloss")))
        .unionByName(table(spark, sf, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("concept"), F.lower("c_mktsegment").alias("gloss")))
    )
    return G.rendered(_recognised(spark, sf).select("concept"), names)


def a11_forest(spark, sf):
    """Geometry with the regions as roots: the greatest span over all of them."""
    tree = taxonomy(spark, sf).filter("node <> 'root'").withColumn("parent", F.when(F.col("parent") != "root", F.col("parent")))
    tree = written(tree, "forest")
    above = G.closure(tree)
    g = G.forest_geometry(tree, above, written(G.information_content(tree, above), "information"))
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


def a12_dag_information(spark, sf):
    """Information content where a customer has two parents: every descendant counts once."""
    _, _, ic = _tree(spark, sf, taxonomy_dag)
    return ic.select("node", "cum", F.round("ic", 6).alias("ic"), F.round("se", 6).alias("se"))


def a13_measured(spark, sf):
    """Customers as words: some without a part of speech, some beyond the table, some never ordered."""
    tree = taxonomy(spark, sf)
    ic = G.resnik(tree, G.closure(tree)).filter("status = 'measured'").select("node", "ic")
    k = F.col("c_custkey")
    words = table(spark, sf, "customer").select(F.concat(F.lit("customer-"), k).alias("word"), F.when(k % 7 != 0, F.lit("n")).alias("pos"), F.when(k % 11 == 0, k + 10**9).otherwise(k).alias("at"))
    return G.measured(words, ic, 10**9).select("word", F.round("ic", 6).alias("ic"), "status")


def g1_spread_dag(spark, sf):
    """Seeds climb to all their parents, each reaching a node by its cheapest path."""
    dag, _, ic = _tree(spark, sf, taxonomy_dag)
    return G.spread_nearest(_seeds(spark, sf), G.step_costs(dag, ic), XI, GAP).select("concept", F.round("energy", 6).alias("energy"))


def g1_spread_hops(spark, sf):
    """One step up without a horizon."""
    dag, _, ic = _tree(spark, sf, taxonomy_dag)
    return G.spread_nearest(_seeds(spark, sf), G.step_costs(dag, ic), XI, GAP, hops=1).select("concept", F.round("energy", 6).alias("energy"))


def w5_rank_with_memory(spark, sf):
    """Shares plus what memory holds of nations, present and past."""
    _, above, ic = _tree(spark, sf)
    fired = G.spread(_seeds(spark, sf), above, ic, XI, GAP)
    n = F.col("n_nationkey")
    memory = table(spark, sf, "nation").select(F.concat(F.lit("nation-"), n).alias("concept"), (n / 100).alias("present"), F.when(n % 2 == 0, n / 200).alias("past"))
    return G.rank_fired(fired, ic, memory).select("concept", *[F.round(c, 6).alias(c) for c in ("share", "rank_score")])


_QUERIES = (
    a11_forest, a12_dag_information, a13_measured, g1_spread_dag, g1_spread_hops, w5_rank_with_memory,
    a12_closure, a12_information_content, a13_resnik, a11_geometry, f7_distances, f8_attenuation, f9_hop_costs, j10_propagate, g1_spread,
    g2_discharge, g3_associate, j9_signed, w5_rank_fired, w12_sense_prior, f23_coherent_core, g4_fired_field, g5_recognise, g6_compose,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    tree = f"""tree AS ({TAXONOMY_SQL}),
        up AS (SELECT node, node AS ancestor, 0 AS up FROM tree
               UNION ALL SELECT u.node, t.parent, u.up + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL)"""
    ic = f"""{tree},
        cum AS (SELECT ancestor AS node, sum(own + 1)::BIGINT AS cum, sum(own)::BIGINT AS raw FROM up JOIN tree USING (node) GROUP BY 1),
        ic AS (SELECT node, cum, raw, 0.0 - ln(cum / (SELECT max(cum) FROM cum)) AS ic FROM cum)"""
    jc = f"""{ic},
        lca AS (SELECT x.node AS a, y.node AS b, max(ic) AS lca FROM up x JOIN up y ON x.ancestor = y.ancestor JOIN ic ON ic.node = x.ancestor WHERE {{pairs}} GROUP BY 1, 2),
        jc AS (SELECT a, b, ia.ic + ib.ic - 2 * lca AS jc FROM lca JOIN ic ia ON ia.node = a JOIN ic ib ON ib.node = b)"""
    seeds = "seeds AS (SELECT 'customer-' || c_custkey AS concept, 1 + c_custkey / 10 AS energy FROM customer)"
    sup = "seeds AS (SELECT 'supplier-' || s_suppkey AS concept, 1.0::DOUBLE AS energy FROM supplier)"
    spread = f"""{ic}, {seeds},
        climb AS (SELECT s.concept, energy, ancestor, greatest(i.ic - j.ic, 0) AS d FROM seeds s JOIN up ON up.node = s.concept JOIN ic i ON i.node = s.concept JOIN ic j ON j.node = ancestor),
        fired AS (SELECT ancestor AS concept, sum(energy * exp(-d)) AS energy FROM climb WHERE energy >= {GAP} AND d <= {XI} * ln(energy / {GAP}) GROUP BY 1)"""
    cut = f"""{spread},
        k AS (SELECT concept, round(energy / sum(energy) OVER (), 9) AS x FROM fired),
        o AS (SELECT *, row_number() OVER (ORDER BY x DESC, concept) AS rk, count(*) OVER () AS n FROM k),
        su AS (SELECT *, sum(x) OVER (ORDER BY rk) AS s, sum(x) OVER () AS t, sum(x * x) OVER () AS q FROM o),
        et AS (SELECT rk, n, rk * (n - rk) / n * (s / rk - (t - s) / (n - rk)) ** 2 / (q - t * t / n) AS e FROM su WHERE rk < n),
        en AS (SELECT CASE WHEN round(max(e), 12) > round((SELECT max(j * (n - j) / n * (n / 2) ** 2 / (n * (n * n - 1) / 12)) FROM (SELECT rk AS j, n FROM et)), 12) THEN arg_max(rk, e) ELSE any_value(n) END AS k FROM et),
        lead AS (SELECT o.* FROM o, en WHERE rk <= k)"""
    dag = f"""dag AS ({TAXONOMY_DAG_SQL}), own AS (SELECT node, max(own) AS own FROM dag GROUP BY 1),
        dup AS (SELECT node, node AS ancestor FROM own UNION SELECT u.node, d.parent FROM dup u JOIN dag d ON d.node = u.ancestor WHERE d.parent IS NOT NULL),
        dcum AS (SELECT ancestor AS node, sum(own + 1)::BIGINT AS cum FROM dup JOIN own USING (node) GROUP BY 1),
        dic AS (SELECT node, cum, 0.0 - ln(cum / (SELECT max(cum) FROM dcum)) AS ic FROM dcum),
        cost AS (SELECT DISTINCT d.node, d.parent, greatest(c.ic - p.ic, 0) AS cost FROM dag d JOIN dic c ON c.node = d.node JOIN dic p ON p.node = d.parent), {seeds}"""
    forest = ic.replace(f"tree AS ({TAXONOMY_SQL})", f"tree AS (SELECT node, nullif(parent, 'root') AS parent, own FROM ({TAXONOMY_SQL}) WHERE node <> 'root')")
    return {
        "a11_forest": f"""WITH RECURSIVE {forest},
            d AS (SELECT c.ic - p.ic AS d FROM tree t JOIN ic c ON c.node = t.node JOIN ic p ON p.node = t.parent),
            r AS (SELECT 2 * (max(i.ic) - any_value(q.ic)) AS span FROM up JOIN tree t ON t.node = ancestor AND t.parent IS NULL JOIN ic i ON i.node = up.node JOIN ic q ON q.node = ancestor GROUP BY ancestor),
            g AS (SELECT (SELECT median(d) FROM d WHERE d > 0) AS d_edge, (SELECT max(span) FROM r) AS d_max)
            SELECT round(d_edge, 6) AS d_edge, round(d_max, 6) AS d_max, round(ln(d_max / d_edge), 6) AS mu, round(1 / ln(d_max / d_edge), 6) AS xi, round(exp(-d_max * ln(d_max / d_edge)), 6) AS gap FROM g""",
        "a12_dag_information": f"WITH RECURSIVE {dag} SELECT node, cum, round(ic, 6) AS ic, round(sqrt((1 - cum / (SELECT max(cum) FROM dcum)) / cum), 6) AS se FROM dic",
        "a13_measured": f"""WITH RECURSIVE {ic}, w AS (SELECT 'customer-' || c_custkey AS word, c_custkey AS k FROM customer),
            s AS (SELECT word, CASE WHEN k % 7 = 0 THEN 'no_pos' WHEN k % 11 = 0 THEN 'out_of_range' WHEN raw > 0 THEN 'measured' ELSE 'zero_frequency' END AS status, raw FROM w JOIN cum ON node = word)
            SELECT word, CASE WHEN status = 'measured' THEN round(0.0 - ln(raw / (SELECT max(raw) FROM cum)), 6) END AS ic, status FROM s""",
        "g1_spread_dag": f"""WITH RECURSIVE {dag},
            w AS (SELECT concept AS seed, concept AS here, energy, 0.0::DOUBLE AS d FROM seeds WHERE energy >= {GAP}
                  UNION ALL SELECT seed, parent, energy, d + cost.cost FROM w JOIN cost ON node = here WHERE d + cost.cost <= {XI} * ln(energy / {GAP})),
            n AS (SELECT seed, here, any_value(energy) AS energy, min(d) AS d FROM w GROUP BY 1, 2)
            SELECT here AS concept, round(sum(energy * exp(-d)), 6) AS energy FROM n GROUP BY 1""",
        "g1_spread_hops": f"""WITH RECURSIVE {dag}, n AS (SELECT concept AS here, energy, 0.0::DOUBLE AS d FROM seeds UNION ALL SELECT parent, energy, cost.cost FROM seeds JOIN cost ON node = concept)
            SELECT here AS concept, round(sum(energy * exp(-d)), 6) AS energy FROM n GROUP BY 1""",
        "w5_rank_with_memory": f"""WITH RECURSIVE {spread}
            SELECT concept, round(energy / sum(energy) OVER (), 6) AS share,
                   round(energy / sum(energy) OVER () + coalesce(n_nationkey / 100, 0) + coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 200 END, 0), 6) AS rank_score
            FROM fired LEFT JOIN nation ON concept = 'nation-' || n_nationkey""",
        "a12_closure": f"WITH RECURSIVE {tree} SELECT * FROM up",
        "a12_information_content": f"WITH RECURSIVE {ic} SELECT node, cum, round(ic, 6) AS ic, round(sqrt((1 - cum / (SELECT max(cum) FROM cum)) / cum), 6) AS se FROM ic",
        "a13_resnik": f"WITH RECURSIVE {ic} SELECT node, CASE WHEN raw > 0 THEN round(0.0 - ln(raw / (SELECT max(raw) FROM cum)), 6) END AS ic, CASE WHEN raw > 0 THEN 'measured' ELSE 'zero_frequency' END AS status FROM ic",
        "a11_geometry": f"""WITH RECURSIVE {ic},
            d AS (SELECT c.ic - p.ic AS d FROM tree t JOIN ic c ON c.node = t.node JOIN ic p ON p.node = t.parent),
            g AS (SELECT (SELECT median(d) FROM d WHERE d > 0) AS d_edge, 2 * (SELECT max(ic) FROM ic) - 2 * (SELECT ic FROM ic WHERE node = 'root') AS d_max)
            SELECT round(d_edge, 6) AS d_edge, round(d_max, 6) AS d_max, round(ln(d_max / d_edge), 6) AS mu, round(1 / ln(d_max / d_edge), 6) AS xi, round(exp(-d_max * ln(d_max / d_edge)), 6) AS gap FROM g""",
        "f7_distances": f"WITH RECURSIVE {jc.format(pairs='x.node < y.node AND x.node SIMILAR TO ' + chr(39) + '(nation|region)-.*' + chr(39) + ' AND y.node SIMILAR TO ' + chr(39) + '(nation|region)-.*' + chr(39))} SELECT a, b, round(jc, 6) AS jc FROM jc",
        "f8_attenuation": f"""SELECT c_custkey, round(exp(-greatest(c_acctbal / 1000, 0) / {XI}), 6) AS attenuated,
            round(CASE WHEN (c_custkey % 10 + 1) / 20 >= {GAP * 3} THEN {XI} * ln((c_custkey % 10 + 1) / 20 / {GAP * 3}) ELSE 0 END, 6) AS horizon FROM customer""",
        "f9_hop_costs": f"SELECT label, fan, count(*) AS n, round(max(ln(fan)), 6) AS cost FROM (SELECT label, count(*) OVER (PARTITION BY src, label) AS fan FROM ({EDGES_SQL})) GROUP BY 1, 2",
        "j10_propagate": f"""WITH RECURSIVE {jc.format(pairs="x.node LIKE 'customer-%' AND y.node LIKE 'nation-%'")}, {seeds},
            p AS (SELECT b AS target, sum(energy * exp(-greatest(jc, 0) / {XI})) AS e, min(jc) AS near FROM jc JOIN seeds ON a = concept WHERE exp(-greatest(jc, 0) / {XI}) >= {GAP} GROUP BY 1)
            SELECT node AS target, round(coalesce(e, 0), 6) AS energy, CASE WHEN near IS NULL THEN 'inf'::DOUBLE ELSE round(near, 6) END AS nearest FROM tree LEFT JOIN p ON target = node WHERE node LIKE 'nation-%'""",
        "g1_spread": f"WITH RECURSIVE {spread} SELECT concept, round(energy, 6) AS energy FROM fired",
        "g2_discharge": f"""WITH RECURSIVE {jc.format(pairs="x.node LIKE 'customer-%' AND y.node LIKE 'nation-%'")}, {seeds},
            hop AS (SELECT dst AS concept, energy * exp(-jc) AS energy FROM ({EDGES_SQL}) e JOIN seeds ON src = concept JOIN jc ON a = src AND b = dst
                    WHERE label = 'lives_in' AND energy >= {GAP} AND jc <= {XI} * ln(energy / {GAP}))
            SELECT concept, round(max(energy), 6) AS energy FROM (SELECT * FROM seeds UNION ALL SELECT * FROM hop) GROUP BY 1""",
        "g3_associate": f"""WITH {sup}, e AS (SELECT *, ln(count(*) OVER (PARTITION BY src, label)) AS cost FROM ({EDGES_SQL})),
            h AS (SELECT dst AS concept, energy * exp(-cost / {XI}) AS energy FROM e JOIN seeds ON src = concept)
            SELECT concept, round(max(energy), 6) AS energy FROM (SELECT * FROM seeds UNION ALL SELECT * FROM h WHERE energy >= 0.01) GROUP BY 1""",
        "j9_signed": f"""WITH {sup}, h AS (SELECT dst AS concept, energy * CASE label WHEN 'based_in' THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS energy FROM ({EDGES_SQL}) JOIN seeds ON src = concept WHERE label IN ('based_in', 'supplies'))
            SELECT concept, round(sum(energy), 6) AS energy FROM (SELECT * FROM seeds UNION ALL SELECT * FROM h) GROUP BY 1""",
        "w5_rank_fired": f"""WITH RECURSIVE {spread}
            SELECT concept, round(energy, 6) AS energy, round(energy / sum(energy) OVER (), 6) AS share, round(energy / sum(energy) OVER (), 6) AS rank_score, round(energy * ic, 6) AS salience FROM fired JOIN ic ON node = concept""",
        "g4_fired_field": f"""WITH RECURSIVE {jc.format(pairs="x.node IN (SELECT sense FROM senses) AND y.node IN (SELECT sense FROM senses)")},
            sup AS (SELECT a.word, a.sense, a.prior, sum(CASE WHEN b.word <> a.word THEN b.prior * exp(-greatest(jc, 0)) END) AS s FROM senses a JOIN jc ON jc.a = a.sense JOIN senses b ON b.sense = jc.b GROUP BY ALL)
            SELECT sense, round(bits * coalesce(s, 0) / sum(s) OVER (PARTITION BY word), 6) AS energy FROM sup JOIN words USING (word)""".replace(
            "WITH RECURSIVE ", """WITH RECURSIVE words AS (SELECT c_mktsegment AS word, -log2(count(*) / (SELECT count(*) FROM customer)) AS bits FROM customer GROUP BY 1),
            senses AS (SELECT c_mktsegment AS word, 'customer-' || c_custkey AS sense, 1 / row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS prior FROM customer), """
        ),
        "g5_recognise": f"WITH RECURSIVE {cut} SELECT concept, (rk - 1)::INT AS rank, round(x, 6) AS score FROM lead",
        "g6_compose": f"""WITH RECURSIVE {cut},
            names AS (SELECT 'nation-' || n_nationkey AS concept, lower(n_name) AS g FROM nation UNION ALL SELECT 'region-' || r_regionkey, lower(r_name) FROM region UNION ALL SELECT 'customer-' || c_custkey, lower(c_mktsegment) FROM customer)
            SELECT min(concept) AS concept, upper(g[1]) || g[2:] || '.' AS sentence, string_agg(concept, ',' ORDER BY concept) AS cites FROM lead JOIN names USING (concept) GROUP BY g""",
        "w12_sense_prior": """SELECT p_partkey, r AS sense_rank, round(CASE WHEN p_size > 25 THEN 1.0 + p_size ELSE 1 / (1 + r) END, 6) AS prior
            FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)""",
        "f23_coherent_core": f"""WITH RECURSIVE {jc.format(pairs="x.node IN (SELECT name FROM names) AND y.node IN (SELECT anchor FROM anchors)")}
            SELECT n.grp, n.name, round(jc, 6) AS d FROM names n JOIN anchors USING (grp) JOIN (SELECT grp, count(*) AS n FROM names GROUP BY 1) s USING (grp) JOIN jc ON a = n.name AND b = anchor WHERE s.n < 3 OR jc <= 8.5""".replace(
            "WITH RECURSIVE ", "WITH RECURSIVE g AS (SELECT c_mktsegment || '-' || (c_custkey // 20) AS grp, c_custkey AS k FROM customer), names AS (SELECT grp, 'customer-' || k AS name FROM g), anchors AS (SELECT grp, 'customer-' || min(k) AS anchor FROM g GROUP BY 1), "
        ),
    }
