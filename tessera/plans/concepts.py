"""Queries from texts to concepts, and of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.model import ARTIFACTS_SQL, EDGES_SQL, artifacts, edges, table
from tessera.operators import activation as A
from tessera.operators import frames as R
from tessera.plans import lexical
from tessera.plans.sql import TOKENS, signal_ctes


def _lexicon(spark, sf):
    """Part names as compounds with their brands as senses, the second words with their types; priors by rank."""
    from pyspark.sql import Window as W

    p = table(spark, sf, "part")
    several = p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit("brand-"), "p_brand").alias("concept")).distinct()
    single = p.select(F.split("p_name", " ")[1].alias("name"), F.concat(F.lit("type-"), "p_type").alias("concept")).distinct()
    rank = F.row_number().over(W.partitionBy("name").orderBy("concept"))
    return several.unionByName(single).withColumn("prior", 1 / rank)


def f21_seeds(spark, sf):
    """Compounds, plurals of single words, and words that are no names."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat("p_name", F.lit(" here"))).when(k % 3 == 1, F.concat(F.lit("Two "), F.split("p_name", " ")[1], F.lit("s"))).otherwise(F.concat(F.split("p_name", " ")[0], F.lit(" thing")))
    lexicon = _lexicon(spark, sf)
    bits = lexicon.select("name").distinct().filter(F.length("name") % 2 == 0).select("name", F.length("name").cast("double").alias("bits"))
    s = A.seeds_from_text(table(spark, sf, "part").select(k.alias("id"), text.alias("text")), lexicon, bits)
    return s.select("id", "concept", F.round("energy", 6).alias("energy"))


def n1_artifact_seeds(spark, sf):
    """Parts with a concept of their own, with lemmas, and with a text alone."""
    k = F.col("p_partkey")
    a = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("own-"), k)).alias("concept"), F.when(k % 4 == 1, F.array(F.split("p_name", " ")[1])).otherwise(F.array().cast("array<string>")).alias("lemmas"), F.col("p_name").alias("text")
    )
    return A.seeds_from_artifact(a, _lexicon(spark, sf)).select("id", "concept", F.round("energy", 6).alias("energy"))


def g8_operator_concepts(spark, sf):
    p = table(spark, sf, "part")
    attested = p.groupBy(F.split("p_name", " ")[1].alias("form"), F.concat(F.lit("type-"), "p_type").alias("concept")).agg(F.sum((F.col("p_size") > 48).cast("long")).alias("count"))
    return A.operator_concepts(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), attested)


def g7_stated_relations(spark, sf):
    """For every nation the relations that stand out, by what its customers and suppliers weigh."""
    leads = table(spark, sf, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("lead"))
    field = table(spark, sf, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("concept"), (F.col("c_acctbal") / 1000).alias("energy")).unionByName(
        table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("concept"), (F.col("s_acctbal") / 500).alias("energy"))
    )
    operator = spark.createDataFrame([("lives_in", 1.0), ("based_in", 2.0)], "label string, energy double")
    return A.stated_relations(leads, edges(spark, sf), field, operator)


def _benchmark_lexicon(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("name")).distinct()
    return w.select("name", F.concat(F.lit("c-"), "name").alias("concept"), F.lit(1.0).alias("prior"))


def g10_offers(spark, sf):
    ops = artifacts(spark, sf).filter("content_type = 'operator'").select("id", F.col("content").alias("text"))
    return A.offers_table(ops, _benchmark_lexicon(spark, sf)).select("id", F.array_join("concepts", ",").alias("concepts"))


def n6_projected(spark, sf):
    m = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("modifier"))
    return A.projected_positions(m, edges(spark, sf), ("based_in",))


def n7_subjects(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return A.subject_concepts(items, _benchmark_lexicon(spark, sf), lexical.g19_salient_terms(spark, sf).select("id", "term"))


def _frames(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))


def f14_frames(spark, sf):
    """Vectors as coordinates of concepts, scaled by the root of their energy; frames by label."""
    e = table(spark, sf, "embeddings")
    concept = F.concat(F.lit("v-"), "vec_id").alias("concept")
    field = e.select(F.col("label").alias("frame"), F.col("vec_id").alias("ord"), concept, (F.col("vec_id") % 7 / 7).alias("energy"))
    built = R.built(field, e.filter("vec_id % 5 <> 0").select(concept, F.col("embedding").alias("vec")))
    return built.select("frame", "ord", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


def f16_bands(spark, sf):
    n = _frames(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("t"))
    return n.select("label", F.round(R.concentration_band(F.col("t"), F.lit(64)), 9).alias("band"))


def o10_near(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.near_pairs(v, 1.1).select("a", "b", F.round("d", 6).alias("d"))


def o20_noise(spark, sf):
    v = _frames(spark, sf).select("label", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("e"))
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))
    return n.select("label", F.round(R.float_noise(F.col("n") * 64, F.col("e")) * 1e9, 6).alias("nano"))


def _mixed(spark, sf):
    """Order lines of every tenth of the suppliers as frames, in order: quantity, price, discount, tax and what is paid."""
    x = table(spark, sf, "lineitem")
    vec = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return x.select((F.col("l_suppkey") % 10).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), vec.alias("vec"))


def o_records(spark, sf):
    """All readings of the order lines' frames."""
    r = R.frame_records(_mixed(spark, sf), "frame", "ord", "vec")
    return r.select("frame", *[F.round(c, 6).alias(c) if t == "double" else c for c, t in r.dtypes if c != "frame"])


def f12_readings(spark, sf):
    r = R.mode_readings(_mixed(spark, sf), "frame", "ord", "vec")
    return r.select("frame", "nth", F.round("energy", 6).alias("energy"), "peak", "n_rows")


def w13_scales(spark, sf):
    return R.scale_profile(_mixed(spark, sf), "frame", "ord", "vec", [8, 32, 128, 256])


_QUERIES = (
    f21_seeds, n1_artifact_seeds, g8_operator_concepts, g7_stated_relations, g10_offers, n6_projected, n7_subjects, f14_frames, f16_bands, o10_near, o20_noise, o_records,
    f12_readings, w13_scales,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    lexicon = """lex AS (SELECT *, 1 / row_number() OVER (PARTITION BY name ORDER BY concept) AS prior FROM (
        SELECT DISTINCT replace(p_name, ' ', '_') AS name, 'brand-' || p_brand AS concept FROM part UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), 'type-' || p_type FROM part))"""
    t = TOKENS.format
    return {
        "f21_seeds": f"""WITH {lexicon}, n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN split_part(p_name, ' ', 2) END AS name FROM part)
            SELECT id, concept, round(prior * CASE WHEN length(name) % 2 = 0 THEN length(name) ELSE 1 END, 6) AS energy FROM n JOIN lex USING (name)""",
        "n1_artifact_seeds": f"""WITH {lexicon}, n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', '_') END AS name FROM part)
            SELECT id, concept, round(prior, 6) AS energy FROM n JOIN lex USING (name) UNION ALL SELECT id, 'own-' || id, 1.0::DOUBLE FROM n WHERE name IS NULL""",
        "g8_operator_concepts": """WITH f AS (SELECT split_part(p_name, ' ', 2) AS form, 'type-' || p_type AS concept FROM part GROUP BY 1, 2 HAVING count(*) FILTER (p_size > 48) > 0)
            SELECT p_partkey AS id, concept FROM part JOIN f ON form = split_part(p_name, ' ', 2)""",
        "g7_stated_relations": f"""WITH e AS ({EDGES_SQL}), x AS (
            SELECT dst AS lead, label, src AS far, round(sqrt(c_acctbal / 1000), 9) AS w FROM e JOIN customer ON src = 'customer-' || c_custkey WHERE label = 'lives_in' AND c_acctbal > 0
            UNION ALL SELECT dst, label, src, round(sqrt(s_acctbal / 500 * 2), 9) FROM e JOIN supplier ON src = 'supplier-' || s_suppkey WHERE label = 'based_in' AND s_acctbal > 0),
            y AS (SELECT *, label || '|' || far AS ident FROM x), {signal_ctes('y', 'lead', 'w', 'ident')}
            SELECT r.key AS lead, split_part(ident, '|', 1) AS label, split_part(ident, '|', 2) AS far, x AS weight FROM rows r JOIN cut USING (key) WHERE r.nth <= k""",
        "g10_offers": f"""WITH l AS (SELECT DISTINCT unnest({t('text')}) AS w FROM benchmark), a AS ({ARTIFACTS_SQL}), o AS (SELECT id, unnest({t('content')}) AS w FROM a WHERE content_type = 'operator')
            SELECT a.id, coalesce(string_agg(DISTINCT 'c-' || l.w, ',' ORDER BY 'c-' || l.w), '') AS concepts FROM a LEFT JOIN o USING (id) LEFT JOIN l USING (w) WHERE content_type = 'operator' GROUP BY 1""",
        "n6_projected": "SELECT 'supplier-' || s_suppkey AS modifier, 'nation-' || s_nationkey AS noun FROM supplier WHERE s_suppkey % 2 = 0",
        "n7_subjects": f"WITH s AS ({lexical.oracle_sql()['g19_salient_terms']}) SELECT DISTINCT id, 'c-' || term AS concept FROM s",
        "f14_frames": """WITH r AS (SELECT label AS frame, vec_id AS ord, round(vec_id % 7 / 7 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings WHERE vec_id % 7 > 0 AND vec_id % 5 <> 0)
            SELECT * FROM r WHERE frame IN (SELECT frame FROM r GROUP BY 1 HAVING count(*) >= 4)""",
        "f16_bands": "SELECT label, round(2 * (sqrt(64 / count(*)) + 64 / count(*)), 9) AS band FROM embeddings GROUP BY 1",
        "o10_near": """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT a, b, round(d, 6) AS d FROM p WHERE d <= 1.1""",
        "o20_noise": "SELECT label, round(2.220446049250313e-16::DOUBLE * (count(*) * 64) * sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 1e9::DOUBLE, 6) AS nano FROM embeddings GROUP BY 1",
    }
