"""Queries of cuts, vectors and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.model import table
from tessera.operators import resolve as R
from tessera.plans.lexical import _BM25_SQL, _top


def w2_signal_end(spark, sf):
    """Where the signal ends in the top hits of every benchmark item."""
    s = R.signal_end(_top(spark, sf), "query_id", "score", "id")
    return s.select("query_id", "n", "k", F.round("eta2", 6).alias("eta2"), F.round("null_eta2", 6).alias("null_eta2"), "separated")


def w4_leading_hits(spark, sf):
    return R.leading(_top(spark, sf).drop("rank"), "query_id", "score", "id").select("query_id", "id", "rank")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _anchors(spark, sf):
    """The first vector of every label: as many as there are labels."""
    v = _vectors(spark, sf)
    first = v.groupBy("label").agg(F.min("id").alias("id"))
    return v.join(first, ["label", "id"]).select(F.col("label").alias("cell"), F.col("vec").alias("anchor"))


def k10_cells(spark, sf):
    return R.cells(_vectors(spark, sf), _anchors(spark, sf)).select("id", "cell")


def t2k_cosine_top(spark, sf):
    """Every vector whose id is divisible by 20 against all vectors."""
    held = _vectors(spark, sf)
    return R.top_by_cosine(held.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), held, 5)


def w8_belonging(spark, sf):
    """Vectors of one label and one hundred of ids as a frame."""
    v = _vectors(spark, sf).withColumn("frame", F.concat_ws("-", "label", F.floor(F.col("id") / 100)))
    b = R.belonging(v, "frame", "id", "vec")
    return b.select("frame", "id", F.round("agreement", 6).alias("agreement"), F.round("z", 4).alias("z"))


def w9_revisions(spark, sf):
    """Vectors of a frame as revisions of one root: those that answer."""
    v = _vectors(spark, sf).withColumn("frame", F.concat_ws("-", "label", F.floor(F.col("id") / 100)))
    z = R.belonging(v, "frame", "id", "vec").withColumn("z", F.round("z", 4)).withColumn("root", F.concat_ws("/", "frame", F.pmod("id", F.lit(3))))
    return R.revisions_that_answer(z, "root", "id").select("root", "id")


def w11_monotone_hull(spark, sf):
    """Daily mean values of each event type, scaled, as decay curves."""
    e = table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("lag")).agg((F.avg("value") / 50 - 0.5).alias("c"))
    h = R.monotone_hull(e, "event_type", "lag", "c")
    return h.select("event_type", "lag", F.round("hull", 6).alias("hull"), "clipped")


def f6_hash_embedding(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", R.hash_embed(64)("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(R.dot(F.col("v"), F.col("v")), 6).alias("norm2"))


def a18_pooled_gram(spark, sf):
    """Products of all elements, pooled per label."""
    g = R.gram(_vectors(spark, sf), "label", "vec")
    return g.select("label", "i", "j", "n", (F.round("xx", 4) + 0.0).alias("xx"))


def f15_frame_reads(spark, sf):
    r = R.frame_reads(_vectors(spark, sf), "label", "id", "vec")
    return r.select("label", "rows", "modes", *[F.round(c, 6).alias(c) for c in ("focus", "coherence", "edge")])


def f18_route_by_coupling(spark, sf):
    """Frames of vectors routed over three fixed bases."""
    eye = lambda *at: [[1.0 if i == a else 0.0 for i in range(64)] for a in at]
    r = R.route_by_coupling(_vectors(spark, sf), {"first": eye(0, 1), "second": eye(2, 3), "third": eye(4, 5)}, "label", "id", "vec")
    return r.select("label", "step", "basis", F.round("absorbed", 6).alias("absorbed"), F.round("residual", 6).alias("residual"))


def o6_concentration(spark, sf):
    """Length of the mean unit vector per label: order plays no part."""
    each = _vectors(spark, sf).select("label", F.posexplode(R.unit(F.col("vec"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return each.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("resultant"))


def o8_jackknife(spark, sf):
    j = R.jackknife(table(spark, sf, "events").select("event_type", "value"), "event_type", "value")
    return j.select("event_type", "n", F.round("value", 6).alias("value"), F.round("se", 6).alias("se"))


def o9_spectral_distance(spark, sf):
    """Distance of neighbouring vectors."""
    v = _vectors(spark, sf).select("id", F.col("vec").alias("a"))
    near = v.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, q: s + q))
    return v.join(near, "id").select("id", F.round(d, 6).alias("distance"))


def o14_mad_whitened(spark, sf):
    w = R.mad_whitened(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value")
    return w.select("event_id", F.round("white", 6).alias("white"))


_QUERIES = (
    w2_signal_end, w4_leading_hits, k10_cells, t2k_cosine_top, w8_belonging, w9_revisions, w11_monotone_hull, f6_hash_embedding, a18_pooled_gram,
    f15_frame_reads, f18_route_by_coupling, o6_concentration, o8_jackknife, o9_spectral_distance, o14_mad_whitened,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    cut = f"""{_BM25_SQL},
        r AS (SELECT query_id, id, score AS x, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM top),
        s AS (SELECT *, sum(x) OVER (PARTITION BY query_id ORDER BY k) AS s, sum(x) OVER (PARTITION BY query_id) AS t, sum(x * x) OVER (PARTITION BY query_id) AS q FROM r),
        e AS (SELECT query_id, k, n, CASE WHEN q - t * t / n > 1e-12 * q THEN k * (n - k) / n * (s / k - (t - s) / (n - k)) ** 2 / (q - t * t / n) END AS eta2 FROM s WHERE k < n),
        b AS (SELECT query_id, max(eta2) AS eta2, arg_max(k, eta2) AS k FROM e GROUP BY 1),
        z AS (SELECT n, max(k * (n - k) / n * (n / 2) ** 2 / (n * (n * n - 1) / 12)) AS ne FROM (SELECT n, unnest(range(1, n)) AS k FROM (SELECT DISTINCT n FROM r WHERE n >= 3)) GROUP BY 1),
        o AS (SELECT DISTINCT r.query_id, r.n, b.eta2, z.ne, CASE WHEN r.n >= 3 AND b.eta2 IS NOT NULL THEN round(b.eta2, 12) > round(z.ne, 12) END AS separated, b.k AS bk FROM r LEFT JOIN b USING (query_id) LEFT JOIN z ON z.n = r.n)"""
    vec = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings),
        an AS (SELECT label AS cell, arg_min(vec, id) AS anchor FROM v GROUP BY 1),
        c AS (SELECT id, vec, label, arg_max(cell, round(list_cosine_similarity(vec, anchor), 9) * 1e6 - cell / 1e6) AS cell FROM v, an GROUP BY 1, 2, 3)"""
    frame = """v AS (SELECT vec_id AS id, label || '-' || (vec_id // 100) AS frame, embedding::DOUBLE[] AS vec FROM embeddings),
        g AS (SELECT a.frame, a.id, avg(list_cosine_similarity(a.vec, b.vec) ** 2) AS agreement, count(*) + 1 AS n FROM v a JOIN v b ON a.frame = b.frame AND a.id <> b.id GROUP BY 1, 2),
        z AS (SELECT frame, id, agreement, CASE WHEN n >= 4 AND stddev_pop(agreement) OVER (PARTITION BY frame) > 1e-12 THEN round((agreement - avg(agreement) OVER (PARTITION BY frame)) / stddev_pop(agreement) OVER (PARTITION BY frame), 4) END AS z FROM g)"""
    return {
        "w2_signal_end": f"{cut} SELECT query_id, n::INT AS n, (CASE WHEN separated THEN bk ELSE n END)::INT AS k, round(eta2, 6) AS eta2, round(ne, 6) AS null_eta2, separated FROM o",
        "w4_leading_hits": f"{cut} SELECT r.query_id, id, (r.k - 1)::INT AS rank FROM r JOIN o USING (query_id) WHERE r.k <= CASE WHEN separated THEN bk ELSE o.n END",
        "k10_cells": f"WITH {vec} SELECT id, cell FROM c",
        "t2k_cosine_top": f"""WITH {vec}, p AS (SELECT q.id AS query_id, h.id, round(list_cosine_similarity(q.vec, h.vec), 6) AS score FROM v q, v h WHERE q.id % 20 = 0)
            SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM p) WHERE rank < 5""",
        "w8_belonging": f"WITH {frame} SELECT frame, id, round(agreement, 6) AS agreement, z FROM z",
        "w9_revisions": f"""WITH {frame}, r AS (SELECT frame || '/' || (id % 3) AS root, id, z, max(z) OVER (PARTITION BY frame || '/' || (id % 3)) AS best FROM z)
            SELECT root, id FROM r WHERE best IS NULL OR best <= 0 OR z = best""",
        "w11_monotone_hull": """WITH e AS (SELECT event_type, dayofmonth(ts) AS lag, avg(value) / 50 - 0.5 AS c FROM events GROUP BY 1, 2)
            SELECT event_type, lag, round(max(greatest(0, least(1, c))) OVER (PARTITION BY event_type ORDER BY lag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS hull, greatest(0, least(1, c)) <> c AS clipped FROM e""",
        "f6_hash_embedding": "SELECT doc_id, 64 AS dim, CASE WHEN trim(text) = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm2 FROM documents",
        "a18_pooled_gram": """SELECT label, i - 1 AS i, j - 1 AS j, count(*) AS n, round(sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE), 4) + 0.0 AS xx
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) WHERE i <= j GROUP BY 1, 2, 3""",
        "f18_route_by_coupling": """WITH e AS (SELECT label, b, sum(embedding[i]::DOUBLE ** 2) AS e FROM embeddings, (VALUES ('first', 1), ('first', 2), ('second', 3), ('second', 4), ('third', 5), ('third', 6)) v(b, i) GROUP BY 1, 2),
            t AS (SELECT label, sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS t FROM embeddings GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY e DESC, b) AS k FROM e)
            SELECT label, (k - 1)::INT AS step, b AS basis, round(e, 6) AS absorbed, round(t - sum(e) OVER (PARTITION BY label ORDER BY k), 6) AS residual FROM o JOIN t USING (label)""",
        "o6_concentration": """WITH v AS (SELECT label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
            m AS (SELECT label, i, avg(x[i] / n) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS resultant FROM m GROUP BY 1""",
        "o8_jackknife": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS value, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM events GROUP BY 1",
        "o9_spectral_distance": "SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "o14_mad_whitened": """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_id, event_type, value - med AS d FROM events JOIN m USING (event_type)),
            q AS (SELECT event_type, median(abs(d)) AS mad FROM d GROUP BY 1) SELECT event_id, round(CASE WHEN mad > 0 THEN d / mad END, 6) AS white FROM d JOIN q USING (event_type)""",
    }
