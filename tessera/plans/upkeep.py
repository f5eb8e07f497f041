"""Queries of a store's upkeep, of its full-text index, and of what its sources land."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import context as X
from tessera.functions import text as T
from tessera.model import ARTIFACTS_SQL, EDGES_SQL, artifacts, edges, table
from tessera.operators import index as I
from tessera.operators import maintenance as M
from tessera.operators import metrics, writers
from tessera.plans import geometry, lexical
from tessera.plans.sql import TOKENS
from tessera.sources import ingest, parsers
from tessera.steps import fresh_path


def m1_sketches(spark, sf):
    a = artifacts(spark, sf).select(F.col("content_ref").alias("ref"), F.col("content").alias("body"))
    s = M.sketches(a, a.filter("body LIKE 'A%'").select("ref"))
    return s.select("ref", "degenerate", F.size("sketch").alias("n"), F.get("sketch", F.lit(0)).alias("first"))


def m2_updated(spark, sf):
    """Labels with two side tables applied as one."""
    old = table(spark, sf, "labels").select("doc_id", "quality")
    side = lambda every, value: old.filter(F.col("doc_id") % every == 0).select("doc_id", F.lit(value).alias("value"))
    return M.updated(old, "doc_id", "quality", side(10, 5), side(15, 3))


def m3_offers(spark, sf):
    a = artifacts(spark, sf).select("id", F.col("cited_from").alias("offer"), "keyed", "lang", F.length("content").alias("n"))
    return M.offers_filled(a, "offer", F.concat(F.lit("made:"), "lang"), {"keyed": F.col("keyed"), "long": F.col("n") >= 10}).select("id", "offer", "status")


def m5_recovered(spark, sf):
    a = artifacts(spark, sf).select("doc_id", "content_ref", "content")
    missing = a.filter("doc_id % 5 = 0")
    found = a.filter("doc_id % 10 = 0").select("content_ref", F.col("content").alias("body")).unionByName(a.filter("doc_id % 15 = 5").select("content_ref", F.concat("content", F.lit("x")).alias("body")))
    return M.recovered(missing, found)


def m6_regenerated(spark, sf):
    a = artifacts(spark, sf).select("id", "content_ref")
    d = table(spark, sf, "documents").filter("doc_id % 3 <> 0").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text", "doc_id")
    return M.regenerated(a, d, F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "))))


def m7_backfilled(spark, sf):
    a = artifacts(spark, sf)
    rows, counts = M.backfilled(a, {"cited_from": F.concat(F.lit("lang:"), "lang"), "provenance": F.lit("asserted"), "size": F.octet_length("content").cast("long")})
    return counts.unionByName(rows.agg(metrics.count_if(F.col("size").isNull()).alias("n")).select(F.lit("left").alias("field"), "n"))


def m8_edges_added(spark, sf):
    e = edges(spark, sf).filter("label = 'supplies'").select("src", "dst", "label")
    solvent = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("src"))
    return M.edges_added(e, e.join(solvent, "src", "left_semi"), "supplier-2", 30)[0]


def m10_arm_means(spark, sf):
    hits = lexical.g22_retrieval_arms(spark, sf)
    items = table(spark, sf, "benchmark")
    relevant = lexical._holding(table(spark, sf, "documents").select("doc_id", "text"), items)
    classes = items.select(F.col("item_id").alias("query_id"), F.concat(F.lit("class-"), F.col("item_id") % 3).alias("class"))
    return M.arm_means(hits, relevant, classes, 10).select("arm", "class", "n", F.round("recall", 6).alias("recall"))


def m11_smoke(spark, sf):
    """Seven acceptance checks of the artifacts and edges."""
    a, e = artifacts(spark, sf), edges(spark, sf)
    ids = a.select("id")
    known = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    parts = table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("id"))
    zero = lambda df: df.limit(1).count() == 0
    checks = {
        "ids are unique": zero(ids.groupBy("id").count().filter("count > 1")),
        "states are known": zero(a.filter("state NOT IN ('live', 'archived')")),
        "addresses are hashes": zero(a.filter(~F.col("content_ref").rlike("^cas/[0-9a-f]{64}$"))),
        "addresses match bodies": zero(a.filter(M.address(F.col("content")) != F.col("content_ref"))),
        "edges are unique": zero(e.groupBy("src", "dst", "label").count().filter("count > 1")),
        "parts of edges exist": zero(known.filter("id LIKE 'part-%'").join(parts, "id", "left_anti")),
        "provenance is complete": zero(a.filter("provenance IS NULL OR cited_from IS NULL")),
    }
    return spark.createDataFrame([(k, "PASS" if v else "FAIL") for k, v in checks.items()], "check string, result string")


def m13_enriched(spark, sf):
    """Readings and reasons of the customers as words, by status."""
    return geometry.a13_measured(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("ic").alias("measured"))


def k6_source_rows(spark, sf):
    return writers.source_rows(table(spark, sf, "documents").select(F.col("source").alias("name"), F.concat(F.lit("licence of "), "source").alias("licence")).distinct())


def k7_bootstrap(spark, sf):
    """What a store still lacks of its seeds when it has the rungs and two labels."""
    stored = spark.createDataFrame([(f"rung-{r}",) for r in writers.RUNGS] + [("label-cites",), ("label-near_dup_candidate",)], "id string")
    rows, links = writers.bootstrap(spark, stored)
    return rows.unionByName(links.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("label").alias("kind")))


def k15_answers(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    after = W.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("answer", F.lead("text").over(after)).withColumn("by", F.lead("role").over(after)).filter("role = 'user' AND by = 'assistant'")
    return writers.answers_kept(pairs.select(F.col("text").alias("question"), "answer")).select("id", F.md5("answer").alias("answer_md5"), "n", "provenance")


def l8_described_files(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("/data/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    f = ingest.described(p)
    return f.select("id", "kind", F.length("content").alias("n"), F.md5("content").alias("content_md5"))


def l13_concept_rows(spark, sf):
    return ingest.concepts(table(spark, sf, "part").select(F.col("p_name").alias("term"))).select("id", "title", "content_type", "provenance", "state")


def l16_stages_done(spark, sf):
    """Of every language whether all its collections are marked, by collections with over eight German documents."""
    d = table(spark, sf, "documents")
    marks = d.filter("lang = 'de'").groupBy(F.col("source").alias("project")).agg(F.count(F.lit(1)).alias("n")).filter("n > 8").select("project")
    return ingest.all_done(d.filter("doc_id % 3 = 0").select(F.col("lang").alias("stage"), F.col("source").alias("project")), marks)


def s3_keyset_page(spark, sf):
    return metrics.page_after(artifacts(spark, sf), "doc_id", 500, 100).select("doc_id", "id")


def s3_capped(spark, sf):
    """Beyond the cap nothing is said."""
    return metrics.null_counts(artifacts(spark, sf), ["cited_from", "provenance"], cap=100)


def p7_null_audit(spark, sf):
    a = artifacts(spark, sf)
    return metrics.null_counts(a, ["cited_from"]).crossJoin(metrics.null_counts(a, ["provenance"], measured=False))


def s8_dataset(spark, sf):
    d = table(spark, sf, "documents").withColumn("title", F.substring(F.split("text", "\n")[0], 1, 200))
    r = ingest.with_lemmas(ingest.records(d, ingest.Declared("set", "title", "text", "doc_id", 100)))
    return r.select("id", "state", "provenance", F.size("lemmas").cast("long").alias("n_lemmas"), F.md5(F.array_join("lemmas", " ")).alias("lemmas_md5"))


def s9_wiki(spark, sf):
    """Which texts the two encyclopedia sources take: of 120 characters, of 200."""
    d = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("t"), "doc_id"))
    rows = [ingest.records(d, s).select("id", F.length("content").cast("long").alias("n")) for s in ingest.ENCYCLOPEDIAS]
    return rows[0].unionByName(rows[1])


def s10_senses(spark, sf):
    """Parts as synsets with the words of their names as lemmas."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("synset"), F.split("p_name", " ").alias("lemmas"))
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("synset")).agg(F.count(F.lit(1)).alias("count"))
    return parsers.senses(p, counts)


def r8_cursor(spark, sf):
    """Lines after a cursor, the last one not ended yet."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("line"))
    last = e.agg(F.max("line")).first()[0]
    return ingest.next_lines(e.withColumn("ended", F.col("line") < last), last - 100, 250)


def p2_contexts(spark, sf):
    """Contexts written as JSON in JSON, up to four times."""
    raw = F.to_json(F.struct(F.col("lang").alias("description"), "source"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    d = table(spark, sf, "documents").withColumn("raw", raw)
    for k in range(1, 5):
        d = d.withColumn("raw", F.when(F.col("doc_id") % 5 >= k, quoted(F.col("raw"))).otherwise(F.col("raw")))
    return d.select("doc_id", F.get_json_object(X.unwrapped(F.col("raw")), "$.description").alias("description"))


def p3_offers(spark, sf):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("id"), F.col("doc_id").cast("string"), F.lit("state"), F.lit("live"), F.lit("description"), F.col("lang"), F.lit("blank"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", X.offer_text(m).alias("offer"))


def p4_resolved(spark, sf):
    a = artifacts(spark, sf).select("id", F.when(F.col("keyed"), F.concat(F.lit("title of "), "id")).alias("title"), "content_ref", F.col("cited_from").alias("description"))
    bodies = artifacts(spark, sf).filter("doc_id % 4 <> 0").select("content_ref", "content").dropDuplicates(["content_ref"])
    r = X.resolved(a, bodies)
    return r.select("id", "title", "preview", F.md5("content").alias("content_md5"))


def p8_terms(spark, sf):
    k = F.col("p_partkey")
    ili = F.when(k % 3 == 0, "in").when(k % 3 == 1, "None").otherwise(F.concat(F.lit("i"), k))
    uri = F.concat(F.lit("/c/en/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k % 2 == 0, "/n").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", parsers.term(uri).alias("term"), parsers.ili_or_none(ili).alias("ili"), parsers.label(F.lit("/r/dbpedia/PartOf")).alias("label"))


def s18_items(spark, sf):
    """Pages as articles: titles with a colon are left out, the lead is the first long line of the cleaned text."""
    p = table(spark, sf, "pages").select(F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("page_id") % 4 == 0, ": talk").otherwise("")).alias("title"), F.regexp_replace("html", "</?(?:p|h1|br)>", "\n").alias("text"))
    return parsers.articles(p).select("title", "lead")


def g20_fielded(spark, sf):
    """Search over four fields on surface words."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return I.search(I.fields(artifacts(spark, sf)), q, 10, stemmed=False)


def g20_stemmed(spark, sf):
    """The same on stems."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return I.search(I.fields(artifacts(spark, sf)), q, 10)


def _grown_index(spark, sf):
    """An index that was built, had every tenth document indexed again without its title, and every seventh taken out."""
    docs = I.fields(artifacts(spark, sf))
    nth = F.substring("id", 5, 20).cast("long")
    index = I.FieldIndex(spark, fresh_path(spark, "field-index"), stemmed=False)
    index.add(docs)
    index.add(docs.filter(nth % 10 == 0).withColumn("title", F.lit("")))
    index.retract(docs.filter(nth % 7 == 0))
    return docs, index


def k8_incremental_index(spark, sf):
    _, index = _grown_index(spark, sf)
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def l4_index_coverage(spark, sf):
    docs, index = _grown_index(spark, sf)
    return index.coverage(docs)


def l1_index_search(spark, sf):
    """Search in the grown index, with its own lengths and frequencies."""
    _, index = _grown_index(spark, sf)
    return index.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)


def l5_search_hits(spark, sf):
    docs = I.fields(artifacts(spark, sf))
    h = I.search_hits(g20_fielded(spark, sf), docs, 100)
    return h.select("query_id", "id", "title", "description", "content", "score")


def l6_match_expressions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", I.match_expression(F.col("text"), True).alias("expression"))


_QUERIES = (
    m1_sketches, m2_updated, m3_offers, m5_recovered, m6_regenerated, m7_backfilled, m8_edges_added, m10_arm_means, m11_smoke, m13_enriched, k6_source_rows, k7_bootstrap,
    k15_answers, l8_described_files, l13_concept_rows, l16_stages_done, s3_keyset_page, s3_capped, p7_null_audit, s8_dataset, s9_wiki, s10_senses, r8_cursor, p2_contexts,
    p3_offers, p4_resolved, p8_terms, s18_items, g20_fielded, g20_stemmed, k8_incremental_index, l4_index_coverage, l1_index_search, l5_search_hits, l6_match_expressions,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    a, t = f"a AS ({ARTIFACTS_SQL})", TOKENS.format
    four = f"""{a}, f AS (SELECT id, doc_id, state, coalesce(toxic, 0) = 1 AS sealed, left(string_split(content, chr(10))[1], 200) AS title, coalesce(nullif(trim(cited_from), ''), provenance, '') AS description,
        CASE WHEN keyed THEN lang ELSE '' END AS tags, content FROM a)"""
    words = lambda title: f"list_concat(list_concat(list_concat({t(title)}, {t('description')}), {t('tags')}), {t('content')})"
    ranked = lambda source, k: f"""w AS ({source}),
        post AS (SELECT id, term, count(*) AS tf, len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM w) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM w), q AS (SELECT DISTINCT item_id AS query_id, unnest({t('text')}) AS term FROM benchmark),
        s AS (SELECT query_id, id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
              FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
        top AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < {k})"""  # noqa: E731
    grown = f"SELECT id, {words('ti')} AS t FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN '' ELSE title END AS ti FROM f WHERE state = 'live' AND NOT sealed AND doc_id % 7 <> 0)"
    seeds = ", ".join(f"('{k}-{n}', '{k}', {'NULL' if x is None else repr(f'{k}-{x}')})" for k, n, x in writers.SEEDS)
    lemmas = "list_transform(list_sort(list_distinct(list_transform({x}, lambda e: {{'p': list_position({x}, e), 't': e}}))), lambda s: s.t)".format(x="t")
    g22 = lexical.oracle_sql()["g22_retrieval_arms"]
    clean = lexical.oracle_sql()["s19_clean_pages"].split("trim(", 1)[1].rsplit(") AS t FROM pages", 1)[0]
    return {
        "m2_updated": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 5 WHEN doc_id % 15 = 0 THEN 3 ELSE quality END AS quality FROM labels",
        "m3_offers": f"""WITH {a}, s AS (SELECT *, CASE WHEN trim(coalesce(cited_from, '')) <> '' THEN 'kept' WHEN NOT keyed THEN 'refused: keyed' WHEN length(content) < 10 THEN 'refused: long' ELSE 'filled' END AS status FROM a)
            SELECT id, CASE WHEN status = 'filled' THEN 'made:' || lang ELSE cited_from END AS offer, status FROM s""",
        "m5_recovered": f"""WITH {a}, b AS (SELECT content_ref, content AS body FROM a WHERE doc_id % 10 = 0 UNION ALL SELECT content_ref, content || 'x' FROM a WHERE doc_id % 15 = 5),
            g AS (SELECT content_ref, bool_or('cas/' || sha256(body) = content_ref) AS good FROM b GROUP BY 1)
            SELECT m.content_ref, (('0x' || m.content_ref[5:6])::INT % 16) AS shard, CASE WHEN good THEN 'recovered' WHEN NOT good THEN 'rejected' ELSE 'lost' END AS status FROM (SELECT DISTINCT content_ref FROM a WHERE doc_id % 5 = 0) m LEFT JOIN g USING (content_ref)""",
        "m6_regenerated": "SELECT 'doc-' || doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS same FROM documents",
        "m7_backfilled": f"WITH {a} SELECT 'cited_from' AS field, count(*) FILTER (cited_from IS NULL) AS n FROM a UNION ALL SELECT 'provenance', count(*) FILTER (provenance IS NULL) FROM a UNION ALL SELECT 'size', count(*) FILTER (size IS NULL) FROM a UNION ALL SELECT 'left', 0",
        "m8_edges_added": f"""WITH e AS (SELECT src, dst, label FROM ({EDGES_SQL}) WHERE label = 'supplies'), s AS (SELECT DISTINCT src FROM e WHERE src > 'supplier-2' ORDER BY src LIMIT 30)
            SELECT src, dst, label FROM e JOIN s USING (src) WHERE src IN (SELECT 'supplier-' || s_suppkey FROM supplier WHERE s_acctbal <= 0)""",
        "m10_arm_means": f"""WITH h AS ({g22}), rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
            f AS (SELECT arm, query_id, count(*) AS f FROM h JOIN rel USING (query_id, id) GROUP BY 1, 2)
            SELECT arm, 'class-' || (query_id % 3) AS class, count(*) AS n, round(avg(coalesce(f, 0) / n), 6) AS recall FROM (SELECT DISTINCT arm FROM h) CROSS JOIN n LEFT JOIN f USING (arm, query_id) GROUP BY 1, 2""",
        "m11_smoke": f"""WITH {a} SELECT unnest(['ids are unique', 'states are known', 'addresses are hashes', 'addresses match bodies', 'edges are unique', 'parts of edges exist', 'provenance is complete']) AS "check",
            unnest(['PASS', 'PASS', 'PASS', 'PASS', 'PASS', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN (SELECT count(*) FROM a WHERE provenance IS NULL OR cited_from IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END]) AS result""",
        "m13_enriched": f"SELECT status, count(*) AS n, count(ic) AS measured FROM ({geometry.oracle_sql()['a13_measured']}) GROUP BY 1",
        "k6_source_rows": """SELECT prefix || source AS id, kind, CASE kind WHEN 'citation' THEN 'licence of ' || source ELSE 'cite-' || source END AS cited_from, 'live' AS state
            FROM (SELECT DISTINCT source FROM documents), (VALUES ('cite-', 'citation'), ('op.source.', 'operator'), ('col-', 'collection')) v(prefix, kind)""",
        "k7_bootstrap": f"""WITH s AS (SELECT * FROM (VALUES {seeds}) v(id, kind, above) WHERE kind <> 'rung' AND id NOT IN ('label-cites', 'label-near_dup_candidate'))
            SELECT id, kind FROM s UNION ALL SELECT id || '>' || above, 'is_a' FROM s WHERE above IS NOT NULL""",
        "k15_answers": """WITH p AS (SELECT text AS q, role, lead(text) OVER w AS x, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
            SELECT 'qa-' || sha256(lower(trim(q)))[1:20] AS id, md5(max(x)) AS answer_md5, count(*) AS n, 'hypothesis' AS provenance FROM p WHERE role = 'user' AND r = 'assistant' GROUP BY 1""",
        "l8_described_files": "SELECT 'file-' || sha256('/data/' || page_id || '.html')[1:20] AS id, 'document' AS kind, least(length(html), 20000) AS n, md5(left(html, 20000)) AS content_md5 FROM pages",
        "l13_concept_rows": "SELECT DISTINCT 'concept-' || replace(lower(p_name), ' ', '_') AS id, p_name AS title, 'concept' AS content_type, 'fetched' AS provenance, 'live' AS state FROM part",
        "l16_stages_done": """WITH m AS (SELECT source FROM documents WHERE lang = 'de' GROUP BY 1 HAVING count(*) > 8)
            SELECT lang AS stage, count(DISTINCT source) AS projects, count(DISTINCT source) FILTER (source NOT IN (SELECT source FROM m)) = 0 AS done FROM documents WHERE doc_id % 3 = 0 GROUP BY 1""",
        "s3_keyset_page": "SELECT doc_id, 'doc-' || doc_id AS id FROM documents WHERE doc_id > 500 ORDER BY doc_id LIMIT 100",
        "s3_capped": "SELECT CASE WHEN count(*) <= 100 THEN 0 END AS no_cited_from, CASE WHEN count(*) <= 100 THEN 0 END AS no_provenance FROM documents",
        "p7_null_audit": f"WITH {a} SELECT count(*) FILTER (cited_from IS NULL) AS no_cited_from, NULL::BIGINT AS no_provenance FROM a",
        "s8_dataset": f"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(left(string_split(text, chr(10))[1], 200) || chr(10) || chr(10) || text), '[a-z0-9]+'), lambda x: length(x) > 1) AS t FROM documents WHERE length(trim(text)) >= 100)
            SELECT 'set-' || doc_id AS id, 'live' AS state, 'fetched' AS provenance, len(list_distinct(t)) AS n_lemmas, md5(array_to_string({lemmas}, ' ')) AS lemmas_md5 FROM l""",
        "s9_wiki": """SELECT 'simple-' || doc_id AS id, length('t' || doc_id) + 2 + length(text) AS n FROM documents WHERE length(trim(text)) >= 120
            UNION ALL SELECT 'full-' || doc_id, length('t' || doc_id) + 2 + length(text) FROM documents WHERE length(trim(text)) >= 200""",
        "s10_senses": """WITH w AS (SELECT p_partkey AS synset, unnest(string_split(p_name, ' ')) AS lemma, unnest(range(len(string_split(p_name, ' ')))) AS nth FROM part), d AS (SELECT synset, lemma, min(nth) AS nth FROM w GROUP BY 1, 2),
            c AS (SELECT l_partkey AS synset, count(*) AS c FROM lineitem GROUP BY 1)
            SELECT synset, lemma, nth::INT AS nth, row_number() OVER (PARTITION BY lemma ORDER BY synset) - 1 AS sense_rank, c AS count FROM d LEFT JOIN c USING (synset)""",
        "r8_cursor": "WITH m AS (SELECT max(event_id) AS m FROM events) SELECT m - 1 AS cursor, count(*) FILTER (event_id > m - 100 AND event_id < m) AS applied, 1 AS held FROM events, m GROUP BY m",
        "p2_contexts": "SELECT doc_id, CASE WHEN doc_id % 5 <= 3 THEN lang END AS description FROM documents",
        "p3_offers": "SELECT doc_id, 'description: ' || lang || '; source: ' || source AS offer FROM documents",
        "p4_resolved": f"""WITH {a}, b AS (SELECT DISTINCT content_ref, content FROM a WHERE doc_id % 4 <> 0)
            SELECT id, coalesce(CASE WHEN keyed THEN 'title of ' || id END, left(string_split(b.content, chr(10))[1], 200), left(cited_from, 200)) AS title, b.content IS NULL AS preview, md5(coalesce(b.content, cited_from)) AS content_md5 FROM a LEFT JOIN b USING (content_ref)""",
        "p8_terms": "SELECT p_partkey, p_name AS term, CASE WHEN p_partkey % 3 = 2 THEN 'i' || p_partkey END AS ili, 'dbpedia_part_of' AS label FROM part",
        "s18_items": f"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '</?(?:p|h1|br)>', chr(10), 'g') AS html FROM pages WHERE page_id % 4 <> 0),
            c AS (SELECT title, trim({clean}) AS t FROM p WHERE title NOT LIKE '%:%')
            SELECT title, left(trim(list_filter(string_split(t, chr(10)), lambda s: length(trim(s)) > 40 AND NOT regexp_matches(trim(s), '^[=|*#{{]'))[1]), 500) AS lead FROM c""",
        "g20_fielded": f"WITH {four}, {ranked(f'SELECT id, {words('title')} AS t FROM f', 10)} SELECT query_id, id, rank, score FROM top",
        "k8_incremental_index": f"WITH {four}, w AS ({grown}), p AS (SELECT id, unnest(t) AS term FROM w) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM p GROUP BY 1",
        "l4_index_coverage": f"WITH {four}, w AS ({grown}) SELECT count(*) FILTER (len(t) > 0) AS indexed, (SELECT count(*) FROM f) AS vertices, (SELECT count(*) FROM f) - count(*) FILTER (len(t) > 0) AS missing FROM w",
        "l1_index_search": f"WITH {four}, {ranked(grown, 5)} SELECT query_id, id, rank, score FROM top",
        "l5_search_hits": f"WITH {four}, {ranked(f'SELECT id, {words('title')} AS t FROM f', 10)} SELECT query_id, id, title, description, left(content, 100) AS content, score FROM top JOIN f USING (id)",
        "l6_match_expressions": f"""SELECT item_id, array_to_string(list_transform({lemmas}, lambda w: '"' || w || '"'), ' AND ') AS expression FROM (SELECT item_id, {t('text')} AS t FROM benchmark)""",
    }
