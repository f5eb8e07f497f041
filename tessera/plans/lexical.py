"""Queries of the lexical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.model import table
from tessera.operators import lexical as L

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: The queries: every benchmark item.
_INDEX_SQL = f"""
    tok AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents),
    lens AS (SELECT doc_id AS id, len({_TOKENS}) AS len FROM documents),
    post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_BM25_SQL = f"""
    WITH {_INDEX_SQL},
    q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
    w AS (
        SELECT term, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
               * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w
        FROM post JOIN dfs USING (term) JOIN lens USING (id), st),
    hits AS (SELECT query_id, id, round(sum(w), 6) AS score, count(*) AS matched FROM q JOIN w USING (term) GROUP BY query_id, id),
    ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM hits),
    top AS (SELECT * FROM ranked WHERE rank < 10)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return L.postings(_docs(spark, sf), "doc_id", F.col("text"))


def _searched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths)."""
    return _index(spark, sf), _docs(spark, sf).select(F.col("doc_id").alias("id"), F.size(T.tokens(F.col("text"))).alias("len"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term"))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return L.bm25_top(*_searched(spark, sf), _queries(spark, sf), 10)


def f1_tokens(spark, sf):
    t = T.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_join(F.slice(F.array_distinct(t), 1, 5), " ").alias("first_terms"))


def f3_blind_terms(spark, sf):
    return _index(spark, sf).select("term").distinct().select("term", T.blind(F.col("term"), "key").alias("blind"))


def f4_corpus_terms(spark, sf):
    t = T.corpus_terms(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(F.array_distinct(t), " ").alias("distinct_terms"))


def a8_document_frequency(spark, sf):
    return L.document_frequency(_index(spark, sf))


def a8_stemmed_frequency(spark, sf):
    """Frequency of every word by surface form or Porter stem; the stem is taken once per distinct word."""
    df = L.document_frequency(_index(spark, sf))
    words = df.select(F.col("term").alias("word"))
    return L.frequency_of(words, df, words.select("word", T.stems_udf()("word").alias("stem")))


def a9_corpus_rows(spark, sf):
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"))


def a10_information(spark, sf):
    n = _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    df = L.document_frequency(_index(spark, sf)).crossJoin(F.broadcast(n))
    return L.information(df, F.col("n")).select("term", F.round("bits", 6).alias("bits"))


def a10_word_information(spark, sf):
    """Information of the benchmark's neighbouring words, joined as compounds."""
    n = _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    df = L.document_frequency(_index(spark, sf)).crossJoin(F.broadcast(n))
    t = T.tokens(F.col("text"))
    pairs = table(spark, sf, "benchmark").select(t.alias("t")).filter("size(t) > 1").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat_ws("_", F.get("t", i), F.get("t", i + 1)))).alias("word")
    ).distinct()
    parts = pairs.select("word", F.explode(T.tokens(F.regexp_replace("word", "_", " "))).alias("term"))
    bits = L.information(df, F.col("n"))
    return parts.join(bits, "term", "left").groupBy("word").agg(F.round(F.max("bits"), 6).alias("bits"))


def g19_salient_terms(spark, sf):
    n = _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    df = L.document_frequency(_index(spark, sf)).crossJoin(F.broadcast(n))
    terms = _queries(spark, sf).withColumnRenamed("query_id", "id")
    return L.salient(terms, df, F.col("n")).select("id", "term", F.round("idf", 6).alias("idf"))


def g20_bm25(spark, sf):
    return _top(spark, sf)


def g20_bm25_all_terms(spark, sf):
    """AND search on all distinct words of every benchmark item."""
    return L.bm25_top(*_searched(spark, sf), _queries(spark, sf), 10, conjunctive=True)


def w1_ranked_within_budget(spark, sf):
    lengths = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n_chars"))
    return L.within_budget(_top(spark, sf), lengths)


def w6_densest_span(spark, sf):
    """The best passage of every top hit."""
    asked = _queries(spark, sf).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    hits = _top(spark, sf).join(_docs(spark, sf).withColumnRenamed("doc_id", "id"), "id").join(asked, "query_id")
    return hits.select("query_id", "id", "rank", T.spans_udf(300)("text", "terms").alias("passage"))


def f1_offsets(spark, sf):
    """Every token with its place, in one digest per document."""
    spans = F.transform(T.token_spans(F.col("text")), lambda t: F.concat_ws(":", t["start"], t["stop"], t["said"]))
    return _docs(spark, sf).select("doc_id", F.md5(F.array_join(spans, " ").cast("binary")).alias("tokens_md5"))


def f3_blind_stems(spark, sf):
    """Keyed hashes of stems, as an index without readable text holds them."""
    words = _index(spark, sf).select("term").distinct()
    return words.select(T.stems_udf()("term").alias("stem")).distinct().select("stem", T.blind(F.col("stem"), "key").alias("blind"))


def f5_cut(spark, sf):
    """Two hundred characters from about the fiftieth, whole words."""
    return _docs(spark, sf).select("doc_id", T.cut_udf(200)("text", F.pmod("doc_id", F.lit(50))).alias("passage"))


def _holding(docs, items):
    """(query_id, id): items whose whole text a document holds, found by the item's first ten words, or all of them where it has fewer, then compared."""
    t = T.tokens(F.col("text"))
    key = F.array_join(F.slice(t, 1, 10), " ")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), F.least(F.size(t), F.lit(10)).alias("run"), key.alias("key")).filter("key <> ''")
    lengths = asked.agg(F.collect_set("run").alias("runs"))  # ten at most
    each = docs.select("doc_id", t.alias("t")).crossJoin(F.broadcast(lengths)).select("doc_id", "t", F.explode("runs").alias("run")).filter(F.size("t") >= F.col("run"))
    runs = each.select("doc_id", "run", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("run") + 1), lambda i: F.array_join(F.slice("t", i, F.col("run")), " "))).alias("key"))
    # Keys meet first; only then are the texts of the few documents read that hold one.
    met = runs.join(asked, ["run", "key"]).select("query_id", "item", "doc_id").distinct()
    return met.join(docs.select("doc_id", "text"), "doc_id").filter(F.col("text").contains(F.col("item"))).select("query_id", F.col("doc_id").alias("id")).distinct()


def g21_recall(spark, sf):
    """Relevant are the documents that hold an item's whole text."""
    relevant = _holding(_docs(spark, sf), table(spark, sf, "benchmark"))
    return L.recall_at(_top(spark, sf), relevant, [1, 5, 10]).select("query_id", "k", *[F.round(c, 6).alias(c) for c in ("recall", "ceiling", "recall_norm")], "hit")


def g22_retrieval_arms(spark, sf):
    """Three arms and their mean recall: exact key first words, BM25, keyed hits first and BM25 after."""
    top = _top(spark, sf)
    t = T.tokens(F.col("text"))
    key = lambda df, i: df.select(F.col(i), F.array_join(F.slice(t, 1, 3), " ").alias("key")).filter("key <> ''")
    keyed = key(table(spark, sf, "benchmark"), "item_id").join(key(_docs(spark, sf), "doc_id"), "key").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    keyed = L.top_k(keyed.withColumn("score", F.lit(1.0)), 10)
    both = keyed.select("query_id", "id", (F.lit(1000.0) - F.col("rank")).alias("score")).unionByName(top.select("query_id", "id", "score"))
    mixed = L.top_k(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), 10)
    arms = [("keyed", keyed), ("bm25", top), ("keyed_bm25", mixed)]
    out = [df.select(F.lit(name).alias("arm"), "query_id", "id", "rank") for name, df in arms]
    return out[0].unionByName(out[1]).unionByName(out[2])


def s19_clean_pages(spark, sf):
    clean = T.clean_wikitext(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean).alias("clean_md5"))


def s20_lead(spark, sf):
    return _docs(spark, sf).select("doc_id", T.lead(F.col("text")).alias("lead"))


def s21_chunks(spark, sf):
    """Texts in chunks of four lines, with the line they start at."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return (
        lines.groupBy("doc_id", F.floor(F.col("at") / 4).cast("long").alias("chunk"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("body"), (F.min("at") + 1).cast("long").alias("start_line"))
        .select("doc_id", "chunk", "start_line", F.md5("body").alias("body_md5"))
    )


def u1_ordered_terms(spark, sf):
    t = F.array_distinct(T.tokens(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(t, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ").alias("match_query"))


def l7_offers(spark, sf):
    return _docs(spark, sf).select("doc_id", T.offer(F.col("text")).alias("offer"))


_QUERIES = (
    f1_offsets, f3_blind_stems, f5_cut, f1_tokens, f3_blind_terms, f4_corpus_terms, a8_document_frequency, a8_stemmed_frequency, a9_corpus_rows, a10_information, a10_word_information,
    g19_salient_terms, g20_bm25, g20_bm25_all_terms, w1_ranked_within_budget, w6_densest_span, g21_recall, g22_retrieval_arms, s19_clean_pages,
    s20_lead, s21_chunks, u1_ordered_terms, l7_offers,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    terms = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) > 1)"
    first_seen = lambda x: f"list_transform(list_sort(list_distinct(list_transform({x}, lambda e: {{'p': list_position({x}, e), 't': e}}))), lambda s: s.t)"
    cut = lambda text, start, budget: f"""(SELECT CASE WHEN length(m) > {budget} THEN rtrim(m[1:{budget} - 1], ' ' || chr(10) || chr(9)) || '…' ELSE m END FROM (
        SELECT CASE WHEN s > 0 THEN '…' ELSE '' END || trim(CASE WHEN more THEN regexp_replace(rest, '[ \n\t][^ \n\t]*$', '') ELSE rest END, ' ' || chr(10) || chr(9) || chr(13)) || CASE WHEN more THEN '…' ELSE '' END AS m FROM (
        SELECT s, {text}[s + 1:s + {budget}] AS rest, s + {budget} < length({text}) AS more FROM (
        SELECT CASE WHEN {start} > 0 THEN {start} + length(regexp_extract({text}[{start} + 1:], '^[^ \n\t]{{0,39}}[ \n\t]')) ELSE 0 END AS s))))"""  # noqa: E731
    places = rf"""
        m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS said, unnest(range(1, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) + 1)) AS i FROM documents),
        p AS (SELECT doc_id, unnest(string_split_regex(text, '[\p{{L}}\p{{N}}]+')) AS gap, unnest(range(1, len(string_split_regex(text, '[\p{{L}}\p{{N}}]+')) + 1)) AS i FROM documents),
        t AS (SELECT doc_id, i, said, sum(length(gap) + length(said)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM m JOIN p USING (doc_id, i))"""
    clean = "coalesce(html, '')"
    for pattern, to in [
        (r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?s)\{\|.*?\|\}", ""), (r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", ""), *[(r"\{\{[^{}]*\}\}", "")] * 6,
        (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"), (r"\[https?://\S+\s*([^\]]*)\]", r"\1"), (r"<[^>]+>", ""), (r"''{2,}", ""), (r"\n{3,}", "\n\n"),
    ]:
        clean = f"regexp_replace({clean}, '{pattern}', '{to}', 'g')"
    return {
        "f1_offsets": f"WITH {places} SELECT doc_id, md5(coalesce(string_agg((stop - length(said)) || ':' || stop || ':' || lower(said), ' ' ORDER BY i), '')) AS tokens_md5 FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id",
        "f5_cut": f"SELECT doc_id, {cut('text', '(doc_id % 50)', 200)} AS passage FROM documents",
        "s19_clean_pages": f"SELECT page_id, length(t) AS n_clean, md5(t) AS clean_md5 FROM (SELECT page_id, trim({clean}) AS t FROM pages)",
        "w6_densest_span": f"""{_BM25_SQL}, {places},
            h AS (SELECT query_id, id, rank, t.stop - length(said) AS s, t.stop AS e, lower(said) AS term FROM top JOIN t ON t.doc_id = id JOIN q USING (query_id) WHERE lower(said) = q.term),
            v AS (SELECT a.query_id, a.id, a.s, 1000 * count(DISTINCT b.term) + count(*) AS value, max(b.e) AS e FROM h a JOIN h b ON a.query_id = b.query_id AND a.id = b.id AND b.s >= a.s AND b.e <= a.s + 300 GROUP BY ALL),
            b AS (SELECT query_id, id, arg_min(s, (-value, s)) AS s, arg_min(e, (-value, s)) AS e FROM v GROUP BY 1, 2),
            spans_ AS (SELECT top.query_id, top.id, rank, text, CASE WHEN s IS NULL THEN 0 ELSE least(greatest((s + e) // 2 - 150, 0), length(text) - 300) END AS begins FROM top JOIN documents ON doc_id = top.id LEFT JOIN b ON b.query_id = top.query_id AND b.id = top.id)
            SELECT query_id, id, rank, CASE WHEN length(text) <= 300 THEN text ELSE {cut('text', 'begins', 300)} END AS passage FROM spans_""",
        "f1_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(({first_seen('t')})[1:5], ' ') AS first_terms FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
        "f3_blind_terms": f"SELECT term, sha256('key' || term) AS blind FROM (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents)",
        "f4_corpus_terms": f"SELECT doc_id, len(t) AS n_terms, array_to_string({first_seen('t')}, ' ') AS distinct_terms FROM (SELECT doc_id, {terms} AS t FROM documents)",
        "a8_document_frequency": f"WITH {_INDEX_SQL} SELECT term, df FROM dfs",
        "a9_corpus_rows": "SELECT count(*) AS n FROM documents",
        "a10_information": f"WITH {_INDEX_SQL} SELECT term, round(-log2(df / (SELECT count(*) FROM documents)), 6) AS bits FROM dfs",
        "a10_word_information": f"""
            WITH {_INDEX_SQL},
            it AS (SELECT {_TOKENS} AS t FROM benchmark),
            pairs AS (SELECT DISTINCT t[i] || '_' || t[i + 1] AS word, t[i] AS x, t[i + 1] AS y FROM (SELECT t, unnest(range(1, len(t))) AS i FROM it)),
            parts AS (SELECT word, x AS term FROM pairs UNION SELECT word, y FROM pairs)
            SELECT word, round(max(-log2(df / (SELECT count(*) FROM documents))), 6) AS bits FROM parts LEFT JOIN dfs USING (term) GROUP BY word""",
        "g19_salient_terms": f"""
            WITH {_INDEX_SQL},
            q AS (SELECT DISTINCT item_id AS id, unnest({_TOKENS}) AS term FROM benchmark),
            i AS (SELECT id, term, CASE WHEN df IS NOT NULL THEN ln(greatest(1.0, (SELECT count(*) FROM documents) / greatest(1.0, df))) END AS idf FROM q LEFT JOIN dfs USING (term)),
            m AS (SELECT *, avg(idf) OVER (PARTITION BY id) AS mean, count(*) OVER (PARTITION BY id) AS n FROM i)
            SELECT id, term, round(idf, 6) AS idf FROM m WHERE n <= 2 OR mean IS NULL OR coalesce(idf >= mean, true)""",
        "g20_bm25": f"{_BM25_SQL} SELECT query_id, id, rank, score FROM top",
        "g20_bm25_all_terms": _BM25_SQL.replace("AS rank FROM hits", "AS rank FROM hits JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY query_id) USING (query_id) WHERE matched = need") + " SELECT query_id, id, rank, score FROM top",
        "w1_ranked_within_budget": f"""{_BM25_SQL},
            b AS (SELECT query_id, id, rank, score, least(length(text), 1400) AS chars FROM top JOIN documents ON doc_id = id),
            s AS (SELECT *, (sum(chars) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS spent FROM b)
            SELECT * FROM s WHERE rank = 0 OR spent <= 7000""",
        "g21_recall": f"""{_BM25_SQL},
            rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
            n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
            ks AS (SELECT unnest([1, 5, 10]) AS k),
            f AS (SELECT n.query_id, k, n, count(t.id) AS found FROM n CROSS JOIN ks LEFT JOIN (SELECT top.* FROM top JOIN rel USING (query_id, id)) t ON t.query_id = n.query_id AND t.rank < k GROUP BY ALL)
            SELECT query_id, k, round(found / n, 6) AS recall, round(least(k, n) / n, 6) AS ceiling, round(found / n / (least(k, n) / n), 6) AS recall_norm, (found > 0)::INT AS hit FROM f""",
        "g22_retrieval_arms": f"""{_BM25_SQL},
            ik AS (SELECT item_id, array_to_string(({_TOKENS})[1:3], ' ') AS key FROM benchmark),
            dk AS (SELECT doc_id, array_to_string(({_TOKENS})[1:3], ' ') AS key FROM documents),
            keyed AS (SELECT * FROM (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS rank FROM ik JOIN dk USING (key) WHERE key <> '') WHERE rank < 10),
            both_ AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, 1000.0 - rank AS score FROM keyed UNION ALL SELECT query_id, id, score FROM top) GROUP BY query_id, id),
            mixed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM both_)
            SELECT 'keyed' AS arm, query_id, id, rank FROM keyed UNION ALL SELECT 'bm25', query_id, id, rank FROM top UNION ALL SELECT 'keyed_bm25', query_id, id, rank FROM mixed WHERE rank < 10""",
        "s21_chunks": """
            SELECT doc_id, (i - 1) // 4 AS chunk, min(i) AS start_line, md5(string_agg(line, chr(10) ORDER BY i)) AS body_md5
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY 1, 2""",
        "s20_lead": r"""
            SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 40 AND NOT regexp_matches(trim(s), '^[=|*#{]'))[1]), 500) AS lead FROM documents""",
        "u1_ordered_terms": f"""SELECT item_id, array_to_string(list_transform({first_seen('t')}, lambda w: '"' || w || '"'), ' OR ') AS match_query FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)""",
        "l7_offers": "SELECT doc_id, left(array_to_string((string_split(coalesce(text, ''), chr(10)))[1:8], ' '), 400) AS offer FROM documents",
    }
