"""Source divergence audit: how far the term use of every source lies from that of the other sources and of its language.

Plain relational: the terms of every text are matched and exploded, counted per
(lang, source, term) before anything is shuffled, the groups are crossed with the
terms that their language keeps, so that a term that a group lacks stands there
with count 0, and the crossed rows are joined with themselves on language and
term, summed and ranked.

A term is a run of letters (all characters beyond ASCII count as such), A-Z
lower-cased. Shares are whole numbers of a thousand millionths, computed in
decimals, so that nothing is rounded and nothing overflows. The difference of two
sources is the same both ways: every pair is summed once and told twice.

Scale: rows grow with the sources of a language times its kept terms, which is
what the audit compares; the crossing is dealt by language and a hash of the term,
so that one language of a third of all rows is spread over all tasks, and so is
the joining, by language and term. Nothing is broadcast by hand.

Defined cases: null text, language and source count as the empty string; a group
without terms takes part with all counts 0; a language that keeps no term has
pairs of value 0 and no terms; repeated rows count each time; ties are ranked by
the item's UTF-8 bytes; texts of any length are taken whole; other columns of the
documents are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must stand in, added counts per term, parts of a share, ranks told of the terms.
LEAST_DOCUMENTS, ADDED, PARTS, TOP = 30, 5, 1_000_000_000, 50


def terms(text: Column) -> Column:
    """The matches of TERM in order: what stands between the runs of all other characters."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, TERM.replace("[^", "[")), "")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents) of docs (lang, source, text)."""
    found = docs.select("lang", "source", terms(F.col("text")).alias("terms"))
    # Every term of a text, and after them each different one again: one pass tells occurrences and documents.
    both = found.select("lang", "source", F.size("terms").alias("k"), F.concat("terms", F.array_distinct("terms")).alias("both"))
    each = both.select("lang", "source", "k", F.posexplode_outer("both").alias("place", "term")).filter("term IS NOT NULL")
    occurs = F.col("place") < F.col("k")
    return each.groupBy("lang", "source", "term").agg(F.count(F.when(occurs, 1)).alias("n"), F.count(F.when(~occurs, 1)).alias("n_docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + the whole part of PARTS (n + ADDED) / (total + ADDED kept)."""
    whole = F.expr(f"(cast({PARTS} AS decimal(10, 0)) * cast({n} + {ADDED} AS decimal(20, 0))) div cast({total} + {ADDED} * {kept} AS decimal(20, 0))")
    return F.lit(1).cast("long") + whole


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    steps, salts = Steps(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = steps.written(plain.select("lang", "source").distinct(), "groups")
    counts = steps.written(term_counts(plain), "term-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d")).filter(F.col("d") >= least_documents).drop("d")
    vocabulary = steps.written(of_lang, "vocabulary")
    kept = counts.join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    totals = steps.written(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sized = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    dealt = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    crossed = dealt.join(salted, ["lang", "salt"]).join(kept, ["lang", "source", "term"], "left").fillna(0, ["n"])
    shares = crossed.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    shares = steps.written(shares, "shares")

    left = shares.select("lang", "term", "source", "p")
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"))
    summed = left.join(right, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("r"))).alias("value"))
    every = groups.join(groups.select("lang", F.col("source").alias("other")), "lang").filter("source < other")
    once = every.join(summed, ["lang", "source", "other"], "left").fillna(0, ["value"])
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "other"), ("other", "source"))]))
    pairs = once.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    over = shares.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(over.withColumn("rank", place).filter(F.col("rank") <= top))
    out = steps.written(ranked.select("lang", "source", "part", "item", "value", "rank"), "audit")
    steps.over(out)
    return out


#: The same in DuckDB's SQL.
SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS w
        FROM documents),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
    counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
    shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               (1 + {PARTS}::HUGEINT * (coalesce(c.n, 0) + {ADDED}) // (coalesce(t.total, 0) + {ADDED} * l.v))::BIGINT AS p,
               (1 + {PARTS}::HUGEINT * (k.lang_n + {ADDED}) // (l.lang_total + {ADDED} * l.v))::BIGINT AS q
        FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
             LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
             LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
    summed AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    said AS (
        SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0) AS value
        FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
             LEFT JOIN summed s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
    FROM said QUALIFY part = 'pair' OR rank <= {TOP}"""
