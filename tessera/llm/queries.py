"""The queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, divergence, exact_dedup, features, html_extract, minhash, quality, secrets, sharding, simhash, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Production shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.open_index(spark)
    found = exact_dedup.dedup_exact(table(spark, sf_dir, "documents"), index)
    index.discard()  # begun for this query alone, and the answer does not read it
    return found


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.open_ledger(spark)
    found = secrets.scan(table(spark, sf_dir, "documents"), ledger)
    ledger.discard()  # as above
    return secrets.report(found)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op12_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(*[table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (
        op1_exact_dedup, op2_html_extract, op3_bpe, op4_url_filter, op5_decontamination,
        op6_minhash, op7_quality, op8_secrets, op9_sharding, op10_chat_format,
        op11_simhash, op12_features, op13_divergence,
    )
    return {f.__name__: f for f in every}


def _secret_sql() -> str:
    """Places of matches: lengths of what lies between them, added up."""
    quoted = lambda s: s.replace("'", "''")
    names = [r.kind for r in secrets.RULES]
    kinds = []
    for nth, r in enumerate(secrets.RULES):
        pattern = quoted(r.pattern)
        kinds.append(f"""
            SELECT doc_id, text, {nth} AS nth, '{r.kind}' AS kind, {r.least} AS least,
                   regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g,
                   string_split_regex(text, '{pattern}') AS p
            FROM docs WHERE regexp_matches(text, '{pattern}')""")
    base = ", ".join(f"'{k}'" for k in names[: len(secrets.BASE)])
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        hits AS ({" UNION ALL ".join(kinds)}),
        cut AS (
            SELECT doc_id, nth, kind, least, length(g[i]) AS counted, length(m[i]) AS n,
                   list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)),
        spans AS (SELECT doc_id, nth, kind, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS said FROM cut WHERE counted >= least),
        each AS (
            SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY start, nth) AS spans,
                   string_agg(said, ',' ORDER BY start, nth) FILTER (kind IN ({base})) AS base
            FROM spans GROUP BY doc_id)
        SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs d LEFT JOIN each e ON d.doc_id = e.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": r"""
            WITH docs AS (
                SELECT row_number() OVER () AS r, doc_id,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM documents),
            items AS (
                SELECT coalesce(item_id::VARCHAR, 'null') AS item_id,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM benchmark),
            phrases AS (
                SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS said
                FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
            places AS (
                SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS said
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
            hits AS (SELECT r, i, n, item_id FROM places JOIN phrases USING (n, said)),
            covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
            found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
            SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""",
        "op8_secrets": _secret_sql(),
        "op12_features": features.SQL,
        "op13_divergence": divergence.SQL,
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
