"""Pieces of SQL that several queries are compared with."""

from __future__ import annotations

TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def signal_ctes(source: str, key: str, x: str, ident: str, p: str = "") -> str:
    """CTEs that end in {p}cut (key, n, k, eta2, null_eta2, separated) and {p}rows (key, x, ident, nth from 1): where each list's signal ends."""
    return f"""
        {p}rows AS (SELECT {key} AS key, ({x})::DOUBLE AS x, {ident} AS ident, row_number() OVER (PARTITION BY {key} ORDER BY {x} DESC, {ident}) AS nth, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
        {p}sums AS (SELECT *, sum(x) OVER (PARTITION BY key ORDER BY nth) AS s, sum(x) OVER (PARTITION BY key) AS t, sum(x * x) OVER (PARTITION BY key) AS q FROM {p}rows),
        {p}eta AS (SELECT key, nth, CASE WHEN q - t * t / n > 1e-12 * q THEN nth * (n - nth) / n * (s / nth - (t - s) / (n - nth)) ** 2 / (q - t * t / n) END AS eta2 FROM {p}sums WHERE nth < n),
        {p}best AS (SELECT key, max(eta2) AS eta2, min(nth) FILTER (eta2 = m) AS nth FROM (SELECT *, max(eta2) OVER (PARTITION BY key) AS m FROM {p}eta) GROUP BY 1),
        {p}ramp AS (SELECT n, max(j * (n - j) / n * (n / 2) ** 2 / (n * (n * n - 1) / 12)) AS null_eta2 FROM (SELECT n, unnest(range(1, n)) AS j FROM (SELECT DISTINCT n FROM {p}rows WHERE n >= 3)) GROUP BY 1),
        {p}met AS (SELECT DISTINCT r.key, r.n, b.eta2, z.null_eta2, CASE WHEN r.n >= 3 AND b.eta2 IS NOT NULL THEN round(b.eta2, 12) > round(z.null_eta2, 12) END AS separated, b.nth
                   FROM {p}rows r LEFT JOIN {p}best b USING (key) LEFT JOIN {p}ramp z ON z.n = r.n),
        {p}cut AS (SELECT key, n, CASE WHEN separated THEN nth ELSE n END AS k, eta2, null_eta2, separated FROM {p}met)"""
