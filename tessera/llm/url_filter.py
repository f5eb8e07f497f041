"""URL filter: rules first, gradient-boosted trees for the URLs that no rule fits.

A rule blocks or allows a host, all its subdomains, and paths with a given
start; the longest fitting rule wins. The URLs that a rule decides are the
labelled URLs: on a bounded, hash-ordered sample of them boosted trees are
fitted to lexical features (length, depth, digit ratio, entropy, parameter
counts, and how often rules block the host's suffixes and the path's first
part, counted over all labelled URLs). What is counted for a labelled URL leaves
its own host out, so that no URL brings its own verdict into its features. The
trees then judge every URL without a rule. Features, fitting and scoring run on
the JVM. ``held_out`` fits on four fifths of the labelled hosts and says how the
trees do on the others.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and is judged by the trees like any other; URLs of any length and with any
characters are taken whole; with labelled URLs of one verdict only, that verdict
is the answer, and with none it is ``allow``; repeated rows are judged one by
one; other columns are ignored, whatever their names; an empty table gives an
empty result. Ties between rules of equal length cannot occur, as two such rules
that fit one URL are the same rule.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed by the contract.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Labelled URLs that the trees are fitted to, at most; the first by hash.
SAMPLE = 4000
TREES, DEPTH, SEED = 10, 4, 17
PARTS = ("suffix", "domain", "section")
FEATURES = (
    "n_chars", "host_chars", "host_labels", "path_chars", "path_depth", "digit_ratio", "entropy", "n_params",
    "query_chars", "has_fragment", "is_https", "n_hyphens", "suffix_block", "domain_block", "section_block",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; both null without one."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for said, h, p in longest:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "n_chars": F.length(text),
        "host_chars": F.length(host),
        "host_labels": F.size(F.split(host, r"\.")),
        "path_chars": F.length(path),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / n,
        "entropy": entropy,
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_chars": F.length(query),
        "has_fragment": text.contains("#").cast("int"),
        "is_https": text.startswith("https://").cast("int"),
        "n_hyphens": F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit(""))),
    }


def ruled_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict) and the parts of host and path whose verdicts are counted."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return plain.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict}).withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "domain": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
            "section": F.regexp_extract("path", r"^/?([^/]*)", 1),
        }
    )


def rated(df: DataFrame, known: DataFrame, prior: float, own: bool) -> DataFrame:
    """df with FEATURES. ``own``: whether what is known of a URL's own host counts; not for a URL to learn from."""
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    for part in PARTS:
        total = known.groupBy(F.col(part).alias("_part")).agg(blocked.alias("_b"), F.count(F.lit(1)).alias("_n"))
        df = df.join(total, F.col(part) == F.col("_part"), "left").drop("_part")
        b, n = F.coalesce("_b", F.lit(0)), F.coalesce("_n", F.lit(0))
        if not own:
            at_host = known.groupBy(F.col(part).alias("_part"), F.col("host").alias("_host")).agg(blocked.alias("_hb"), F.count(F.lit(1)).alias("_hn"))
            df = df.join(at_host, (F.col(part) == F.col("_part")) & (F.col("host") == F.col("_host")), "left").drop("_part", "_host")
            b, n = b - F.coalesce("_hb", F.lit(0)), n - F.coalesce("_hn", F.lit(0))
        df = df.withColumn(f"{part}_block", (b + prior) / (n + 1)).drop("_b", "_n", "_hb", "_hn")
    return df.withColumns({k: v.cast("double") for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()})


def learn(known: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float, str]:
    """(the trees, the share of blocked URLs, the answer without trees) of labelled URLs; no trees where all have one verdict."""
    blocked, labelled = known.agg(F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    if blocked in (0, labelled):
        return None, 0.5, "block" if blocked else "allow"
    prior = blocked / labelled
    chosen = known.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(sample).coalesce(1).cache()
    try:
        train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated(chosen, known, prior, False))
        train = train.select("features", (F.col("ruled") == "block").cast("double").alias("label")).coalesce(1)
        return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(train), prior, ""
    finally:
        chosen.unpersist()


def scored(df: DataFrame, known: DataFrame, model: Model, prior: float) -> DataFrame:
    """df with score, the trees' probability that a URL is to be blocked."""
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated(df, known, prior, True))
    return model.transform(features).withColumn("score", vector_to_array(F.col("probability"))[1])


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (of the trees, null where a rule decides)."""
    ruled = ruled_urls(pages, rules, id_col, url_col)
    known, others = ruled.filter("ruled IS NOT NULL"), ruled.filter("ruled IS NULL")
    model, prior, only = learn(known, sample)
    no_score = F.lit(None).cast("double").alias("score")
    if model is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), no_score)
    by_rule = known.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), no_score)
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict")
    return by_rule.unionByName(scored(others, known, model, prior).select("page_id", "host", "path", "rule", verdict, "score"))


def held_out(pages: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> dict[str, float]:
    """How the trees judge labelled URLs of hosts that they have not seen: n, accuracy, and what the commoner verdict alone would reach (null ratios for n = 0)."""
    known = ruled_urls(pages, rules, id_col, url_col).filter("ruled IS NOT NULL")
    away = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    seen, unseen = known.filter(~away), known.filter(away)
    model, prior, only = learn(seen, sample)
    said = unseen.select("ruled", F.lit(only).alias("said")) if model is None else scored(unseen, seen, model, prior).select(
        "ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("said")
    )
    n, right, blocked = said.agg(
        F.count(F.lit(1)), F.avg((F.col("said") == F.col("ruled")).cast("double")), F.avg((F.col("ruled") == "block").cast("double"))
    ).first()
    return {"n": n, "accuracy": right, "commoner": None if blocked is None else max(blocked, 1 - blocked)}
