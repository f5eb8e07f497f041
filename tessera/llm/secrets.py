"""Secret scan over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger
holds, for each blob, the rule versions that have scanned it and what they
found; it is bucketed and sorted by blob, so a batch meets it in a sort-merge
join that does not move it, and only what it says of the batch's own blobs goes
on. A scan digests the rows, takes one row of every blob that lacks some current
rule version, runs just the missing rules over it, appends to the ledger, and
joins the findings back to every row ("path") with that content. So a text that
many paths share is scanned once, and a later run over a grown corpus, or with
one new rule, scans only what is new. A scan that is repeated after a failure
finds what it had appended and scans the rest; findings said twice count once.

All on the JVM: matches come from ``regexp_extract_all``, their places from the
lengths of the pieces that ``split`` leaves between them (in code points), added
up in runs of ``RUN`` matches, so that the work grows in proportion to them.

Defined cases: a null text counts as empty; texts of any length are scanned
whole; spans of different rules may overlap, those of one rule do not; a whole
match is the span, end exclusive; repeated rows are answered one by one; columns
other than the id and the text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BucketedTable, Steps, fresh_path


@dataclass(frozen=True)
class Rule:
    """kind; pattern; a cheaper pattern that every matching text has; the group whose length counts and the least length."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        said = f"{self.pattern}|{self.group}|{self.least}"
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:12]}"


#: Fixed by the contract of the base spans, in the order in which kinds are listed.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i:passw(?:or)?d|secret|token|api_?key)",
        2,
        8,
    ),
    Rule("access", r"(AKIA[A-Z0-9]{12,})", "AKIA"),
    Rule("hex", r"([0-9a-f]{32,})", r"[0-9a-f]{32}"),
)
#: What this scanner finds besides.
MORE = (
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", "-----BEGIN "),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", "gh[pousr]_"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ"),
)
RULES = BASE + MORE

SPANS = "array<struct<kind:string,start:int,stop:int>>"
#: Matches whose places are added up at a time.
RUN = 256
LEDGER = f"blob string, versions array<string>, found {SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def spans_of(text: Column, rule: Rule) -> Column:
    """All spans of one rule in a text."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("counted"),
    )
    places = F.transform(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        lambda p: F.struct(F.length(p["between"]).alias("gap"), F.length(p["match"]).alias("n"), (F.length(p["counted"]) >= rule.least).alias("counts")),
    )
    none = F.array().cast(SPANS)

    def in_runs(places: Column) -> Column:
        last = F.floor((F.greatest(F.size(places), F.lit(1)) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(places, k * RUN + 1, F.lit(RUN)))

    def starts(runs: Column) -> Column:
        """Where every run of matches starts."""
        length = lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + p["gap"] + p["n"])
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
        return F.aggregate(F.transform(runs, length), zero, step, lambda s: s["starts"])

    def step(so_far: Column, p: Column) -> Column:
        start = so_far["at"] + p["gap"]
        stop = start + p["n"]
        span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), stop.alias("stop"))
        found = F.when(p["counts"], F.concat(so_far["found"], F.array(span))).otherwise(so_far["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    def spans(run: Column, start: Column) -> Column:
        return F.aggregate(run, F.struct(start.alias("at"), none.alias("found")), step, lambda a: a["found"])

    every = _let(places, lambda p: _let(in_runs(p), lambda runs: F.flatten(F.zip_with(runs, starts(runs), spans))))
    return F.when(text.rlike(rule.hint), every).otherwise(none)


def open_ledger(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> BucketedTable:
    """The ledger at path; a new one where there is none yet."""
    return BucketedTable(spark, path or fresh_path(spark, "blob-ledger"), LEDGER, "blob", buckets)


def scan(
    docs: DataFrame, ledger: BucketedTable, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, blob, found (spans by start, then rule order). Extends the ledger."""
    steps = Steps(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    paths = steps.written(texts.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = steps.written(paths.groupBy("blob").agg(F.min("doc_id").alias("at")), "blobs")
    known = steps.written(ledger.read().join(blobs.select("blob"), "blob", "left_semi"), "known-blobs")
    done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("done"))
    missing = (
        blobs.join(done, "blob", "left")
        .select("blob", "at", F.array_except(versions, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    todo = steps.written(missing, "unseen").withColumnRenamed("blob", "unseen")
    found = [
        F.when(F.array_contains("todo", r.version), spans_of(F.col("text"), r)).otherwise(F.array().cast(SPANS)) for r in rules
    ]
    rows = texts.withColumn("blob", blob_of(F.col("text"))).join(
        todo, (F.col("blob") == F.col("unseen")) & F.col("doc_id").eqNullSafe(F.col("at"))
    )
    scanned = rows.select("blob", F.col("todo").alias("versions"), F.concat(*found).alias("found"))
    new = steps.written(scanned.dropDuplicates(["blob"]), "scanned")  # rows that repeat both id and text are one blob
    ledger.append(new)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(
        "found", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("nth"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    )
    kind_version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    current = F.filter(keyed, lambda s: F.array_contains(F.col("versions"), F.element_at(kind_version, s["kind"])))
    hits = (
        known.unionByName(new)
        .filter(F.size("found") > 0)
        .select("blob", current.alias("found"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    )
    findings = steps.written(hits, "findings")
    steps.over(paths, findings)
    back = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce(back, F.array().cast(SPANS)).alias("found"))


def said(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))

    def of(kind: str) -> Column:
        return F.filter("found", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
