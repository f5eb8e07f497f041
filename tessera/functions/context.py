"""What an artifact is matched on: contexts written as JSON in JSON, the fields that are the store's own, bodies that are not at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 3
#: Fields that a store keeps for itself.
OWNED = ("id", "state", "content_ref", "size", "collection_id", "created_by", "created_time", "provenance", "cited_from")


def unwrapped(raw: Column, levels: int = LEVELS) -> Column:
    """A context that is a JSON string of JSON, taken out of its quotes up to so many times; what is no JSON string stays as it is."""
    out = raw
    for _ in range(levels):
        inner = F.get_json_object(F.concat(F.lit('{"x":'), out, F.lit("}")), "$.x")
        out = F.when(F.ltrim(out).startswith('"') & inner.isNotNull(), inner).otherwise(out)
    return out


def offer_text(context: Column) -> Column:
    """The fields of a context (a map) that are not the store's own and not blank, in order of their names."""
    kept = F.map_filter(context, lambda k, v: ~k.isin(*OWNED) & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def resolved(artifacts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, title, content, preview) of artifacts (id, title, description, content_ref): the body by its address, or the description as a preview where it is not at hand; the first line as title of what has none."""
    held = bodies.select(F.col("content_ref").alias("ref"), F.col("content").alias("body"))
    rows = artifacts.join(held, F.col("content_ref") == F.col("ref"), "left")
    text = F.coalesce("body", "description")
    return rows.select("id", F.coalesce("title", F.substring(F.split(text, "\n")[0], 1, 200)).alias("title"), text.alias("content"), F.col("body").isNull().alias("preview"))
