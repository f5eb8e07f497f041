"""From texts to concepts: seeds by longest compound and morphology, operator concepts, stated relations, offers, modifiers.

A lexicon is (name, concept, prior): names of one word or of several joined by
"_"; a name has a row per sense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.resolve import leading

#: Endings and what takes their place, in the order in which they are tried.
ENDINGS = (("ies", "y"), ("es", "e"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("er", ""), ("est", ""))


def base_forms(word: Column) -> Column:
    """What a word may be an inflection of, likeliest first; the word itself comes first."""
    tried = [F.when(word.endswith(e) & (F.length(word) > len(e) + 1), F.concat(F.expr("substring(w, 1, length(w) - %d)" % len(e)), F.lit(to))) for e, to in ENDINGS]
    return F.array_compact(F.array(word, *tried))


def names_in(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, at, name, word): names of the lexicon in texts (id, text), longest compound first from the left; word is what stands there. Compounds may have any number of words.

    Words that no compound takes are names themselves or inflections of one.
    """
    names = lexicon.select("name").distinct()
    words = texts.select("id", F.posexplode(tokens(F.col("text"))).alias("at", "w"))
    # Compounds of any length: where their first word stands, the others must follow.
    parts = names.select("name", F.split("name", "_").alias("p")).filter(F.size("p") > 1)
    begun = words.join(parts.withColumn("w", F.get("p", F.lit(0))), "w").select("id", F.col("at").alias("from"), "name", F.size("p").alias("n"), F.posexplode("p").alias("k", "w")).filter("k > 0")
    met = begun.select("id", "from", "name", "n", "w", (F.col("from") + F.col("k")).alias("at")).join(words, ["id", "at", "w"])
    found = met.groupBy("id", F.col("from").alias("at"), "n", "name").agg(F.countDistinct("at").alias("met")).filter("met = n - 1").drop("met")
    ordered = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "name")))
    step = lambda so, x: F.when(x["at"] >= so["free"], F.struct((x["at"] - x["less"]).alias("free"), F.concat(so["taken"], F.array(x)).alias("taken"))).otherwise(so)
    kept = found.groupBy("id").agg(ordered.alias("c"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,less:int,name:string>>").alias("taken"))
    taken = kept.select("id", F.explode(F.aggregate("c", start, step, lambda s: s["taken"])).alias("x")).select("id", F.col("x.at").alias("at"), (-F.col("x.less")).alias("n"), F.col("x.name").alias("name"))
    covered = taken.select("id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    left = words.join(covered, ["id", "at"], "left_anti")
    forms = left.select("id", "at", "w", F.posexplode(base_forms(F.col("w"))).alias("k", "name")).join(names, "name")
    best = forms.groupBy("id", "at", "w").agg(F.min(F.struct("k", "name")).alias("b")).select("id", "at", F.col("b.name").alias("name"), F.col("w").alias("word"))
    return taken.select("id", "at", "name", F.col("name").alias("word")).unionByName(best)


def seeds_from_text(texts: DataFrame, lexicon: DataFrame, bits: DataFrame) -> DataFrame:
    """(id, concept, energy): every name's senses by their prior times the name's bits (name, bits), 1 where unmeasured; summed over a text."""
    senses = names_in(texts, lexicon).join(lexicon, "name").join(bits, "name", "left")
    return senses.groupBy("id", "concept").agg(F.sum(F.col("prior") * F.coalesce("bits", F.lit(1.0))).alias("energy"))


def seeds_from_artifact(artifacts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, concept, energy) of artifacts (id, concept, lemmas array, text): the concept it stands for by 1, else its lemmas' senses, else those of its text's names."""
    own = artifacts.filter("concept IS NOT NULL").select("id", "concept", F.lit(1.0).alias("energy"))
    lemmas = artifacts.filter("concept IS NULL").select("id", F.explode("lemmas").alias("name")).join(lexicon, "name").select("id", "concept", F.col("prior").alias("energy"))
    rest = artifacts.filter("concept IS NULL").join(lemmas.select("id").distinct(), "id", "left_anti").select("id", "text")
    said = names_in(rest, lexicon).join(lexicon, "name").select("id", "concept", F.col("prior").alias("energy"))
    return own.unionByName(lemmas).unionByName(said).groupBy("id", "concept").agg(F.sum("energy").alias("energy"))


def operator_concepts(texts: DataFrame, attested: DataFrame) -> DataFrame:
    """(id, concept): all senses of the words of a text whose surface form is attested. attested (form, concept, count)."""
    words = texts.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("form"))
    return words.join(attested.filter("count > 0"), "form").select("id", "concept").distinct()


def stated_relations(leads: DataFrame, edges: DataFrame, field: DataFrame, operator: DataFrame) -> DataFrame:
    """(lead, label, far, weight): the edges of the leads that a question is about: root of the far end's energy times the label's, cut where each lead's signal ends.

    field (concept, energy), operator (label, energy). A pair of ends counts once,
    whichever way it is stated; of equal words only the strongest relation.
    """
    ends = edges.select(F.col("src").alias("lead"), "label", F.col("dst").alias("far")).unionByName(edges.select(F.col("dst").alias("lead"), "label", F.col("src").alias("far")))
    met = ends.join(leads.select("lead").distinct(), "lead", "left_semi").join(field.select(F.col("concept").alias("far"), F.col("energy").alias("e_far")), "far")
    met = met.join(operator.select("label", F.col("energy").alias("e_op")), "label").filter("e_far > 0 AND e_op > 0")
    scored = met.select("lead", "label", "far", F.round(F.sqrt(F.col("e_far") * F.col("e_op")), 9).alias("weight"), F.concat_ws("|", "label", "far").alias("ident"))
    strong = leading(scored, "lead", "weight", "ident").drop("rank", "ident")
    pair = W.partitionBy(F.least("lead", "far"), F.greatest("lead", "far")).orderBy(F.desc("weight"), "lead", "label")
    return strong.withColumn("nth", F.row_number().over(pair)).filter("nth = 1").drop("nth")


def offers_table(operators: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, concepts): what operators (id, text) are matched on; an empty list for one that names nothing known."""
    known = operator_concepts(operators, lexicon.select(F.col("name").alias("form"), "concept", F.lit(1).alias("count")))
    listed = known.groupBy("id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    return operators.select("id").join(listed, "id", "left").select("id", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


def projected_positions(modifiers: DataFrame, edges: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(modifier, noun): what modifiers (modifier) are about, by edges of these labels in either direction."""
    some = edges.filter(F.col("label").isin(*labels))
    both = some.select("src", "dst").unionByName(some.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(modifiers.select(F.col("modifier").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("modifier"), F.col("dst").alias("noun")).distinct()


def subject_concepts(texts: DataFrame, lexicon: DataFrame, salient: DataFrame) -> DataFrame:
    """(id, concept): the senses of a text's salient terms (id, term), of all its terms where none is salient."""
    words = texts.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    some = salient.select("id", "term", F.lit(True).alias("s")).distinct()
    marked = words.join(some, ["id", "term"], "left").withColumn("has", F.max(F.col("s")).over(W.partitionBy("id")))
    used = marked.filter(F.coalesce("s", F.lit(False)) | F.col("has").isNull()).select("id", F.col("term").alias("name"))
    return used.join(lexicon, "name").select("id", "concept").distinct()
