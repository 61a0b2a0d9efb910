"""Three-stage matching of candidate items against reference items, per (key, ref_idx).

Items are rows of ``(key, ref_idx, item)``; repeated rows count (multisets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot

GROUP = ["key", "ref_idx"]
#: Stands between the components of a relation's item.
SEP = "\x1f"


def aligned(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """Each reference with its key's candidate; keys without one are kept with null, extra candidates go."""
    return refs.join(preds.withColumnRenamed("text", "pred_text"), "key", "left")


def exact_matches(cand: DataFrame, ref: DataFrame) -> DataFrame:
    """``(key, ref_idx, n_exact)``: size of the multiset intersection.

    Both sides are counted per item first, so a hot item is one row a group.
    """
    a = cand.groupBy(*GROUP, "item").agg(F.count("*").alias("nc"))
    b = ref.groupBy(*GROUP, "item").agg(F.count("*").alias("nr"))
    return a.join(b, [*GROUP, "item"]).groupBy(*GROUP).agg(F.sum(F.least("nc", "nr")).alias("n_exact"))


def remainder(side: DataFrame, other: DataFrame) -> DataFrame:
    """Items of ``side`` that no equal item of ``other`` is left for (multiset difference)."""
    nth = Window.partitionBy(*GROUP, "item").orderBy("item")
    number = lambda df: df.select(*GROUP, "item").withColumn("nth", F.row_number().over(nth))
    return number(side).join(number(other), [*GROUP, "item", "nth"], "left_anti").drop("nth")


def synonymous(a: Column, b: Column, lemmas_a: Column, lemmas_b: Column) -> Column:
    """One holds the other, or they share a lemma."""
    return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(lemmas_a, lemmas_b)


def with_lemmas(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``lemmas`` of each item from a lexicon of ``(word, lemma)``; none: an empty array."""
    per = lexicon.groupBy("word").agg(F.collect_set("lemma").alias("lemmas"))
    form = F.regexp_replace(F.trim("item"), r"\s+", "_")
    out = items.join(per, form == F.col("word"), "left").drop("word")
    return out.withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))


def with_part_lemmas(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``parts`` of each item, its components between SEP in order, with the lemmas of each."""
    nth = F.row_number().over(Window.partitionBy(*GROUP, "item").orderBy("item"))
    rows = items.select(*GROUP, "item", nth.alias("nth")).select(*GROUP, "nth", F.col("item").alias("whole"), F.posexplode(F.split("item", SEP)).alias("p", "item"))
    part = F.struct("p", "item", "lemmas")
    return with_lemmas(rows, lexicon).groupBy(*GROUP, F.col("whole").alias("item"), "nth").agg(F.sort_array(F.collect_list(part)).alias("parts")).drop("nth")


def greedy(options: Column) -> Column:
    """``(cand, ref)`` position arrays when each candidate in turn takes its first free reference.

    ``options``: array of ``(i, js)`` structs in order of i, js being the ascending
    positions of the references that fit candidate i.
    """
    none = F.array().cast("array<int>")

    def step(s, o):
        j = F.try_element_at(F.filter(o["js"], lambda x: ~F.array_contains(s["ref"], x)), F.lit(1))
        took = F.struct(F.array_append(s["cand"], o["i"]).alias("cand"), F.array_append(s["ref"], j).alias("ref"))
        return F.when(j.isNull(), s).otherwise(took)

    return F.aggregate(options, F.struct(none.alias("cand"), none.alias("ref")), step)


def synonym_matches(cand: DataFrame, ref: DataFrame) -> DataFrame:
    """``(key, ref_idx, n_synonym, cand_left, ref_left)`` of items with ``lemmas``,
    or with ``parts``, which then must be synonymous one by one.

    Candidates take references in lexicographic order. Pairs that fit are found by a
    join within a caption and its reference; the fold then sees those alone.
    """
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("item"))
    c, r = cand.withColumn("i", place), ref.withColumn("j", place)
    whole = lambda df: F.col("parts") if "parts" in df.columns else F.array(F.struct("item", "lemmas"))
    both = c.select(*GROUP, "i", whole(c).alias("pc")).join(r.select(*GROUP, "j", whole(r).alias("pr")), GROUP)
    alike = F.zip_with("pc", "pr", lambda x, y: synonymous(x["item"], y["item"], x["lemmas"], y["lemmas"]))
    fit = both.where(F.forall(alike, lambda x: x)).groupBy(*GROUP, "i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    fit = fit.groupBy(*GROUP).agg(greedy(F.sort_array(F.collect_list(F.struct("i", "js")))).alias("s"))
    gather = lambda df, name: df.groupBy(*GROUP).agg(F.sort_array(F.collect_list("item")).alias(name))
    rows = gather(cand, "c").join(gather(ref, "r"), GROUP, "full").join(fit, GROUP, "left")
    taken = lambda side: F.coalesce(F.col(f"s.{side}"), F.array().cast("array<int>"))
    left = lambda items, side: F.coalesce(F.filter(items, lambda x, k: ~F.array_contains(taken(side), k + 1)), F.array().cast("array<string>"))
    return rows.select(*GROUP, F.size(taken("cand")).alias("n_synonym"), left("c", "cand").alias("cand_left"), left("r", "ref").alias("ref_left"))


def soft_matches(cand: DataFrame, ref: DataFrame) -> DataFrame:
    """``(key, ref_idx, cand_soft, ref_soft)``: sums of each side's best similarity to the other.

    Items carry ``embedding``; a repeated item counts as often as it stands there; groups with an empty side have no row. The join pairs the
    items of one caption with those of one reference, which are bounded by their texts.
    """
    side = lambda df, x: df.groupBy(*GROUP, F.col("item").alias(x)).agg(F.first("embedding").alias(f"{x}e"), F.count("*").alias(f"{x}n"))
    pairs = side(cand, "c").join(side(ref, "r"), GROUP).withColumn("sim", dot(F.col("ce"), F.col("re")))
    best = lambda x, name: pairs.groupBy(*GROUP, x).agg((F.max("sim") * F.first(f"{x}n")).alias("m")).groupBy(*GROUP).agg(F.sum("m").alias(name))
    by_cand, by_ref = best("c", "cand_soft"), best("r", "ref_soft")
    return by_cand.join(by_ref, GROUP)
