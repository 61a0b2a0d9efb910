"""Scene graphs: from a parser's sentences to the objects, attributes and relations of a text.

A graph is one sentence: ``entities`` array of ``(head, quantity, attributes)`` structs and
``relations`` array of ``(subject, relation, object)``, where subject and object are places,
from 0, in the entities of the same sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import grounded

GRAPH = "struct<entities:array<struct<head:string,quantity:string,attributes:array<string>>>,relations:array<struct<subject:int,relation:string,object:int>>>"


def lemmatised(items: DataFrame, column: str, lexicon: DataFrame, kind: str) -> DataFrame:
    """``items`` with the words of ``column`` replaced by their lemma of a part of speech; unknown words stay.

    ``lexicon``: (word, kind, lemma). Of several lemmas the smallest counts.
    """
    own = lexicon.where(F.col("kind") == kind).groupBy(F.col("word").alias(column)).agg(F.min("lemma").alias("__lemma"))
    return items.join(own, column, "left").withColumn(column, F.coalesce("__lemma", column)).drop("__lemma")


def named_relations(graph: Column) -> Column:
    """Relations of a graph with the heads in place of indices; indices out of range give null ends."""
    head = lambda i: F.try_element_at(graph["entities"], i + 1)["head"]
    return F.transform(graph["relations"], lambda r: F.struct(head(r["subject"]).alias("subject"), r["relation"].alias("relation"), head(r["object"]).alias("object")))


def graph_rows(graphs: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, kind, a, b, c)`` of the graphs of a text: objects, ``(head, attribute)`` and ``(subject, relation, object)``.

    Rows are distinct over the sentences of a text, and partitioned by ``group``. Attributes that hold `` of`` are left
    out. ``graphs``: ``(*group, graph)``.
    """
    null = F.lit(None).cast("string")
    row = lambda kind, a, b=null, c=null: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    g = F.col("graph")
    objects = F.transform(g["entities"], lambda e: row("object", e["head"]))
    plain = lambda e: F.filter(F.coalesce(e["attributes"], F.array().cast("array<string>")), lambda x: ~F.contains(x, F.lit(" of")))
    attributes = F.flatten(F.transform(g["entities"], lambda e: F.transform(plain(e), lambda x: row("attribute", e["head"], x))))
    relations = F.transform(named_relations(g), lambda r: row("relation", r["subject"], r["relation"], r["object"]))
    own = F.array_distinct(F.concat(objects, attributes, relations))
    return graphs.select(*group, F.explode(own).alias("x")).select(*group, "x.*").repartition(*group).distinct()


def lemma_rows(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """graph_rows with heads as noun and attributes as adjective lemmas; relation words stay."""
    heads = lemmatised(rows, "a", lexicon, "noun")
    ends = lemmatised(heads.where("kind = 'relation'"), "c", lexicon, "noun")
    words = lemmatised(heads.where("kind = 'attribute'"), "b", lexicon, "adjective")
    cols = rows.columns
    return heads.where("kind = 'object'").select(cols).union(words.select(cols)).union(ends.select(cols)).distinct()


def merged_graphs(rows: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, objects, attributes, relations)``: one row a text, sets sorted, attributes as a map of head to words."""
    # Rows of graph_rows are partitioned by text, so neither grouping exchanges them again.
    of = lambda kind, x: F.collect_set(F.when(F.col("kind") == kind, x))
    heads = rows.groupBy(*group, "a").agg(
        F.max(F.col("kind") == "object").alias("object"), F.sort_array(of("attribute", F.col("b"))).alias("words"), F.count_if(F.col("kind") == "attribute").alias("n"), of("relation", F.struct("b", "c")).alias("ends")
    )
    named = F.transform("ends", lambda e: F.struct(F.col("a").alias("subject"), e["b"].alias("relation"), e["c"].alias("object")))
    some = heads.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(F.col("object"), F.col("a")))).alias("objects"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("a", "words"))))).alias("attributes"),
        F.sort_array(F.flatten(F.collect_list(named))).alias("relations"),
    )
    return some.select(*group, "objects", "attributes", "relations")


def grounded_rows(rows: DataFrame, nouns: DataFrame, group: list[str], stop_words) -> DataFrame:
    """Rows whose head, and for relations both ends, stand among the nouns of the text; objects that are stop words go.

    ``nouns``: ``(*group, nouns)`` arrays; a text without nouns keeps nothing.
    """
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    ok = grounded(F.col("a"), F.col("nouns")) & F.when(F.col("kind") == "relation", grounded(F.col("c"), F.col("nouns"))).otherwise(True)
    ok &= (F.col("kind") != "object") | ~F.array_contains(stop, F.col("a"))
    return rows.join(nouns, group).where(ok).drop("nouns")


def entity_table(graphs: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, place, entity, quantity, attributes)``, lower-cased heads, for display."""
    rows = graphs.select(*group, F.posexplode("graph.entities").alias("place", "e"))
    return rows.select(*group, "place", F.lower("e.head").alias("entity"), F.coalesce("e.quantity", F.lit("")).alias("quantity"), F.array_join(F.coalesce("e.attributes", F.array().cast("array<string>")), ",").alias("attributes"))


def relation_table(graphs: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, place, subject, relation, object)`` lower-cased, for display."""
    rows = graphs.select(*group, F.posexplode(named_relations(F.col("graph"))).alias("place", "r"))
    return rows.select(*group, "place", *[F.lower(f"r.{c}").alias(c) for c in ("subject", "relation", "object")])
