"""Table sources and the inputs the registered queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import box
from tessera.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, ref_idx, text)``: the user turns of each conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.col("conv_id").alias("key"), F.col("turn").alias("ref_idx"), "text")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, text)``: the first assistant turn of each conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.groupBy(F.col("conv_id").alias("key")).agg(F.min_by("text", "turn").alias("text"))


def word_rows(texts: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, pos, item)`` of each token."""
    return texts.select(*group, F.posexplode(tokens(F.col("text"))).alias("pos", "item"))


def parsed(words: DataFrame, group: list[str]) -> DataFrame:
    """A stand-in parse: distinct objects, ``(object, attribute)`` and ``(subject, relation, object)`` rows.

    Objects are words of five letters or more; a four-letter word before one is its
    attribute; a shorter word between two objects relates them. ``kind`` tells the three.
    """
    w = Window.partitionBy(*group).orderBy("pos")
    rows = words.withColumn("n1", F.lead("item", 1).over(w)).withColumn("n2", F.lead("item", 2).over(w))
    size = lambda c: F.length(F.col(c))
    null = F.lit(None).cast("string")
    rows = rows.select(*group, F.explode(F.array_compact(F.array(
        F.when(size("item") >= 5, F.struct(F.lit("object").alias("kind"), F.col("item").alias("a"), null.alias("b"), null.alias("c"))),
        F.when((size("item") == 4) & (size("n1") >= 5), F.struct(F.lit("attribute").alias("kind"), F.col("n1").alias("a"), F.col("item").alias("b"), null.alias("c"))),
        F.when((size("item") >= 5) & (size("n1") <= 3) & (size("n2") >= 5), F.struct(F.lit("relation").alias("kind"), F.col("item").alias("a"), F.col("n1").alias("b"), F.col("n2").alias("c"))),
    ))).alias("x"))
    return rows.select(*group, "x.*").distinct()


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image, idx, score, label, b)``: up to a few boxes an image, with integer corners and scores in thousandths."""
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    pk, sk, ln, q = (F.col(c).cast("long") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    x, y = (pk * 7) % 560, (sk * 37) % 400
    return rows.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(w).alias("idx"), ((pk * 31 + sk * 17 + ln * 7) % 1000).alias("score"), ((pk + ln) % 3).alias("label"),
        box(x, y, x + 4 + 6 * q, y + 4 + (pk * 13 + ln * 29) % 160).alias("b"),
    )


def many_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image, idx, b)``: dozens of boxes an image."""
    e = F.col("event_id")
    x, y = (e * 13) % 560, (e * 29) % 400
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), e.alias("idx"), box(x, y, x + 8 + e % 72, y + 8 + (e * 7) % 72).alias("b"))


def gathered(boxes: DataFrame) -> DataFrame:
    """One row an image with its boxes in order of idx; an image's boxes are bounded by what a detector returns."""
    return boxes.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in boxes.columns if c not in ("image", "idx")]))).alias("boxes"))


def pending(source: DataFrame, done: DataFrame, name: str = "file") -> DataFrame:
    """Rows of ``source`` whose file is not in the manifest of done ones."""
    return source.join(done.select(name).distinct(), name, "left_anti")


def balanced_parts(rows: DataFrame, k: int, order: str) -> DataFrame:
    """``part`` 0..k-1 in order, sizes differing by one at most, larger ones first; for small lists (one window)."""
    return rows.withColumn("part", F.ntile(k).over(Window.orderBy(order)) - 1)
