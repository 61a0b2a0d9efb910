"""Verification of caption phrases by detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import suppressed
from tessera.functions.text import without_phrases, without_runs


def label_scores(phrases: DataFrame, detections: DataFrame) -> DataFrame:
    """``(image, idx, phrase, best)``: best score over detections of each phrase's label; none: 0.

    ``phrases``: (image, idx, phrase), idx being the label. Detections of labels out of
    range meet no phrase. Detections are reduced per (image, label) before the join.
    """
    best = detections.groupBy("image", F.col("label").alias("idx")).agg(F.max("score").alias("best"))
    return phrases.join(best, ["image", "idx"], "left").withColumn("best", F.coalesce("best", F.lit(0)))


def kept_detections(detections: DataFrame, threshold: float, overlap: float) -> DataFrame:
    """Detections left by greedy suppression within each image, then those over the score threshold.

    ``detections``: (image, idx, score, label, b) rows; an image's detections are bounded.
    """
    per = detections.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", "score", "label", F.col("b").alias("box")))).alias("d"))
    kept = per.select("image", F.explode(suppressed(F.col("d"), overlap)).alias("x"))
    return kept.where(F.col("x.score") > threshold).select("image", "x.idx", "x.score", "x.label", F.col("x.box").alias("b"))


def rescaled(detections: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Scores under ``threshold`` out, the others stretched to the image's best: clip((s - 0.1 m) / 0.9 m, 0, 1) with
    m = max + 1e-6; those above 0 stay."""
    from pyspark.sql import Window

    m = F.max("score").over(Window.partitionBy("image")) + F.lit(1e-6)
    rows = detections.where(F.col("score") >= threshold).withColumn("m", m)
    s = (F.col("score") - 0.1 * F.col("m")) / (0.9 * F.col("m"))
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).drop("m").where("score > 0")


def filtered_captions(captions: DataFrame, verified: DataFrame, threshold: float, local: bool = False) -> DataFrame:
    """``captions`` (image, text) without the phrases whose best score is under ``threshold``.

    ``local``: take the lower-case words around a phrase as well. Phrases go in order of idx.
    """
    bad = verified.where(F.col("best") < threshold).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", "phrase"))).alias("bad"))
    rows = captions.join(bad, "image", "left")
    phrases = F.transform("bad", lambda s: s["phrase"])
    cut = without_runs(F.col("text"), phrases) if local else without_phrases(F.col("text"), phrases)
    return rows.withColumn("text", F.when(F.col("bad").isNull(), F.col("text")).otherwise(cut)).drop("bad")
