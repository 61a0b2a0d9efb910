"""Precision, recall and F1 per reference, composite scores, means per key and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
WEIGHTS = {"object": 0.5, "attribute": 0.5, "relation": 0.2}


def ratios(cand_match: Column, ref_match: Column, n_cand: Column, n_ref: Column, eps: float = EPS) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; every ratio is 0 where its side is empty."""
    p, r = cand_match / (n_cand + F.lit(eps)), ref_match / (n_ref + F.lit(eps))
    return p, r, 2 * p * r / (p + r + F.lit(eps))


def composite(f1: dict[str, Column], weights=None) -> Column:
    """Weighted mean of the F1 of objects, attributes and relations; object and attribute weigh 1 together."""
    w = weights or WEIGHTS
    if abs(w["object"] + w["attribute"] - 1) > 1e-12:
        raise ValueError("weights of objects and attributes must sum to 1")
    return sum((f1[k] * w[k] for k in w), F.lit(0.0)) / F.lit(sum(w.values()))


def per_key(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means over the references of each key."""
    return scores.groupBy("key").agg(*[F.avg(c).alias(c) for c in columns])


def corpus(per_key_scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means over keys, each key counting once however many references it has."""
    return per_key_scores.agg(F.count("*").alias("n_keys"), *[F.avg(c).alias(c) for c in columns])


def report(per_key_scores: DataFrame, columns: list[str]) -> DataFrame:
    """Percentages to two places, for display."""
    return per_key_scores.select("key", *[F.round(F.col(c) * 100, 2).alias(c) for c in columns])
