"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked, materialize, unused

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def text_size(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``cap`` times its source's size and the
    excess is shared again by weight. That end state is found in closed form: in
    order of cap * size / weight a prefix of the sources is full, and the level of
    the others is (total - full caps) / (their weights). Sizes are summed with
    map-side partial sums; the windows see one row a source in one task, so sources
    are meant to be thousands, not one a document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (k + 1).cast("int")))
    per = per.withColumn("r", F.lit(cap) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    up = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(whole) - cap * (F.sum("source_size").over(up) - F.col("source_size")))
    per = per.withColumn("rest", F.sum("w").over(whole) - F.sum("w").over(up) + F.col("w"))
    per = per.withColumn("level", F.col("left") / F.col("rest"))
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.when(F.col("r") <= F.col("level"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with one struct column ``__mix`` (size, source_size, target, copies).

    copies = floor(rate) + one copy drawn with probability rate - floor(rate), where
    rate = target / source size (0 for a source without words). The draw is the
    first 52 bits of an md5 of seed and doc_id, so reruns agree; rows with a null
    doc_id draw by their text, repeated rows draw alike. No document is taken more
    than ``cap`` times. Empty texts have no words and are taken like the others of
    their source. Other columns pass through, but for one named ``__mix``, which
    is an error; ``emit`` takes any names.
    """
    if "__mix" in docs.columns:
        raise ValueError("docs has a column __mix")
    sized = docs.select(F.col("source").alias("source"), text_size().alias("size"))
    per = materialize(source_targets(sized, weights, cap), "mix-sources")
    # A null source is a source of its own: the key tells it from the empty string.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    name, found, size = unused(docs, "mix_key", "mix_source", "mix_size")
    per = checked(per.select(key.alias(name), F.struct("source_size", "target").alias(found)))
    rows = docs.withColumn(size, text_size()).join(per, key == F.col(name), "left")
    rate = F.coalesce(F.try_divide(F.col(found)["target"], F.col(found)["source_size"].cast("double")), F.lit(0.0))
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), who)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    mix = F.struct(
        F.col(size).alias("size"),
        F.col(found)["source_size"].alias("source_size"),
        F.col(found)["target"].alias("target"),
        copies.alias("copies"),
    )
    return rows.withColumn("__mix", mix).drop(name, found, size)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, same columns.

    Empty tables give empty tables; a row of an all-empty source is not emitted.
    """
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    rows = with_copies(docs.withColumnsRenamed(plain), **options).where("__mix.copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("__mix.copies").cast("int")))
    return rows.withColumn("__mix_copy", copy).select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the words the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = F.col("__mix")
    return with_copies(docs).select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
        (m["size"] * m["copies"]).alias("taken"), m["copies"].alias("copies"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, text FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s
), r AS (SELECT *, (3 * source_size)::DOUBLE / w::DOUBLE AS r FROM w
), c AS (
  SELECT *, sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size) AS remaining,
    sum(w) OVER () - sum(w) OVER o + w AS rest
  FROM r WINDOW o AS (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), l AS (SELECT *, remaining::DOUBLE / rest::DOUBLE AS level FROM c
), m AS (SELECT *, max(level) OVER () AS lv FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN r <= lv THEN (3 * source_size)::DOUBLE ELSE lv * w END AS target FROM m
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'text ' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM x)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM y
"""
