"""Registered queries over the driver tables and their DuckDB SQL.

Numbers that come from division are rounded to nine places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import grounding, matching, pairing, regions, scoring
from tessera.plans.annotate import annotate
from tessera.sources import tables as S

QUERIES: dict = {}
ORACLES: dict = {}
GROUP = matching.GROUP

# Shared pieces of SQL ------------------------------------------------------------------

_SIDES = r"""
refs AS (SELECT conv_id AS key, turn AS ref_idx, text FROM conversations WHERE role = 'user'),
preds AS (SELECT conv_id AS key, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
rw AS (SELECT key, ref_idx, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(lower(text), '\p{L}+') AS l FROM refs)),
cw AS (SELECT r.key, r.ref_idx, x.item, x.pos FROM refs r JOIN (SELECT key, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(lower(text), '\p{L}+') AS l FROM preds)) x USING (key))
"""
_PARSE = r"""
SELECT DISTINCT key, ref_idx, x.kind AS kind, x.a AS a, x.b AS b, x.c AS c FROM (
  SELECT key, ref_idx, unnest([
    CASE WHEN length(item) >= 5 THEN {{'kind': 'object', 'a': item, 'b': NULL::VARCHAR, 'c': NULL::VARCHAR}} END,
    CASE WHEN length(item) = 4 AND length(n1) >= 5 THEN {{'kind': 'attribute', 'a': n1, 'b': item, 'c': NULL::VARCHAR}} END,
    CASE WHEN length(item) >= 5 AND length(n1) <= 3 AND length(n2) >= 5 THEN {{'kind': 'relation', 'a': item, 'b': n1, 'c': n2}} END]) AS x
  FROM (SELECT *, lead(item, 1) OVER w AS n1, lead(item, 2) OVER w AS n2 FROM {0} WINDOW w AS (PARTITION BY key, ref_idx ORDER BY pos))
) WHERE x IS NOT NULL
"""
_SMALL = """
SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS idx,
  (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 1000 AS score, (l_partkey + l_linenumber) % 3 AS label,
  (l_partkey * 7) % 560 AS x1, (l_suppkey * 37) % 400 AS y1, (l_partkey * 7) % 560 + 4 + 6 * l_quantity::BIGINT AS x2,
  (l_suppkey * 37) % 400 + 4 + (l_partkey * 13 + l_linenumber * 29) % 160 AS y2 FROM lineitem
"""
_MANY = """
SELECT user_id AS image, event_id AS idx, (event_id * 13) % 560 AS x1, (event_id * 29) % 400 AS y1,
  (event_id * 13) % 560 + 8 + event_id % 72 AS x2, (event_id * 29) % 400 + 8 + (event_id * 7) % 72 AS y2 FROM events
"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens ``(key, ref_idx, pos, item)`` of candidates (repeated for each reference) and references."""
    refs = S.refs(spark, sf_dir)
    cand = refs.select(*GROUP).join(S.preds(spark, sf_dir), "key")
    return S.word_rows(cand, GROUP), S.word_rows(refs, GROUP)


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*GROUP).agg(F.count("*").alias(name))


def _scores(cand: DataFrame, ref: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact matching of ``item`` rows: counts, precision, recall and F1 for each of ``groups``."""
    rows = groups.join(matching.exact_matches(cand, ref), GROUP, "left").join(_counts(cand, "n_cand"), GROUP, "left").join(_counts(ref, "n_ref"), GROUP, "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_exact", "n_cand", "n_ref")}
    p, r, f = scoring.ratios(n["n_exact"], n["n_exact"], n["n_cand"], n["n_ref"])
    return rows.select(*GROUP, *[v.alias(k) for k, v in n.items()], p.alias("precision"), r.alias("recall"), f.alias("f1"))


_SCORE_SQL = f"""
WITH {_SIDES},
m AS (SELECT key, ref_idx, sum(least(nc, nr)) AS n FROM (SELECT key, ref_idx, item, count(*) AS nc FROM cw GROUP BY ALL) JOIN (SELECT key, ref_idx, item, count(*) AS nr FROM rw GROUP BY ALL) USING (key, ref_idx, item) GROUP BY ALL),
nc AS (SELECT key, ref_idx, count(*) AS n FROM cw GROUP BY ALL), nr AS (SELECT key, ref_idx, count(*) AS n FROM rw GROUP BY ALL),
s AS (SELECT g.key, g.ref_idx, coalesce(m.n, 0) AS m, coalesce(nc.n, 0) AS nc, coalesce(nr.n, 0) AS nr
  FROM refs g JOIN preds USING (key) LEFT JOIN m USING (key, ref_idx) LEFT JOIN nc USING (key, ref_idx) LEFT JOIN nr USING (key, ref_idx)),
q AS (SELECT key, m / (nc + 1e-6::DOUBLE) AS p, m / (nr + 1e-6::DOUBLE) AS r FROM s),
k AS (SELECT key, avg(p) AS p, avg(r) AS r, avg(2 * p * r / (p + r + 1e-6::DOUBLE)) AS f, count(*) AS n FROM q GROUP BY key)
"""


@query("score_exact_tokens", _SCORE_SQL + "SELECT key, n::BIGINT AS n_refs, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM k")
def score_exact_tokens(spark, sf_dir):
    cand, ref = _sides(spark, sf_dir)
    groups = S.refs(spark, sf_dir).join(S.preds(spark, sf_dir).select("key"), "key").select(*GROUP)
    rows = _scores(cand, ref, groups)
    per = rows.groupBy("key").agg(F.count("*").alias("n_refs"), *[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")])
    return per


@query("score_corpus", _SCORE_SQL + "SELECT count(*)::BIGINT AS n_keys, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(f), 9) AS f1 FROM k")
def score_corpus(spark, sf_dir):
    cand, ref = _sides(spark, sf_dir)
    groups = S.refs(spark, sf_dir).join(S.preds(spark, sf_dir).select("key"), "key").select(*GROUP)
    cols = ["precision", "recall", "f1"]
    out = scoring.corpus(scoring.per_key(_scores(cand, ref, groups), cols), cols)
    return out.select("n_keys", *[F.round(c, 9).alias(c) for c in cols])


@query("unmatched_keys", f"WITH {_SIDES} SELECT key, count(*)::BIGINT AS n_refs FROM refs WHERE key NOT IN (SELECT key FROM preds) GROUP BY key")
def unmatched_keys(spark, sf_dir):
    rows = matching.aligned(S.refs(spark, sf_dir), S.preds(spark, sf_dir))
    return rows.where("pred_text is null").groupBy("key").agg(F.count("*").alias("n_refs"))


def _parses(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cand, ref = _sides(spark, sf_dir)
    return S.parsed(cand, GROUP), S.parsed(ref, GROUP)


@query("parsed_items", f"WITH {_SIDES}, p AS ({_PARSE.format('rw')}) SELECT key, ref_idx, kind, count(*)::BIGINT AS n, count(DISTINCT a)::BIGINT AS n_heads FROM p GROUP BY ALL")
def parsed_items(spark, sf_dir):
    return _parses(spark, sf_dir)[1].groupBy(*GROUP, "kind").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_heads"))


_ITEM = "CASE kind WHEN 'object' THEN a WHEN 'attribute' THEN b ELSE concat_ws(' ', a, b, c) END"


def _items(parse: DataFrame, kind: str) -> DataFrame:
    """Match items of a kind: objects, attribute words (repeated over objects), relations as one string."""
    item = {"object": F.col("a"), "attribute": F.col("b"), "relation": F.concat_ws(" ", "a", "b", "c")}[kind]
    return parse.where(F.col("kind") == kind).select(*GROUP, item.alias("item"))


@query("score_parsed_composite", f"""
WITH {_SIDES}, c AS (SELECT key, ref_idx, kind, {_ITEM} AS item FROM ({_PARSE.format('cw')})), r AS (SELECT key, ref_idx, kind, {_ITEM} AS item FROM ({_PARSE.format('rw')})),
m AS (SELECT key, ref_idx, kind, sum(least(nc, nr)) AS n FROM (SELECT key, ref_idx, kind, item, count(*) AS nc FROM c GROUP BY ALL) JOIN (SELECT key, ref_idx, kind, item, count(*) AS nr FROM r GROUP BY ALL) USING (key, ref_idx, kind, item) GROUP BY ALL),
nc AS (SELECT key, ref_idx, kind, count(*) AS n FROM c GROUP BY ALL), nr AS (SELECT key, ref_idx, kind, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT key, ref_idx, unnest(['object', 'attribute', 'relation']) AS kind FROM refs JOIN preds USING (key)),
s AS (SELECT key, ref_idx, kind, coalesce(m.n, 0) / (coalesce(nc.n, 0) + 1e-6::DOUBLE) AS p, coalesce(m.n, 0) / (coalesce(nr.n, 0) + 1e-6::DOUBLE) AS r
  FROM g LEFT JOIN m USING (key, ref_idx, kind) LEFT JOIN nc USING (key, ref_idx, kind) LEFT JOIN nr USING (key, ref_idx, kind)),
f AS (SELECT key, ref_idx, kind, 2 * p * r / (p + r + 1e-6::DOUBLE) AS f FROM s)
SELECT key, ref_idx, round(sum(f) FILTER (kind = 'object'), 9) AS object_f1, round(sum(f) FILTER (kind = 'attribute'), 9) AS attribute_f1, round(sum(f) FILTER (kind = 'relation'), 9) AS relation_f1,
  round(sum(f * CASE kind WHEN 'relation' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END) / 1.2::DOUBLE, 9) AS score FROM f GROUP BY ALL""")  # fmt: skip
def score_parsed_composite(spark, sf_dir):
    cand, ref = _parses(spark, sf_dir)
    groups = S.refs(spark, sf_dir).join(S.preds(spark, sf_dir).select("key"), "key").select(*GROUP)
    out = groups
    for kind in scoring.WEIGHTS:
        rows = _scores(_items(cand, kind), _items(ref, kind), groups)
        out = out.join(rows.select(*GROUP, F.col("f1").alias(f"{kind}_f1")), GROUP)
    f1 = {k: F.col(f"{k}_f1") for k in scoring.WEIGHTS}
    return out.select(*GROUP, *[F.round(v, 9).alias(f"{k}_f1") for k, v in f1.items()], F.round(scoring.composite(f1), 9).alias("score"))


@query("synonym_pairs", f"""
WITH {_SIDES}, c AS (SELECT DISTINCT key, ref_idx, a FROM ({_PARSE.format('cw')}) WHERE kind = 'object'), r AS (SELECT DISTINCT key, ref_idx, a FROM ({_PARSE.format('rw')}) WHERE kind = 'object')
SELECT key, ref_idx, count(*)::BIGINT AS n_pairs FROM c JOIN r USING (key, ref_idx) WHERE c.a <> r.a AND (contains(c.a, r.a) OR contains(r.a, c.a) OR left(c.a, 4) = left(r.a, 4)) GROUP BY ALL""")  # fmt: skip
def synonym_pairs(spark, sf_dir):
    """Pairs within one caption and reference, counted where the two texts are."""
    return pairing.synonym_counts(_text_pairs(spark, sf_dir).where("ref_idx is not null"))


def _text_pairs(spark, sf_dir) -> DataFrame:
    return pairing.text_pairs(S.refs(spark, sf_dir), S.preds(spark, sf_dir))


def _vectors(spark, sf_dir) -> DataFrame:
    """``(vid, embedding)``: a stand-in encoder gives an item the vector that length and first letter name.

    An item whose id is missing takes the vector of the least id, so none is lost.
    """
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), "embedding")


@query("score_three_stages")
def score_three_stages(spark, sf_dir):
    """All three stages for objects, attributes and relations, and their composite; greedy, so tested by loops instead of SQL.

    n_exact and n_synonym count objects.
    """
    rows = pairing.three_stages(_text_pairs(spark, sf_dir), _vectors(spark, sf_dir))
    out = {}
    for kind in scoring.WEIGHTS:
        of = lambda x: F.col(f"{kind}_{x}")  # noqa: B023, E731
        hard = of("n_exact") + of("n_synonym")
        out |= {f"{kind}_{x}": v for x, v in zip(("precision", "recall", "f1"), scoring.ratios(hard + of("cand_soft"), hard + of("ref_soft"), of("n_cand"), of("n_ref")))}
    score = scoring.composite({k: out[f"{k}_f1"] for k in scoring.WEIGHTS})
    counts = [F.col("object_n_exact").alias("n_exact"), F.col("object_n_synonym").cast("int").alias("n_synonym")]
    return rows.select(*GROUP, *counts, *[F.round(v, 9).alias(k) for k, v in out.items()], F.round(score, 9).alias("score"))


_SIM = "list_sum(list_transform(list_zip(c.e, r.e), lambda z: z[1]::DOUBLE * z[2]))"


@query("soft_match_sums", f"""
WITH {_SIDES}, v AS (SELECT vec_id, embedding AS e FROM embeddings),
c AS (SELECT key, ref_idx, a, e FROM (SELECT DISTINCT key, ref_idx, a FROM ({_PARSE.format('cw')}) WHERE kind = 'object') JOIN v ON vec_id = (length(a) * 31 + ascii(a)) % (SELECT max(vec_id) + 1 FROM embeddings)),
r AS (SELECT key, ref_idx, a, e FROM (SELECT DISTINCT key, ref_idx, a FROM ({_PARSE.format('rw')}) WHERE kind = 'object') JOIN v ON vec_id = (length(a) * 31 + ascii(a)) % (SELECT max(vec_id) + 1 FROM embeddings)),
p AS (SELECT key, ref_idx, c.a AS ca, r.a AS ra, {_SIM} AS s FROM c JOIN r USING (key, ref_idx)),
x AS (SELECT key, ref_idx, sum(m) AS cand_soft FROM (SELECT key, ref_idx, ca, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL),
y AS (SELECT key, ref_idx, sum(m) AS ref_soft FROM (SELECT key, ref_idx, ra, max(s) AS m FROM p GROUP BY ALL) GROUP BY ALL)
SELECT key, ref_idx, round(cand_soft, 6) AS cand_soft, round(ref_soft, 6) AS ref_soft FROM x JOIN y USING (key, ref_idx)""")  # fmt: skip
def soft_match_sums(spark, sf_dir):
    """Soft sums of all objects, each with a vector of the embeddings table by its length and first letter."""
    rows = pairing.soft_sums(_text_pairs(spark, sf_dir).where("ref_idx is not null"), _vectors(spark, sf_dir))
    return rows.select(*GROUP, F.round("cand_soft", 6).alias("cand_soft"), F.round("ref_soft", 6).alias("ref_soft"))


@query("grounded_objects", f"""
WITH {_SIDES}, n AS (SELECT key, list(DISTINCT item) AS nouns FROM rw WHERE length(item) >= 7 GROUP BY key), o AS (SELECT DISTINCT key, a FROM ({_PARSE.format('cw')}) WHERE kind = 'object')
SELECT key, count(*)::BIGINT AS n_objects FROM o JOIN n USING (key) WHERE list_contains(nouns, a) AND a NOT IN ('image', 'picture', 'scene', 'the', 'view', 'side', 'a', 'an', 'and') GROUP BY key""")  # fmt: skip
def grounded_objects(spark, sf_dir):
    cand, ref = _sides(spark, sf_dir)
    nouns = ref.where(F.length("item") >= 7).groupBy("key").agg(F.collect_set("item").alias("nouns"))
    objects = S.parsed(cand, GROUP).where("kind = 'object'").groupBy("key").agg(F.collect_set("a").alias("objects"))
    kept = objects.join(nouns, "key").select("key", F.size(T.grounded_objects(F.col("objects"), F.col("nouns"))).cast("long").alias("n_objects"))
    return kept.where("n_objects > 0")


@query("caption_statistics", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS l FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT x[1] AS a, x[2] AS b FROM (SELECT unnest(list_zip(l[1:len(l)-1], l[2:])) AS x FROM w WHERE len(l) > 1))
SELECT (SELECT count(*) FROM w)::BIGINT AS n_texts, (SELECT sum(len(l)) FROM w)::BIGINT AS n_tokens, (SELECT count(*) FROM b)::BIGINT AS n_bigrams""")  # fmt: skip
def caption_statistics(spark, sf_dir):
    w = S.table(spark, sf_dir, "documents").where("text is not null").select(T.tokens(F.col("text")).alias("l"))
    two = w.where(F.size("l") > 1).select(F.explode(F.arrays_zip(F.expr("slice(l, 1, size(l) - 1)").alias("a"), F.expr("slice(l, 2, size(l) - 1)").alias("b"))).alias("x"))
    n = two.select("x.a", "x.b").distinct().agg(F.count("*").alias("n_bigrams"))
    total = w.agg(F.count("*").alias("n_texts"), F.sum(F.size("l").cast("long")).alias("n_tokens"))
    return total.join(n)  # one row each


@query("metric_agreement", r"""
WITH x AS (SELECT o_totalprice AS a, o_orderkey % 97 AS b, o_custkey AS g FROM orders), c AS (SELECT corr(a, b) AS r FROM x),
k AS (SELECT p.g, sum(sign(p.a - q.a) * sign(p.b - q.b)) AS s, count(*) AS n FROM x p JOIN x q ON p.g = q.g AND (p.a < q.a OR p.a = q.a AND p.b < q.b) GROUP BY p.g)
SELECT round((SELECT r FROM c), 6) AS pearson, round(1 - (SELECT r * r FROM c), 6) AS unexplained, (SELECT sum(s) FROM k)::BIGINT AS concordance, (SELECT sum(n) FROM k)::BIGINT AS n_pairs""")  # fmt: skip
def metric_agreement(spark, sf_dir):
    """Pearson, 1 - R2 and the numerators of per-sample Kendall tau; groups are one sample's scores."""
    x = S.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), (F.col("o_orderkey") % 97).alias("b"), F.col("o_custkey").alias("g"))
    p, q = x.alias("p"), x.alias("q")
    pairs = p.join(q, F.expr("p.g = q.g and (p.a < q.a or p.a = q.a and p.b < q.b)"))
    tau = pairs.agg(F.sum(F.signum(F.expr("p.a - q.a")) * F.signum(F.expr("p.b - q.b"))).cast("long").alias("concordance"), F.count("*").alias("n_pairs"))
    r = x.agg(F.corr("a", "b").alias("r")).select(F.round("r", 6).alias("pearson"), F.round(1 - F.col("r") * F.col("r"), 6).alias("unexplained"))
    return r.join(tau)  # one row each


_IOU = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


@query("box_area_filter", f"""
WITH b AS ({_SMALL}) SELECT image, count(*)::BIGINT AS n_boxes, count(*) FILTER ((x2-x1)*(y2-y1) * 1000 >= 480*640 AND (x2-x1)*(y2-y1) * 10 <= 9*480*640)::BIGINT AS n_kept, sum((x2-x1)*(y2-y1))::BIGINT AS total_area FROM b GROUP BY image""")  # fmt: skip
def box_area_filter(spark, sf_dir):
    g = S.gathered(S.small_boxes(spark, sf_dir)).select("image", F.transform("boxes", lambda s: s["b"]).alias("b"))
    kept = G.within_area(F.col("b"), F.lit(480), F.lit(640))
    return g.select("image", F.size("b").cast("long").alias("n_boxes"), F.size(kept).cast("long").alias("n_kept"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + G.area(x)).alias("total_area"))


@query("box_crops", f"""
WITH b AS ({_SMALL}), c AS (SELECT image, idx, greatest(x1 - 12, 0) AS x1, greatest(y1 - 9, 0) AS y1, least(x2 + 12, 639) AS x2, least(y2 + 9, 479) AS y2 FROM b)
SELECT image, idx, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM c WHERE x2 - x1 > 2 AND y2 - y1 > 2""")  # fmt: skip
def box_crops(spark, sf_dir):
    d = G.dilated(F.col("b"), F.lit(480), F.lit(640))
    rows = S.small_boxes(spark, sf_dir).select("image", "idx", d.alias("d"))
    return rows.where("d.x2 - d.x1 > 2 and d.y2 - d.y1 > 2").select("image", "idx", "d.*")


@query("box_pair_overlaps", f"""
WITH s AS ({_SMALL}), p AS (SELECT a.image, {_IOU} AS i, (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {_IOU} AS u,
  (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS h FROM s a JOIN s b ON a.image = b.image AND a.idx < b.idx)
SELECT image, count(*)::BIGINT AS n_pairs, count(*) FILTER (i * 10 > u)::BIGINT AS n_overlap, round(sum(i::DOUBLE / u), 6) AS iou_sum, round(sum((h - u)::DOUBLE / h), 6) AS penalty_sum FROM p GROUP BY image""")  # fmt: skip
def box_pair_overlaps(spark, sf_dir):
    s = S.small_boxes(spark, sf_dir).select("image", "idx", "b")
    p = s.alias("p").join(s.alias("q"), F.expr("p.image = q.image and p.idx < q.idx"))
    a, b = F.col("p.b"), F.col("q.b")
    over = G.intersection(a, b) * 10 > G.union_area(a, b)
    return p.groupBy(F.col("p.image").alias("image")).agg(
        F.count("*").alias("n_pairs"), F.count_if(over).alias("n_overlap"), F.round(F.sum(G.iou(a, b)), 6).alias("iou_sum"), F.round(F.sum(G.giou_penalty(a, b)), 6).alias("penalty_sum")
    )


@query("box_suppression", f"""
WITH RECURSIVE s AS ({_SMALL}), o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS k FROM s),
f AS (SELECT image, 1 AS k, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, [idx] AS ids FROM o WHERE k = 1
  UNION ALL SELECT f.image, f.k + 1,
    CASE WHEN hit THEN kept ELSE list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) END, CASE WHEN hit THEN ids ELSE list_append(ids, idx) END
  FROM (SELECT f.*, b.x1, b.y1, b.x2, b.y2, b.idx, len(list_filter(f.kept, lambda a: {_IOU} * 2 > (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {_IOU})) > 0 AS hit FROM f JOIN o b ON b.image = f.image AND b.k = f.k + 1) f),
l AS (SELECT image, arg_max(ids, k) AS ids FROM f GROUP BY image), d AS (SELECT image, unnest(ids) AS idx FROM l)
SELECT d.image, d.idx, s.score, s.label FROM d JOIN s USING (image, idx) WHERE s.score > 10""")  # fmt: skip
def box_suppression(spark, sf_dir):
    return grounding.kept_detections(S.small_boxes(spark, sf_dir), 10, 0.5).select("image", "idx", "score", "label")


@query("box_top_areas", f"""
WITH s AS ({_SMALL}) SELECT image, idx, ((x2-x1)*(y2-y1))::BIGINT AS area FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY (x2-x1)*(y2-y1) DESC, idx) <= 3""")  # fmt: skip
def box_top_areas(spark, sf_dir):
    """The three largest boxes of each image: a top-k report."""
    rows = S.small_boxes(spark, sf_dir).withColumn("area", G.area(F.col("b")))
    w = Window.partitionBy("image").orderBy(F.col("area").desc(), "idx")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 3").select("image", "idx", "area")


@query("box_leader_merge")
def box_leader_merge(spark, sf_dir):
    """Ordered fold per image; tested by brute force."""
    g = S.gathered(S.small_boxes(spark, sf_dir).select("image", "idx", "b"))
    rows = g.select("image", F.posexplode(G.merged(F.transform("boxes", lambda s: s["b"]))).alias("k", "h"))
    return rows.select("image", "k", "h.*")


@query("label_scores", f"""
WITH s AS ({_SMALL}), m AS (SELECT image, label, max(score) AS best FROM s GROUP BY ALL)
SELECT i.image, l.idx::BIGINT AS idx, coalesce(m.best, 0)::BIGINT AS best FROM (SELECT DISTINCT image FROM s) i CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS idx) l LEFT JOIN m ON m.image = i.image AND m.label = l.idx""")  # fmt: skip
def label_scores(spark, sf_dir):
    """Best score of each of four phrases an image; the fourth is never detected."""
    d = S.small_boxes(spark, sf_dir)
    phrases = d.select("image").distinct().select("image", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("idx"))
    return grounding.label_scores(phrases, d).select("image", "idx", "best")


@query("caption_filter", r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{L}+') AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, l[1] AS a, l[2] AS b FROM d WHERE len(l) >= 2), q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, a, '') ELSE text END AS t, b FROM p)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN replace(t, b, '') ELSE t END) AS digest FROM q""")  # fmt: skip
def caption_filter(spark, sf_dir):
    """Two phrases a text, verified or not by rules on doc_id, deleted where not."""
    d = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").withColumn("l", T.tokens(F.col("text"))).where("size(l) >= 2")
    bad = F.filter(F.array(F.when(F.col("doc_id") % 3 == 0, F.col("l")[0]), F.when(F.col("doc_id") % 2 == 0, F.col("l")[1])), lambda p: p.isNotNull())
    return d.select("doc_id", F.md5(T.without_phrases(F.col("text"), bad)).alias("digest"))


@query("merge_prompts", """
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('Combine the descriptions into one: ' || l[1] || ' | Details: ' || array_to_string(list_transform(l[2:], lambda t: trim(trim(t, '.'), ',')), '. ')) AS digest, len(l)::BIGINT AS n FROM c""")  # fmt: skip
def merge_prompts(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    c = c.withColumn("l", F.transform("s", lambda s: s["text"]))
    prompt = T.merge_prompt(F.element_at("l", 1), F.expr("slice(l, 2, size(l))"))
    return c.select("conv_id", F.md5(prompt).alias("digest"), F.size("l").cast("long").alias("n"))


@query("box_coverage", f"""
WITH b AS ({_MANY}), g AS (SELECT image, count(*) AS n, sum((x2//8 - x1//8) * (y2//8 - y1//8)) AS total FROM b GROUP BY image),
c AS (SELECT DISTINCT image, x, y FROM (SELECT image, unnest(range(x1//8, x2//8)) AS x, y1, y2 FROM b), LATERAL (SELECT unnest(range(y1//8, y2//8)) AS y) WHERE x < 80 AND y < 60)
SELECT image, n::BIGINT AS n_boxes, coalesce(k.covered, 0)::BIGINT AS covered, CASE WHEN k.covered IS NULL THEN 0 ELSE total END::BIGINT AS total_area FROM g LEFT JOIN (SELECT image, count(*) AS covered FROM c GROUP BY image) k USING (image)""")  # fmt: skip
def box_coverage(spark, sf_dir):
    """Covered cells of a grid of eight pixels, in Arrow batches."""
    return regions.coverage_table(_grid_boxes(spark, sf_dir), 60, 80)


def _grid_boxes(spark, sf_dir) -> DataFrame:
    g = S.gathered(S.many_boxes(spark, sf_dir))
    arrays = F.transform("boxes", lambda s: F.array(*[F.floor(s["b"][c] / 8).cast("long") for c in ("x1", "y1", "x2", "y2")]))
    return g.select(F.col("image").cast("long").alias("image"), arrays.alias("boxes"))


@query("box_report", f"""
WITH b AS ({_MANY}), g AS (SELECT image, count(*) AS n, sum((x2//8 - x1//8) * (y2//8 - y1//8)) AS total FROM b GROUP BY image),
c AS (SELECT DISTINCT image, x, y FROM (SELECT image, unnest(range(x1//8, x2//8)) AS x, y1, y2 FROM b), LATERAL (SELECT unnest(range(y1//8, y2//8)) AS y) WHERE x < 80 AND y < 60),
s AS (SELECT n, covered / 4800.0::DOUBLE AS v, total::DOUBLE / covered AS o FROM g JOIN (SELECT image, count(*) AS covered FROM c GROUP BY image) k USING (image))
SELECT count(*)::BIGINT AS n_images, round(avg(n), 6) AS count_mean, round(avg(v), 6) AS coverage_mean, round(avg(o), 6) AS overlap_mean, round(quantile_cont(v, 0.5), 6) AS coverage_median, round(quantile_cont(o, 0.9), 6) AS overlap_q90 FROM s""")  # fmt: skip
def box_report(spark, sf_dir):
    r = regions.box_report(box_coverage(spark, sf_dir), 4800)
    return r.select(
        "n_images", *[F.round(f"{c}_mean", 6).alias(f"{c}_mean") for c in ("count", "coverage", "overlap")], F.round(F.col("coverage_q")[2], 6).alias("coverage_median"), F.round(F.col("overlap_q")[4], 6).alias("overlap_q90")
    )


@query("box_regions")
def box_regions(spark, sf_dir):
    """Clusters, merged hulls and residual crops of each image; grid algorithms, tested by brute force."""
    g = S.gathered(S.many_boxes(spark, sf_dir))
    arrays = F.transform("boxes", lambda s: F.array(*[s["b"][c].cast("long") for c in ("x1", "y1", "x2", "y2")]))
    made = regions.crop_regions(g.select("image", arrays.alias("boxes"), F.array(F.lit(480), F.lit(640)).alias("hw")))
    return made.select("image", F.size("centers").alias("n_centers"), F.size("merged").alias("n_merged"), F.to_json("cropped").alias("cropped"))


_LOGIT = "((l_partkey * 31 + l_suppkey * 17 + l_linenumber * {0}) % 1000 - 500) / 100.0::DOUBLE"


_CORNERS = ", ".join(
    f"round((({p} % 100) / 100.0::DOUBLE {sign} ({q} % {m} + 1) / 200.0::DOUBLE) * 640, 6) AS {c}"
    for c, p, q, m, sign in (("x1", "l_partkey", "l_quantity", 50, "-"), ("x2", "l_partkey", "l_quantity", 50, "+"), ("y1", "l_suppkey", "l_linenumber", 7, "-"), ("y2", "l_suppkey", "l_linenumber", 7, "+"))
)


@query("detector_post_process", f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, [{_LOGIT.format(7)}, {_LOGIT.format(11)}, {_LOGIT.format(13)}] AS l FROM lineitem), m AS (SELECT *, list_max(l) AS best FROM s)
SELECT l_orderkey AS image, l_partkey, l_suppkey, l_linenumber, (list_position(l, best) - 1)::BIGINT AS label, round(1 / (1 + exp(-best)), 9) AS score, {_CORNERS} FROM m WHERE 1 / (1 + exp(-best)) > 0.5""")  # fmt: skip
def detector_post_process(spark, sf_dir):
    """Best label and score of each box, over a threshold; centre boxes to absolute corners."""
    li = S.table(spark, sf_dir, "lineitem")
    logit = lambda k: ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * k) % 1000 - 500) / F.lit(100.0)
    rows = li.withColumn("l", F.array(logit(7), logit(11), logit(13))).withColumn("best", F.array_max("l"))
    share = lambda c, m, by: (F.col(c).cast("double") % m + by) / F.lit(100.0)
    b = G.scaled(G.from_center(share("l_partkey", 100, 0), share("l_suppkey", 100, 0), share("l_quantity", 50, 1), share("l_linenumber", 7, 1)), 640, 640)
    score = T.sigmoid(F.col("best"))
    rows = rows.where(score > 0.5)
    return rows.select(F.col("l_orderkey").alias("image"), "l_partkey", "l_suppkey", "l_linenumber", (F.array_position("l", F.col("best")) - 1).alias("label"), F.round(score, 9).alias("score"), *[F.round(b[c], 6).alias(c) for c in ("x1", "x2", "y1", "y2")])


@query("rescaled_scores", f"""
WITH s AS ({_SMALL}), t AS (SELECT image, idx, score / 1000.0::DOUBLE AS s FROM s WHERE score >= 200), m AS (SELECT *, max(s) OVER (PARTITION BY image) + 1e-6::DOUBLE AS m FROM t), r AS (SELECT image, idx, (s - 0.1::DOUBLE * m) / (0.9::DOUBLE * m) AS v FROM m)
SELECT image, idx, round(least(v, 1), 9) AS score FROM r WHERE v > 0""")  # fmt: skip
def rescaled_scores(spark, sf_dir):
    d = S.small_boxes(spark, sf_dir).select("image", "idx", (F.col("score") / F.lit(1000.0)).alias("score"))
    return grounding.rescaled(d, 0.2).select("image", "idx", F.round("score", 9).alias("score"))


@query("pending_pages", "SELECT p.page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.lang = 'en')")
def pending_pages(spark, sf_dir):
    """Resume: source rows that a manifest doesn't list as done."""
    done = S.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    return S.pending(S.table(spark, sf_dir, "pages").select("page_id"), done, "page_id")


@query("balanced_parts", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id, ntile(7) OVER (ORDER BY conv_id) - 1 AS part FROM c) SELECT part::INT AS part, count(*)::BIGINT AS n, min(conv_id) AS first, max(conv_id) AS last FROM p GROUP BY part")
def balanced_parts(spark, sf_dir):
    keys = S.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return S.balanced_parts(keys, 7, "conv_id").groupBy("part").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))


@query("annotated_images")
def annotated_images(spark, sf_dir):
    """The five stages with deterministic stand-in models over pages as images."""
    images = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.encode("url", "UTF-8").alias("frame"))
    made = annotate(images)
    return made.select("item_id", "overall_caption", F.size("local_captions").alias("n_local"), "filtered_overall_caption", "merge_prompt")
