"""More registered queries: text clean-up, scene graphs, reports and box post-processing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import graphs, grounding, regions, scoring
from tessera.plans import catalog
from tessera.plans.catalog import _SCORE_SQL, _SIDES, _SMALL, GROUP, query
from tessera.sources import tables as S

_WORDS = r"SELECT conv_id, turn, text, lower(text) AS t, regexp_extract_all(lower(text), '\p{L}+') AS l FROM conversations WHERE text IS NOT NULL"


def _turns(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text", F.lower("text").alias("t"), T.tokens(F.col("text")).alias("l"))


@query("local_delete", rf"""
WITH w AS ({_WORDS}), p AS (SELECT *, list_sort(list_distinct(list_filter(l, lambda x: length(x) >= 8))) AS p FROM w)
SELECT conv_id, turn, md5(list_reduce(list_prepend(text, p), lambda t, x: regexp_replace(t, '[a-z]*' || x || '[a-z]*', '', 'g'))) AS digest, len(p)::BIGINT AS n_phrases FROM p""")  # fmt: skip
def local_delete(spark, sf_dir):
    """Every turn without its words of eight letters or more and the letters that touch them."""
    rows = _turns(spark, sf_dir).withColumn("p", F.array_sort(F.array_distinct(F.filter("l", lambda x: F.length(x) >= 8))))
    return rows.select("conv_id", "turn", F.md5(T.without_runs(F.col("text"), F.col("p"))).alias("digest"), F.size("p").cast("long").alias("n_phrases"))


@query("phrase_grounding", rf"""
WITH w AS ({_WORDS}), n AS (SELECT *, list_filter(l, lambda x: length(x) >= 5) AS nouns,
  list_filter(list_transform(range(1, len(l)), lambda i: {{'a': l[i], 'n': l[i + 1]}}), lambda p: length(p.a) <= 4 AND length(p.n) >= 5) AS pairs FROM w),
f AS (SELECT *, list_concat(list_transform(list_filter(pairs, lambda p: contains(t, p.a || ' ' || p.n)), lambda p: {{'n': p.n, 'p': p.a || ' ' || p.n}}),
  list_transform(list_filter(pairs, lambda p: contains(t, p.n || ' ' || p.a)), lambda p: {{'n': p.n, 'p': p.n || ' ' || p.a}})) AS found FROM n),
u AS (SELECT conv_id, turn, t, list_transform(found, lambda x: x.p) AS a,
  list_transform(list_filter(range(1, len(nouns) + 1), lambda i: len(list_filter(nouns[1:i], lambda x: x = nouns[i])) > len(list_filter(found, lambda x: x.n = nouns[i])) AND contains(t, nouns[i])), lambda i: nouns[i]) AS b FROM f),
q AS (SELECT conv_id, turn, t, list_concat(a, b) AS r FROM u), d AS (SELECT conv_id, turn, t, list_filter(range(1, len(r) + 1), lambda i: NOT list_contains(r[1:i - 1], r[i])) AS ks, r FROM q)
SELECT conv_id, turn, len(ks)::BIGINT AS n_phrases, md5(array_to_string(list_transform(ks, lambda i: r[i] || ':' || (instr(t, r[i]) - 1)::VARCHAR), '|')) AS digest FROM d""")  # fmt: skip
def phrase_grounding(spark, sf_dir):
    """Phrases of each turn with their places; nouns have five letters or more, attributes are shorter words before one."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "t", F.array_join("l", " ").alias("l"))

    def run(batches):
        for part in regions.slices(batches, 512):
            some = [T.phrase_places(words.split(), t) for t, words in zip(part.column("t").to_pylist(), part.column("l").to_pylist())]
            text = ["|".join(f"{p}:{at}" for p, at in one) for one in some]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(map(len, some), pa.int64()), pa.array(text, pa.string())], ["conv_id", "turn", "n_phrases", "text"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")]
    made = rows.mapInArrow(run, ", ".join([*kinds, "n_phrases long", "text string"]))
    return made.select("conv_id", "turn", "n_phrases", F.md5("text").alias("digest"))


@query("sentence_split", r"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, ' ')) AS digest FROM s""")  # fmt: skip
def sentence_split(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations").where("text is not null").withColumn("s", T.sentences(F.col("text")))
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.md5(T.joined(F.col("s"))).alias("digest"))


def _graphs(spark, sf_dir):
    """A stand-in graph a turn: words of five letters or more are entities, a word of at most four before one its attribute, neighbours are related."""
    entity = lambda w: F.struct(w["head"].alias("head"), F.lit(None).cast("string").alias("quantity"), w["attributes"].alias("attributes"))
    rows = _turns(spark, sf_dir)
    before = lambda i: F.when(i > 0, F.get("l", i - 1))
    words = F.transform("l", lambda x, i: F.struct(x.alias("head"), F.when(F.length(before(i)) <= 4, F.array(before(i))).otherwise(F.array().cast("array<string>")).alias("attributes")))
    rows = rows.withColumn("e", F.transform(F.filter(words, lambda w: F.length(w["head"]) >= 5), entity)).where("size(e) > 0")
    near = F.filter(F.sequence(F.lit(0), F.size("e") - 1), lambda i: i < F.size("e") - 1)
    relations = F.transform(near, lambda i: F.struct(i.alias("subject"), F.lit("near").alias("relation"), (i + 1).alias("object")))
    return rows.select("conv_id", "turn", F.struct(F.col("e").alias("entities"), relations.alias("relations")).alias("graph"))


@query("merged_graphs", rf"""
WITH w AS ({_WORDS}), i AS (SELECT conv_id, turn, unnest(l) AS x, unnest(list_prepend(NULL, l[1:len(l) - 1])) AS b, generate_subscripts(l, 1) AS pos FROM w),
e AS (SELECT *, lead(x) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM i WHERE length(x) >= 5)
SELECT conv_id, count(DISTINCT x)::BIGINT AS n_objects, count(DISTINCT CASE WHEN length(b) <= 4 THEN x || ' ' || b END)::BIGINT AS n_attributes, count(DISTINCT CASE WHEN n IS NOT NULL THEN x || ' ' || n END)::BIGINT AS n_relations,
  md5(array_to_string(list_sort(list(DISTINCT x)), ',')) AS objects FROM e GROUP BY conv_id""")  # fmt: skip
def merged_graphs(spark, sf_dir):
    """The graphs of all turns of a conversation as one: objects, attributes of each, relations by name."""
    rows = graphs.graph_rows(_graphs(spark, sf_dir), ["conv_id"])
    m = graphs.merged_graphs(rows, ["conv_id"])
    n = F.aggregate(F.map_values("attributes"), F.lit(0), lambda s, x: s + F.size(x))
    return m.select("conv_id", *[c.cast("long").alias(k) for k, c in (("n_objects", F.size("objects")), ("n_attributes", n), ("n_relations", F.size("relations")))], F.md5(F.array_join("objects", ",")).alias("objects"))


@query("grounded_graphs", rf"""
WITH w AS ({_WORDS}), i AS (SELECT conv_id, turn, unnest(l) AS x, unnest(list_prepend(NULL, l[1:len(l) - 1])) AS b, generate_subscripts(l, 1) AS pos FROM w),
e AS (SELECT *, lead(x) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM i WHERE length(x) >= 5),
g AS (SELECT DISTINCT conv_id, x FROM i WHERE length(x) >= 7),
r AS (SELECT DISTINCT conv_id, 'object' AS kind, x AS a, NULL AS c, x AS d FROM e UNION SELECT conv_id, 'attribute', x, NULL, x || b FROM e WHERE length(b) <= 4 UNION SELECT conv_id, 'relation', x, n, x || ' ' || n FROM e WHERE n IS NOT NULL)
SELECT r.conv_id, kind, count(*)::BIGINT AS n FROM r JOIN g ON g.conv_id = r.conv_id AND g.x = r.a
WHERE (kind <> 'relation' OR EXISTS (SELECT 1 FROM g h WHERE h.conv_id = r.conv_id AND h.x = r.c)) AND (kind <> 'object' OR a NOT IN ('picture')) GROUP BY ALL""")  # fmt: skip
def grounded_graphs(spark, sf_dir):
    """Graph rows whose ends are among the conversation's words of seven letters or more."""
    rows = graphs.graph_rows(_graphs(spark, sf_dir), ["conv_id"])
    nouns = _turns(spark, sf_dir).select("conv_id", F.explode("l").alias("x")).where(F.length("x") >= 7).groupBy("conv_id").agg(F.collect_set("x").alias("nouns"))
    return graphs.grounded_rows(rows, nouns, ["conv_id"], T.STOP_WORDS).groupBy("conv_id", "kind").agg(F.count("*").alias("n"))


@query("score_report", _SCORE_SQL + "SELECT key, round(p * 100, 2) AS precision, round(r * 100, 2) AS recall, round(f * 100, 2) AS f1 FROM k")
def score_report(spark, sf_dir):
    """Means of each key in percent, for display."""
    cols = ["precision", "recall", "f1"]
    return scoring.report(catalog.score_exact_tokens(spark, sf_dir), cols)


@query("set_overlaps", f"""
WITH {_SIDES}, c AS (SELECT key, ref_idx, list(DISTINCT item) AS c FROM cw GROUP BY ALL), r AS (SELECT key, ref_idx, list(DISTINCT item) AS r FROM rw GROUP BY ALL)
SELECT key, ref_idx, round(len(list_intersect(c, r)) / (len(list_distinct(list_concat(c, r))) + 1e-6::DOUBLE), 9) AS ratio FROM c JOIN r USING (key, ref_idx)""")  # fmt: skip
def set_overlaps(spark, sf_dir):
    """Shared words of a reference and its candidate over those of both."""
    refs = S.refs(spark, sf_dir).select(*GROUP, T.tokens(F.col("text")).alias("r"))
    cand = S.preds(spark, sf_dir).select("key", T.tokens(F.col("text")).alias("c"))
    return refs.join(cand, "key").where("size(r) > 0 and size(c) > 0").select(*GROUP, F.round(T.overlap_ratio(F.col("c"), F.col("r")), 9).alias("ratio"))


@query("points_in_boxes", f"""
WITH s AS ({_SMALL}) SELECT a.image, a.idx FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.image = a.image AND b.idx <> a.idx AND b.x1 <= a.x2 AND a.x2 < b.x2 AND b.y1 <= a.y2 AND a.y2 < b.y2)""")  # fmt: skip
def points_in_boxes(spark, sf_dir):
    """Boxes whose lower right corner lies in another box of the image."""
    g = S.gathered(S.small_boxes(spark, sf_dir).select("image", "idx", "b")).select("image", F.explode("boxes").alias("x"), "boxes")
    others = F.transform(F.filter("boxes", lambda y: y["idx"] != F.col("x.idx")), lambda y: y["b"])
    return g.where(G.in_any(others, F.col("x.b.x2"), F.col("x.b.y2"))).select("image", F.col("x.idx").cast("long").alias("idx"))


@query("image_guided_boxes", "WITH k AS (" + catalog.ORACLES["box_suppression"].replace("WHERE s.score > 10", "WHERE s.score >= 200") + """),
m AS (SELECT image, idx, score / 1000.0::DOUBLE AS s, max(score / 1000.0::DOUBLE) OVER (PARTITION BY image) + 1e-6::DOUBLE AS m FROM k), r AS (SELECT image, idx, (s - 0.1::DOUBLE * m) / (0.9::DOUBLE * m) AS v FROM m)
SELECT image, idx, round(least(v, 1), 9) AS score FROM r WHERE v > 0""")  # fmt: skip
def image_guided_boxes(spark, sf_dir):
    """Suppression, the score threshold, then scores stretched to the image's best."""
    kept = grounding.kept_detections(S.small_boxes(spark, sf_dir), -1, 0.5).withColumn("score", F.col("score") / F.lit(1000.0))
    return grounding.rescaled(kept, 0.2).select("image", F.col("idx").cast("long").alias("idx"), F.round("score", 9).alias("score"))


@query("area_report", f"""
WITH s AS ({_SMALL}), a AS (SELECT ((x2 - x1) * (y2 - y1))::DOUBLE AS a FROM s)
SELECT count(*)::BIGINT AS n_boxes, {", ".join(f"round(quantile_cont(a, {q}), 6) AS q{int(q * 100)}" for q in (0.1, 0.3, 0.5, 0.7, 0.9))} FROM a""")  # fmt: skip
def area_report(spark, sf_dir):
    r = regions.area_report(S.small_boxes(spark, sf_dir))
    return r.select("n_boxes", *[F.round(F.col("area_q")[k], 6).alias(f"q{q}") for k, q in enumerate((10, 30, 50, 70, 90))])
