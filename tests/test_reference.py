"""Operators against hand cases, brute force and, on the driver tables, their SQL."""

import glob
import os
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import grounding, matching, regions, scoring
from tessera.plans import catalog
from tessera.functions import image
from tessera.operators import graphs
from tessera.plans import stages  # noqa: F401  registers queries
from tessera.plans.annotate import annotate, grounding_filter
from tessera.sources import settings
from tessera.sources import tables as S
from tessera.streaming.incremental import merge_arrived

DATA = "/root/testdata/sf0.001"
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_ratios_by_hand(spark):
    lit = F.lit
    p, r, f = (one(spark, c) for c in scoring.ratios(lit(1), lit(1), lit(2), lit(3)))
    assert (round(p, 9), round(r, 9), round(f, 9)) == (0.49999975, 0.333333222, 0.39999936)
    assert [one(spark, c) for c in scoring.ratios(lit(0), lit(0), lit(0), lit(0))] == [0, 0, 0]
    f1 = {"object": lit(0.39999936), "attribute": lit(0.666665778), "relation": lit(0.0)}
    assert round(one(spark, scoring.composite(f1)), 6) == 0.444444
    with pytest.raises(ValueError):
        scoring.composite(f1, {"object": 0.5, "attribute": 0.4, "relation": 0.2})


def items(spark, words, lemmas=None):
    return spark.createDataFrame([(1, 1, w) for w in words], "key long, ref_idx long, item string")


def test_exact_is_multiset(spark):
    got = matching.exact_matches(items(spark, ["red", "red", "big"]), items(spark, ["red", "big", "big"])).first()
    assert got.n_exact == 2
    left = matching.remainder(items(spark, ["red", "red", "big"]), items(spark, ["red", "big", "big"]))
    assert [r["item"] for r in left.collect()] == ["red"]


def test_synonyms_greedy_against_loop(spark):
    rng = np.random.default_rng(0)
    pool = ["car", "carpet", "scarf", "tree", "treetop", "oak", "road", "street"]
    lex = [("oak", "tree"), ("tree", "tree"), ("road", "way"), ("street", "way")]
    lemmas = {}
    for w, x in lex:
        lemmas.setdefault(w, set()).add(x)
    fits = lambda a, b: a in b or b in a or bool(lemmas.get(a, set()) & lemmas.get(b, set()))
    lexicon = spark.createDataFrame(lex, "word string, lemma string")
    for _ in range(6):
        c, r = (sorted(rng.choice(pool, size=4).tolist()) for _ in range(2))
        used, left = [], []
        for x in c:
            j = next((j for j, y in enumerate(r) if j not in used and fits(x, y)), None)
            left.append(x) if j is None else used.append(j)
        got = matching.synonym_matches(matching.with_lemmas(items(spark, c), lexicon), matching.with_lemmas(items(spark, r), lexicon)).first()
        assert got.n_synonym == len(used) and sorted(got.cand_left) == sorted(left)
        assert sorted(got.ref_left) == sorted(y for j, y in enumerate(r) if j not in used)


def test_soft_sums(spark):
    def side(rows):
        return spark.createDataFrame([(1, 1, w, v) for w, v in rows], "key long, ref_idx long, item string, embedding array<float>")

    got = matching.soft_matches(side([("tree", [1.0, 0.0])]), side([("road", [0.5, 0.0]), ("sky", [0.25, 1.0])])).first()
    assert (got.cand_soft, got.ref_soft) == (0.5, 0.75)


def test_repeated_items_count_in_soft_sums(spark):
    side = lambda rows: spark.createDataFrame([(1, 1, w, v) for w, v in rows], "key long, ref_idx long, item string, embedding array<float>")
    got = matching.soft_matches(side([("tree", [1.0, 0.0])] * 2), side([("road", [0.5, 0.0])])).first()
    assert (got.cand_soft, got.ref_soft) == (1.0, 0.5)


def soft_fixture(spark, path):
    rows = [(1, 1, "user", "blue bridge on river, dark castle by garden"), (1, 2, "assistant", "blue bridges on rivers near dark castle of gardens, pale stone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    # Ids 3 and 600 alone: every item takes one of the two, most by way of a missing id.
    spark.createDataFrame([(3, [1.0, 0.0]), (600, [0.5, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")


def test_soft_matching_keeps_every_object(spark, tmp_path):
    soft_fixture(spark, tmp_path)
    got = catalog.QUERIES["soft_match_sums"](spark, str(tmp_path)).first()
    # bridges, rivers, castle, gardens, stone against bridge, river, castle, garden.
    assert (got.cand_soft, got.ref_soft) == (5.0, 4.0)


def test_three_stages_of_all_kinds(spark, tmp_path):
    soft_fixture(spark, tmp_path)
    got = catalog.QUERIES["score_three_stages"](spark, str(tmp_path)).first()
    # bridge-on-river is a synonym relation; castle-by-garden is softly matched by castle-of-gardens.
    assert (got.n_exact, got.n_synonym) == (1, 3)
    assert round(got.relation_f1, 4) == 1.0 and round(got.object_recall, 4) == 1.0
    # blue and dark exactly, pale is left without a partner.
    assert (round(got.attribute_precision, 4), round(got.attribute_recall, 4)) == (0.6667, 1.0)
    assert round(got.score, 6) == round((0.5 * got.object_f1 + 0.5 * got.attribute_f1 + 0.2 * got.relation_f1) / 1.2, 6)


def frames(rng, n):
    xy = rng.integers(0, 60, size=(n, 2))
    return np.c_[xy, xy + rng.integers(1, 40, size=(n, 2))].tolist()


def iou_py(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return i / (size(a) + size(b) - i)


def test_suppression_and_merge_against_loops(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        boxes, scores = frames(rng, 9), rng.permutation(9).tolist()
        left = sorted(range(9), key=lambda i: -scores[i])
        want = []
        while left:
            k = left.pop(0)
            want.append(k)
            left = [i for i in left if iou_py(boxes[k], boxes[i]) <= 0.3]
        rows = spark.createDataFrame([(1, i, s, 0, b) for i, (s, b) in enumerate(zip(scores, boxes))], f"image long, idx long, score long, label long, b {BOX}")
        got = grounding.kept_detections(rows, -1, 0.3).collect()
        assert sorted(r.idx for r in got) == sorted(want)
        merged = spark.createDataFrame([(boxes,)], f"b array<{BOX}>").select(G.merged(F.col("b")).alias("m")).first().m
        assert [[r.x1, r.y1, r.x2, r.y2] for r in merged] == regions.lead(boxes)


def test_touching_and_equal_boxes(spark):
    rows = spark.createDataFrame([([(0, 0, 10, 10), (10, 0, 20, 10)],), ([(0, 0, 10, 10), (300, 300, 310, 310)],), ([],)], f"b array<{BOX}>")
    assert [len(r.m) for r in rows.select(G.merged(F.col("b")).alias("m")).collect()] == [1, 2, 0]
    a = F.lit(None).cast(BOX)
    assert one(spark, G.iou(a, a)) is None


def test_crops_and_area_filter(spark):
    rows = spark.createDataFrame([([(0, 0, 1, 1), (5, 5, 600, 470), (0, 0, 640, 480), (100, 100, 160, 160)],)], f"b array<{BOX}>")
    kept = rows.select(G.within_area(F.col("b"), F.lit(480), F.lit(640)).alias("k"), G.crops(F.col("b"), F.lit(480), F.lit(640)).alias("c")).first()
    assert [r.x1 for r in kept.k] == [100]
    assert all(0 <= r.x1 <= r.x2 <= 639 and 0 <= r.y1 <= r.y2 <= 479 for r in kept.c)


def rectangle_py(grid):
    best = 0
    h, w = grid.shape
    for y in range(h):
        for x in range(w):
            for b in range(y, h):
                for r in range(x, w):
                    if grid[y : b + 1, x : r + 1].all():
                        best = max(best, (b - y + 1) * (r - x + 1))
    return best


def test_largest_rectangle():
    assert regions.largest_rectangle(np.array([[1, 1, 0], [1, 1, 1]])) == (4, [0, 0, 1, 1])
    assert regions.largest_rectangle(np.zeros((3, 3))) == (0, [0, 0, 0, 0])
    rng = np.random.default_rng(2)
    for _ in range(40):
        grid = rng.random((6, 5)) < 0.7
        area, (a, b, c, d) = regions.largest_rectangle(grid)
        assert area == rectangle_py(grid)
        assert not area or (grid[b : d + 1, a : c + 1].all() and (d - b + 1) * (c - a + 1) == area)


def residual_py(big, kept):
    """Two rounds over cells of four by four pixels, by plain loops."""
    x1, y1, x2, y2 = big
    h, w = (y2 - y1) // 4, (x2 - x1) // 4
    free = lambda x, y: not any(a <= x < c and b <= y < d for a, b, c, d in kept)
    cells = [[sum(free(x1 + 4 * i + u, y1 + 4 * j + v) for u in range(4) for v in range(4)) >= 8 for i in range(w)] for j in range(h)]
    out = []
    for _ in range(2):
        if not h * w or sum(map(sum, cells)) / (h * w) < 0.3:
            break
        _, (a, b, c, d) = regions.largest_rectangle(np.array(cells))
        for j in range(b, d):
            for i in range(a, c):
                cells[j][i] = False
        if (c - a) * (d - b) / (h * w) < 0.3:
            break
        out.append([a * 4 + x1, b * 4 + y1, c * 4 + x1, d * 4 + y1])
    return out


def test_residual_against_loops():
    rng = np.random.default_rng(12)
    for _ in range(60):
        big = frames(rng, 1)[0]
        kept = frames(rng, int(rng.integers(0, 4)))
        assert regions.residual(big, kept) == residual_py(big, kept)


def leaders_py(boxes):
    """Smallest box first: take it and all that fit it, replace them by their hull, go on with the rest."""
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    left, out = sorted(range(len(boxes)), key=lambda i: (size(boxes[i]), i)), []
    while left:
        seed, group, rest = boxes[left[0]], [left[0]], []
        for i in left[1:]:
            b = boxes[i]
            inter = max(0, min(seed[2], b[2]) - max(seed[0], b[0])) * max(0, min(seed[3], b[3]) - max(seed[1], b[1]))
            union = size(seed) + size(b) - inter
            whole = (max(seed[2], b[2]) - min(seed[0], b[0])) * (max(seed[3], b[3]) - min(seed[1], b[1]))
            waste = (whole - union) / whole
            (group if inter / union - waste > 0 or waste < 0.1 else rest).append(i)
        out.append([min(boxes[i][0] for i in group), min(boxes[i][1] for i in group), max(boxes[i][2] for i in group), max(boxes[i][3] for i in group)])
        left = rest
    return out


def test_leader_merge_against_while_loop(spark):
    rng = np.random.default_rng(13)
    some = [frames(rng, int(rng.integers(1, 12))) for _ in range(40)]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(some)], f"k int, b array<{BOX}>").select("k", G.merged(F.col("b")).alias("m")).collect()
    got = {r.k: [[x.x1, x.y1, x.x2, x.y2] for x in r.m] for r in rows}
    assert all(got[k] == leaders_py(b) == regions.lead(b) for k, b in enumerate(some))


def test_residual_and_clusters():
    assert regions.residual([0, 0, 80, 80], [[0, 0, 80, 80]]) == []
    found = regions.residual([0, 0, 80, 80], [[0, 0, 40, 80]])
    assert found and found[0][0] >= 40
    boxes = np.array([[0, 0, 5, 5], [1, 0, 6, 5], [90, 90, 99, 99], [91, 90, 99, 98]])
    own = regions.clusters(boxes, k=2)
    assert own[0] == own[1] != own[2] == own[3]
    assert len(regions.clusters(np.zeros((0, 4)))) == 0
    assert regions.cropped([], 10, 10) == {"centers": [], "merged": [], "cropped": []}
    assert regions.coverage([], 5, 5) == (0, 0) and regions.coverage([[0, 0, 2, 2], [1, 1, 3, 3]], 5, 5) == (7, 8)


def test_text_functions(spark):
    rows = spark.createDataFrame([("a red car by the old tree", ["car", "tree", "car"], [("car", "red")])], "t string, n array<string>, p array<struct<noun:string,attribute:string>>")
    got = rows.select(T.sentence_phrases(F.col("n"), F.col("p"), F.col("t")).alias("x")).first().x
    assert [(r.phrase, r.start, r.end) for r in got] == [("red car", 2, 9), ("tree", 21, 25), ("car", 6, 9)]
    assert one(spark, T.without_runs(F.lit("A big red car, far away."), F.array(F.lit("red car")))) == "A big , far away."
    assert one(spark, T.without_runs(F.lit("cost is x(5)y now"), F.array(F.lit("(5)")))) == "cost is  now"
    assert one(spark, T.without_runs(F.lit("keep a\\Eb"), F.array(F.lit("a\\Eb")))) == "keep "
    two = spark.createDataFrame([("a red car and a car red", ["car", "car", "car"], [("car", "red")])], rows.schema)
    assert [(r.phrase, r.start) for r in two.select(T.sentence_phrases(F.col("n"), F.col("p"), F.col("t")).alias("x")).first().x] == [("red car", 2), ("car red", 16), ("car", 6)]
    assert one(spark, T.merge_prompt(F.lit("..Whole."), F.array(F.lit("..a dog."), F.lit(",.b,.")), "x ", " y ")) == "x ..Whole. y a dog. .b"
    assert one(spark, T.sentences(F.lit(" One. Two!  Three? four\n"))) == ["One.", "Two!", "Three?", "four"] and one(spark, T.sentences(F.lit(None).cast("string"))) == []
    assert one(spark, T.aligned_overlap(F.array(F.array(F.lit("a"), F.lit("b"))), F.array(F.array(F.lit("b"))))) and not one(spark, T.aligned_overlap(F.array(F.array(F.lit("a"))), F.array(F.array(F.lit("b")))))
    assert one(spark, T.without_phrases(F.lit("a car and a car"), F.array(F.lit("car")))) == "a  and a "
    assert one(spark, T.stem(F.lit("/x/part_chunk2.snappy.parquet"))) == "part_chunk2"
    assert one(spark, T.chunk_prefix(F.lit("/x/img_chunk10.parquet"))) == "img"
    assert one(spark, T.grounded(F.lit("red car"), F.array(F.lit("red"), F.lit("car"))))
    assert not one(spark, T.grounded(F.lit("red car"), F.array(F.lit("car"))))
    heads, pairs = F.array(F.lit("car"), F.lit("tree")), F.array(F.struct(F.lit("car").alias("head"), F.lit("red").alias("attribute")))
    assert one(spark, T.local_phrases(heads, pairs, F.lit("car and tree"))) == ["tree"]


def test_annotation_keeps_bad_rows(spark):
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "item_id long, frame binary")
    got = {r.item_id: r for r in annotate(images).collect()}
    assert got[2].overall_caption is None and got[2].local_captions == [] and got[1].overall_caption

    def broken():
        def model(batch):
            if any(v is None for v in batch):
                raise ValueError("no image")
            return ["ok"] * len(batch)

        return model

    made = {r.item_id: r.overall_caption for r in annotate(images, captioner=broken).collect()}
    assert made == {1: "ok", 2: None}


def test_grounding_filter(spark):
    """Unsupported phrases go, by rule from local captions and literally from sentences; a failing detector changes nothing."""
    local = [{"box": {"x1": 0, "y1": 0, "x2": 9, "y2": 9}, "caption": "cats and xdogs, birds"}]
    schema = f"item_id long, frame binary, overall_caption string, local_captions array<struct<box:{BOX},caption:string>>"
    rows = spark.createDataFrame([(1, bytearray(b"x"), "A red car. The old tree!", local), (2, None, None, None)], schema)

    def parser():
        graph = lambda t: {"entities": [{"head": w, "quantity": None, "attributes": [a] if a else []} for a, w in ((("red", "car"), ("old", "tree"), ("", "cats"), ("", "dogs"), ("", "birds"))) if w in t], "relations": []}
        return lambda batch: [[graph(t) for t in v] for v in batch]

    def detector():
        found = lambda some: [{"score": 0.9, "label": k} for k, p in enumerate(some) if p in ("red car", "cats")] + [{"score": 0.99, "label": 99}]
        return lambda batch: [[found(list(some)) for some in v["phrases"]] for v in batch]

    got = {r.item_id: r for r in grounding_filter(rows, parser, detector).collect()}
    assert got[1].filtered_overall_caption == "A red car. The !" and got[1].filtered_local_captions[0].caption == "cats and , "
    assert got[2].filtered_overall_caption is None and got[2].filtered_local_captions == []

    def broken():
        raise_ = lambda batch: 1 / 0
        return raise_

    kept = {r.item_id: r for r in grounding_filter(rows, parser, broken).collect()}
    assert kept[1].filtered_overall_caption == "A red car. The old tree!" and kept[1].filtered_local_captions[0].caption == "cats and xdogs, birds"


def test_graphs(spark):
    g = {"entities": [{"head": "Dogs", "quantity": "two", "attributes": ["big", "pair of"]}, {"head": "park", "quantity": None, "attributes": None}], "relations": [{"subject": 0, "relation": "in", "object": 1}, {"subject": 0, "relation": "at", "object": 7}]}
    frame = spark.createDataFrame([(1, g), (1, g)], f"k int, graph {graphs.GRAPH}")
    lexicon = spark.createDataFrame([("Dogs", "noun", "dog"), ("big", "adjective", "large")], "word string, kind string, lemma string")
    rows = graphs.lemma_rows(graphs.graph_rows(frame, ["k"]), lexicon)
    m = graphs.merged_graphs(rows, ["k"]).first()
    assert m.objects == ["dog", "park"] and m.attributes == {"dog": ["large"]}
    assert [tuple(r) for r in m.relations] == [("dog", "at", None), ("dog", "in", "park")]
    nouns = spark.createDataFrame([(1, ["dog"])], "k int, nouns array<string>")
    assert sorted(r.kind for r in graphs.grounded_rows(rows, nouns, ["k"], ("park",)).collect()) == ["attribute", "object"]
    assert [(r.entity, r.quantity, r.attributes) for r in graphs.entity_table(frame.limit(1), ["k"]).orderBy("place").collect()] == [("dogs", "two", "big,pair of"), ("park", "", "")]
    assert graphs.relation_table(frame.limit(1), ["k"]).orderBy("place").first().object == "park"


def test_images():
    x = np.arange(2 * 6 * 1, dtype=np.uint8).reshape(2, 6, 1)
    assert image.crop(x, [1, 0, 3, 2]).shape == (2, 2, 1) and image.squared(x).shape == (6, 6, 1) and image.squared(x)[5, 5, 0] == 0
    same = image.resized(x.astype(np.float32), 2, 6)
    assert np.allclose(same, x) and image.resized(np.full((9, 5, 3), 0.25), 4, 4).std() < 1e-6
    made = image.detector_input(x, [0.5], [0.25], 8)
    assert made.shape == (8, 8, 1) and made.min() >= -2 and made.max() <= 2
    with pytest.raises(ValueError):
        image.normalised(x, [1, 2], [1])
    mask = np.array([[1, 0], [1, 1]], dtype=bool)
    assert regions.run_lengths(mask) == [0, 2, 1, 1] and (regions.from_run_lengths([0, 2, 1, 1], 2, 2) == mask).all() and regions.run_lengths(~mask) == [2, 1, 1]
    assert sorted(regions.spread_centres([[0, 0], [5, 5], [9, 9]], 3)) == [0, 1, 2] and regions.spread_centres([[1, 1]] * 3, 2, 1) != [] and regions.spread_centres(np.zeros((0, 2)), 2) == []


@dataclass
class Stage:
    threshold: float = 0.1
    batch: int = 4


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"threshold": 0.5}')
    assert settings.settings(spark, str(tmp_path / "s.json"), Stage) == Stage(0.5, 4)
    (tmp_path / "bad.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        settings.settings(spark, str(tmp_path / "bad.json"), Stage)
    (tmp_path / "stop.txt").write_text("front view\nScene\n\nScene\n")
    words = settings.stop_words(spark, str(tmp_path / "stop.txt"))
    assert words == ("Scene", "front view")
    assert one(spark, T.grounded_objects(F.array(F.lit("Scene"), F.lit("scene"), F.lit("front view")), F.array(F.lit("Scene"), F.lit("scene"), F.lit("front"), F.lit("view")), words)) == ["scene"]
    for name in ("b", "a"):
        spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/data/{name}.x.parquet")
    assert [r.path.split("/data/")[1][0] for r in settings.listed(spark, f"{tmp_path}/data").collect()] == ["a", "b"]
    models = settings.Models()
    models.add("one", lambda: None)
    assert models["one"]() is None
    with pytest.raises(ValueError):
        models["two"]


def test_box_helpers(spark):
    b = lambda *v: G.box(*[F.lit(x) for x in v])
    assert tuple(one(spark, G.from_xywh(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))) == (1, 2, 4, 6)
    assert tuple(one(spark, G.floor_scaled(b(-7, 8, 15, 16), 8))) == (-1, 1, 1, 2)
    assert one(spark, G.giou_distance(b(0, 0, 2, 2), b(0, 0, 2, 2))) == 0.0
    assert [tuple(e) for e in one(spark, T.elements(F.array(F.lit("car")), F.array(F.struct(F.lit("car").alias("head"), F.lit("red").alias("attribute"))), F.lit("a red car")))] == [("car", "car"), ("red", "red car")]
    rel = F.array(F.struct(F.lit("car").alias("subject"), F.lit("on").alias("relation"), F.lit("road").alias("object")))
    nouns = F.array(F.lit("car"))
    assert one(spark, T.grounded_relations(rel, nouns)) == [] and one(spark, T.grounded_attributes(F.create_map(F.lit("car"), F.array(F.lit("red"))), nouns)) == {"car": ["red"]}
    assert one(spark, T.plain_attributes(F.array(F.lit("a lot of"), F.lit("red")))) == ["red"] and one(spark, T.lookup_form(F.lit(" ice  cream "))) == "ice_cream"


def test_incremental_takes_each_chunk_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).write.mode("append").parquet(src)
        merge_arrived(spark, src, "id long", out, str(tmp_path / "ck"), lambda df: df.withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10]


def test_sources(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert [r.file for r in S.pending(files, files.where("file <> 'b'")).collect()] == ["b"]
    sizes = [r["count"] for r in S.balanced_parts(spark.range(23), 8, "id").groupBy("part").count().orderBy("part").collect()]
    assert sizes == [3] * 7 + [2]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
