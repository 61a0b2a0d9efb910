"""Steps that must not grow faster than their tables: plans, batches and fast forms against plain loops."""

import numpy as np
import pytest

from tessera.operators import pairing
from tessera.plans import catalog
from tessera.plans import stages  # noqa: F401  registers queries

TURNS = [(1, 1, "user", "blue bridge on river, dark castle by garden"), (1, 1, "user", "garden garden"), (1, 2, "assistant", "bridges on rivers near castles"), (2, 1, "user", None), (2, 3, "assistant", "stone"), (3, 1, "user", "alone")]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(0, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_three_stages_make_no_rows_of_items(spark, turns):
    df = catalog.QUERIES["score_three_stages"](spark, turns)
    assert "posexplode" not in plan(df)
    got = {(r.key, r.ref_idx): r for r in df.collect()}
    assert set(got) == {(1, 1), (2, 1)} and (got[1, 1].n_exact, got[1, 1].n_synonym) == (0, 3) and got[2, 1].score == 0


def test_synonym_stage_by_hand():
    assert pairing.synonyms(["carpet", "treetop"], ["car", "carp", "road"]) == (1, ["treetop"], ["carp", "road"])
    assert pairing.rest(["red", "red", "big"], ["red"]) == ["big", "red"]
    s = pairing.SEP
    assert pairing.synonyms([f"bridge{s}on{s}river"], [f"bridges{s}of{s}rivers", f"bridged{s}on{s}rivers"])[0] == 1


def test_synonym_pairs_make_no_rows_of_items(spark, turns):
    df = catalog.QUERIES["synonym_pairs"](spark, turns)
    assert "posexplode" not in plan(df)
    assert [tuple(r) for r in df.collect()] == [(1, 1, 3)]
    assert pairing.n_synonyms(["tree"], ["tree"]) == 0


def test_soft_sums_make_no_rows_of_items(spark, turns):
    df = catalog.QUERIES["soft_match_sums"](spark, turns)
    assert "posexplode" not in plan(df)
    assert [(r.key, r.ref_idx) for r in df.collect()] == [(1, 1)]


def test_vectors_of_items():
    v = pairing.Vectors(2, [0.5, 0.0], [(0, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0])])
    # stone 5 * 31 + 115 is even, stones 6 * 31 + 115 odd; of two vectors of an id the better counts.
    assert v.sums(["stone", "stone"], ["stones"]) == (3.0, 1.5)
    assert pairing.Vectors(None, None, []).sums(["stone"], ["stone"]) == (None, None)
    assert pairing.Vectors(2, [1.0], [(1, [1.0, 2.0])]).sums(["stone"], ["stone", "stones"]) == (1.0, 1.0)


def test_models_see_few_rows_of_a_batch_at_a_time(spark):
    from tessera.plans.annotate import mapped

    df = mapped(spark.range(300, numPartitions=1), lambda: lambda some: [len(some)] * len(some), "id", "n", "long")
    assert "MapInArrow" in plan(df) and df.where("n > 8").count() == 0 and df.count() == 300


def test_regions_take_few_rows_of_a_batch_at_a_time(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from tessera.operators import regions

    batch = pa.RecordBatch.from_pydict({"v": list(range(1000))})
    parts = list(regions.slices([batch]))
    assert max(p.num_rows for p in parts) == 64 and [v for p in parts for v in p.column("v").to_pylist()] == list(range(1000))
    made = regions.crop_regions(spark.range(2).select("id", F.when(F.col("id") == 0, F.array(F.array(*[F.lit(v).cast("long") for v in (0, 0, 50, 50)]))).alias("boxes"), F.array(F.lit(480), F.lit(640)).alias("hw")))
    assert "MapInArrow" in plan(made) and [(r.id, r.centers) for r in made.orderBy("id").collect()] == [(0, [[0, 0, 50, 50]]), (1, [])]


def test_phrases_are_found_in_one_pass(spark, turns):
    from tessera.functions import text as T

    assert T.phrase_places("red house and house tree red house house".split(), "red house, and house tree red house house") == [("red house", 0), ("and house", 11), ("house", 4)]
    assert "MapInArrow" in plan(catalog.QUERIES["phrase_grounding"](spark, turns))


def test_merged_graphs_exchange_once(spark, turns):
    df = catalog.QUERIES["merged_graphs"](spark, turns)
    assert plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    got = {r.conv_id: (r.n_objects, r.n_attributes, r.n_relations) for r in df.collect()}
    assert got == {1: (7, 6, 6), 2: (1, 0, 0), 3: (1, 0, 0)}
