"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, embedding, linededup, mil, mixing, pitmanyor, rules, sharding, simhash, toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_pitman_yor": pitmanyor.op2_pitman_yor,
    "op3_isolation_forest": rules.op3_isolation_forest,
    "op4_size_tiered": sharding.op4_size_tiered,
    "op5_toxicity_ssk": toxicity.op5_toxicity_ssk,
    "op6_bpe_trie": bpe.op6_bpe_trie,
    "op7_simhash_gray": simhash.op7_simhash_gray,
    "op8_cross_polytope": embedding.op8_cross_polytope,
    "op9_attention_mil": mil.op9_attention_mil,
    "op10_source_mixing": mixing.op10_source_mixing,
}

ORACLES = {"op1_line_dedup": linededup.ORACLE, "op8_cross_polytope": embedding.ORACLE, "op10_source_mixing": mixing.ORACLE}
