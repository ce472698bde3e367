"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, lines, neighbours, packing, quality, shards, simhash, substring, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_training_shards": shards.op2,
    "op3_quality_rules": quality.op3,
    "op4_warc_dictionary": warc.op4,
    "op5_permutation_index": neighbours.op5,
    "op6_bpe": bpe.op6,
    "op7_line_dedup": lines.op7,
    "op8_collinear_chaining": substring.op8,
    "op9_simhash_near_dedup": simhash.op9,
    "op10_best_fit_packing": packing.op10,
}
ORACLES = {"op7_line_dedup": lines.ORACLE}
