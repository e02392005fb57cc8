"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from cardwatch.llm import (
    language, licenses, lm, merkle, mixing, neardup, ngram_join, packing, quality, repetition, rollup, topk, whitening,
)

QUERIES = {
    "op1_mix": mixing.op1_mix, "op3_pack": packing.op3_pack, "op10_repetition": repetition.op10_repetition,
    "op8_near_duplicates": neardup.op8_near_duplicates, "op5_language": language.op5_language, "op6_quality": quality.op6_quality,
    "op9_lm": lm.op9_lm, "op4_topk": topk.op4_topk, "op7_rollup": rollup.op7_rollup, "op2_licenses": licenses.op2_licenses,
    "op11_whitening": whitening.op11_whitening, "op12_ngram_join": ngram_join.op12_ngram_join, "op13_merkle": merkle.op13_merkle,
}
ORACLE = {
    "op1_mix": mixing.OP1_SQL, "op8_near_duplicates": neardup.OP8_SQL, "op4_topk": topk.OP4_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL, "op13_merkle": merkle.OP13_SQL,
}
