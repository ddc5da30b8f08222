"""The queries of this subpackage and their SQL, by name."""

from . import bpe, cotrain, licenses, lines, ngrams, packing, quality, simhash, substrings, topk

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_cotraining": cotrain.op4_cotraining,
    "op5_lm_scores": ngrams.op5_lm_scores,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_licenses": licenses.op8_licenses,
    "op9_topk": topk.op9_topk,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
