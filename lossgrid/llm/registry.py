"""The queries of this subpackage and their SQL."""

from . import ans, brown, crf, licenses, mixing, near_dup, packing, quality_rules, topk, toxicity, turns, variants, warc

QUERIES = {
    "op6_near_dup": near_dup.op6_near_dup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op10_crf": crf.op10_crf,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op8_licenses": licenses.op8_licenses,
    "op7_topk": topk.op7_topk,
    "op3_pack": packing.op3_pack,
    "op4_rans": ans.op4_rans,
    "op5_mix": mixing.op5_mix,
    "op9_warc": warc.op9_warc,
    "op11_turns": turns.op11_turns,
    "op12_brown": brown.op12_brown,
    "op13_variants": variants.op13_variants,
}

ORACLES = {
    "op7_topk": topk.SQL,
    "op5_mix": mixing.SQL,
    "op9_warc": warc.SQL,
    "op11_turns": turns.SQL,
    "op13_variants": variants.SQL,
}
