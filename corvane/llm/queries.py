"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import divergence, exact_dedup, filter_audit, language, licenses, line_dedup, mixing, neighbours, pieces, quality, resharding, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_resharding": resharding.op5_resharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_language": language.op10_language,
    "op11_divergence": divergence.op11_divergence,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_licenses": licenses.op13_licenses,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
