"""The queries of this subpackage and their SQL."""

import corpus_pipeline

from . import byte_bpe, chat, kdcodes, line_dedup, mixing, ngram_join, ogg, pii, records, token_counts, topk, toxicity, whitening

QUERIES = {
    "op1_ogg_media": ogg.op1_ogg_media,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_impact_topk": topk.op4_impact_topk,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_chat_format": chat.op6_chat_format,
    "op7_binary_records": records.op7_binary_records,
    "op8_pii_crf": pii.op8_pii_crf,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_toxicity_knn": toxicity.op10_toxicity_knn,
    "op11_filtering_lloyd": kdcodes.op11_filtering_lloyd,
    "op12_subspace_whitening": whitening.op12_subspace_whitening,
    "op13_token_counts": token_counts.op13_token_counts,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_source_mixing": mixing.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_impact_topk": topk.OP4_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op11_filtering_lloyd": kdcodes.OP11_SQL,
}
