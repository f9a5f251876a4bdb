"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from . import bpe, conversations, decontaminate, exactdedup, jaccard, langid, maintext, pitmanyor, quality, spelling, tokenfile, topk, viterbi

QUERIES = {
    "op1_block_tree_text": maintext.op1_block_tree_text,
    "op3_pitman_yor_scores": pitmanyor.op3_pitman_yor_scores,
    "op4_rank_array_bpe": bpe.op4_rank_array_bpe,
    "op5_kneser_ney_langid": langid.op5_kneser_ney_langid,
    "op6_viterbi_token_counts": viterbi.op6_viterbi_token_counts,
    "op7_partenum_jaccard": jaccard.op7_partenum_jaccard,
    "op8_bradley_terry_quality": quality.op8_bradley_terry_quality,
    "op9_prefix_decontamination": decontaminate.op9_prefix_decontamination,
    "op10_seekable_tokens": tokenfile.op10_seekable_tokens,
    "op2_segment_topk": topk.op2_segment_topk,
    "op11_conversation_trie": conversations.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exactdedup.op13_exact_dedup,
}

SQL = {
    "op7_partenum_jaccard": jaccard.SQL,
    "op9_prefix_decontamination": decontaminate.SQL,
    "op2_segment_topk": topk.SQL,
    "op11_conversation_trie": conversations.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_exact_dedup": exactdedup.SQL,
}
