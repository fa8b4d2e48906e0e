"""The registered queries of this subpackage."""

from __future__ import annotations

from . import byte_pairs, chat_format, hard_negatives, host_rules, line_dedup, maxscore, mixing, ngram_join, page_text, pieces, ppm_langid, prefix_trie, sharding


def queries() -> dict:
    return {
        "op1_ppm_langid": ppm_langid.op1_ppm_langid,
        "op2_page_text": page_text.op2_page_text,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_host_rules": host_rules.op6_host_rules,
        "op7_maxscore": maxscore.op7_maxscore,
        "op8_minimax_shards": sharding.op8_minimax_shards,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_byte_bpe": byte_pairs.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_join": ngram_join.OP3_SQL,
        "op4_chat_format": chat_format.OP4_SQL,
        "op6_host_rules": host_rules.OP6_SQL,
        "op7_maxscore": maxscore.OP7_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
    }
