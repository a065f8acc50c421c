"""The registered queries of the training-data operators and their DuckDB SQL."""
from __future__ import annotations

from ledgerflow.llm import adaptive_rules, chosen_path, context_mixing, ftrl, html_mss, kneser_ney, phrase_fm, piece_bpe, quote_links, token_orc, trigram_secrets, turn_repair, wu_manber

QUERIES = {
    "op1_quote_links": quote_links.op1_quote_links,
    "op2_context_mixing": context_mixing.op2_context_mixing,
    "op3_kneser_ney": kneser_ney.op3_kneser_ney,
    "op4_trigram_secrets": trigram_secrets.op4_trigram_secrets,
    "op5_adaptive_rules": adaptive_rules.op5_adaptive_rules,
    "op6_chosen_path": chosen_path.op6_chosen_path,
    "op7_ftrl": ftrl.op7_ftrl,
    "op8_html_mss": html_mss.op8_html_mss,
    "op9_wu_manber": wu_manber.op9_wu_manber,
    "op10_piece_bpe": piece_bpe.op10_piece_bpe,
    "op11_phrase_fm": phrase_fm.op11_phrase_fm,
    "op12_token_orc": token_orc.op12_token_orc,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}

ORACLE = {
    "op1_quote_links": quote_links.ORACLE,
    "op4_trigram_secrets": trigram_secrets.ORACLE,
    "op5_adaptive_rules": adaptive_rules.ORACLE,
    "op6_chosen_path": chosen_path.ORACLE,
    "op9_wu_manber": wu_manber.ORACLE,
    "op11_phrase_fm": phrase_fm.ORACLE,
}
