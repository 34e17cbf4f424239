"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import byte_bpe, contamination, fingerprints, main_text, prefix_trie, quality_model, quality_rules, repeats, set_join, source_mix, surrogates, token_files, word_runs

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_main_text": main_text.op2_main_text,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_set_join": set_join.op5_set_join,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_token_files": token_files.op7_token_files,
    "op8_repeats": repeats.op8_repeats,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_source_mix": source_mix.op10_source_mix,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_contamination": contamination.op12_contamination,
    "op13_word_runs": word_runs.op13_word_runs,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op6_fingerprints": fingerprints.ORACLE,
    "op10_source_mix": source_mix.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_contamination": contamination.ORACLE,
    "op13_word_runs": word_runs.ORACLE,
}
