"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from wordfold.llm.decontaminate import op2_simhash_decontamination
from wordfold.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from wordfold.llm.interpolated_lm import op7_deleted_interpolation
from wordfold.llm.langid import op9_compression_langid
from wordfold.llm.line_dedup import op6_patience_line_dedup
from wordfold.llm.merge_replay import op12_merge_replay
from wordfold.llm.packing import op3_nnls_packing
from wordfold.llm.sanitise import op8_information_sanitiser
from wordfold.llm.set_join import op10_prefix_tree_join
from wordfold.llm.substring_dedup import op4_suffix_array_dedup
from wordfold.llm.token_alignment import op13_spill_alignment
from wordfold.llm.token_files import op1_token_files
from wordfold.llm.turn_trie import OP11_SQL, op11_turn_trie

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_simhash_decontamination": op2_simhash_decontamination,
    "op3_nnls_packing": op3_nnls_packing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_patience_line_dedup": op6_patience_line_dedup,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_information_sanitiser": op8_information_sanitiser,
    "op9_compression_langid": op9_compression_langid,
    "op10_prefix_tree_join": op10_prefix_tree_join,
    "op11_turn_trie": op11_turn_trie,
    "op12_merge_replay": op12_merge_replay,
    "op13_spill_alignment": op13_spill_alignment,
}

SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op11_turn_trie": OP11_SQL,
}
