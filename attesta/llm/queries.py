"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from attesta.llm.alignment import op12_token_alignment
from attesta.llm.fingerprint import op3_weighted_sampling
from attesta.llm.html import op6_html_blocks
from attesta.llm.language_model import op7_recurrent_lm
from attesta.llm.lines import op9_fuzzy_lines
from attesta.llm.mixing import op1_cube_mixing
from attesta.llm.packing import op4_best_fit_packing
from attesta.llm.search import OP8_SQL, op8_maxscore
from attesta.llm.sharding import op5_hash_tree_sharding
from attesta.llm.simhash import op10_simhash
from attesta.llm.token_files import op13_token_files
from attesta.llm.toxicity import op2_weak_supervision
from attesta.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_cube_mixing": op1_cube_mixing,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_weighted_sampling": op3_weighted_sampling,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_hash_tree_sharding": op5_hash_tree_sharding,
    "op6_html_blocks": op6_html_blocks,
    "op7_recurrent_lm": op7_recurrent_lm,
    "op8_maxscore": op8_maxscore,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_simhash": op10_simhash,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {"op8_maxscore": OP8_SQL}
