"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from . import oracles
from .bpe import op10_bpe_transducer
from .chat import op7_prefix_target_chat
from .collocations import op11_phrase_collocations
from .divergence import op13_source_divergence
from .html_text import op8_layout_html
from .lattice import op1_e8_lattice
from .mixing import op5_weighted_mix
from .pii import op2_bilstm_crf_pii
from .sharding import op9_hash_tree_sharding
from .simhash import op4_simhash_trie
from .topk import op3_segment_topk
from .toxicity import op6_subword_toxicity
from .url_filter import SOFT, STRICT, op12_url_vocabulary

QUERIES = {
    "op2_bilstm_crf_pii": op2_bilstm_crf_pii,
    "op1_e8_lattice": op1_e8_lattice,
    "op3_segment_topk": op3_segment_topk,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_weighted_mix": op5_weighted_mix,
    "op6_subword_toxicity": op6_subword_toxicity,
    "op7_prefix_target_chat": op7_prefix_target_chat,
    "op8_layout_html": op8_layout_html,
    "op9_hash_tree_sharding": op9_hash_tree_sharding,
    "op10_bpe_transducer": op10_bpe_transducer,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_url_vocabulary": op12_url_vocabulary,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_e8_lattice": oracles.OP1,
    "op3_segment_topk": oracles.OP3,
    "op4_simhash_trie": oracles.OP4,
    "op5_weighted_mix": oracles.OP5,
    "op7_prefix_target_chat": oracles.OP7,
    "op9_hash_tree_sharding": oracles.OP9,
    "op11_phrase_collocations": oracles.OP11,
    "op12_url_vocabulary": oracles.op12(STRICT, SOFT),
    "op13_source_divergence": oracles.OP13,
}
