"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .conversation_repair import OP13_SQL, op13_conversation_repair
from .fingerprints import op5_fingerprints
from .language_id import op3_language_id
from .mixing import op2_mix
from .near_dup import OP4_SQL, op4_near_duplicates
from .packing import op10_best_fit_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .sharding import op6_jump_sharding
from .substring_dedup import OP12_SQL, op12_substring_dedup
from .topk import OP7_SQL, op7_top_k
from .toxicity import op9_toxicity
from .url_filter import OP1_SQL, op1_url_filter
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mix": op2_mix,
    "op3_language_id": op3_language_id,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_fingerprints": op5_fingerprints,
    "op6_jump_sharding": op6_jump_sharding,
    "op7_top_k": op7_top_k,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {
    "op1_url_filter": OP1_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op7_top_k": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
