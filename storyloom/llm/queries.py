"""The training-data queries, each over its whole tables."""

from __future__ import annotations

from .bpe import op13_bpe
from .decontaminate import op8_benchmark_leaks
from .html_text import op9_html_extraction
from .language import op10_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .minhash import OP2_SQL, op2_minhash_dedup
from .packing import op5_best_fit_packing
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .substrings import op4_repeated_passages
from .token_file import op3_token_files
from .topk import OP6_SQL, op6_exact_top_k
from .toxicity import op1_toxicity
from .treap_search import OP11_SQL, op11_ranked_search

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_token_files": op3_token_files,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}

#: DuckDB SQL where SQL can express the operator.
ORACLE = {
    "op2_minhash_dedup": OP2_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
