"""Training-data operators. Nothing else in the library imports this subpackage."""

from .bpe import op8_byte_bpe
from .divergence import OP12_SQL, op12_source_divergence
from .exactdedup import OP6_SQL, op6_exact_dedup
from .htmltext import op11_html_extraction
from .huffman import op5_binary_ids
from .lines import OP9_SQL, op9_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .neardup import op10_minhash_dedup
from .packing import op3_packing
from .substrings import op4_substring_dedup
from .toolcalls import OP7_SQL, op7_tool_calls
from .topk import OP1_SQL, op1_topk_search
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_toxicity,
        op3_packing,
        op4_substring_dedup,
        op5_binary_ids,
        op6_exact_dedup,
        op7_tool_calls,
        op8_byte_bpe,
        op9_line_dedup,
        op10_minhash_dedup,
        op11_html_extraction,
        op12_source_divergence,
        op13_merkle_manifest,
    )
}
SQL = {"op1_topk_search": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op7_tool_calls": OP7_SQL, "op9_line_dedup": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
