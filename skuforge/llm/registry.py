"""Queries of this subpackage, with DuckDB SQL where SQL can express them at any size."""

from skuforge.llm.alignment import op12_span_alignment
from skuforge.llm.contamination import OP9_SQL, op9_benchmark_decontamination
from skuforge.llm.edit_counts import op10_edit_aware_counts
from skuforge.llm.langid import op3_script_viterbi_langid
from skuforge.llm.licences import op8_licence_paragraphs
from skuforge.llm.manifest import OP13_SQL, op13_window_merkle_manifest
from skuforge.llm.pieces import op4_gumbel_topk_pieces
from skuforge.llm.quality import op1_quality_likelihood_ratio
from skuforge.llm.recompress import OP2_SQL, op2_recompression_dedup
from skuforge.llm.shared_lines import OP11_SQL, op11_two_bloom_line_dedup
from skuforge.llm.simhash import op6_simhash_vantage_point
from skuforge.llm.surrogates import op7_keyed_surrogates
from skuforge.llm.warc import OP5_SQL, op5_warc_boundary_chain

QUERIES = {
    q.__name__: q for q in (
        op1_quality_likelihood_ratio, op2_recompression_dedup, op3_script_viterbi_langid, op4_gumbel_topk_pieces, op5_warc_boundary_chain,
        op6_simhash_vantage_point, op7_keyed_surrogates, op8_licence_paragraphs, op9_benchmark_decontamination, op10_edit_aware_counts,
        op11_two_bloom_line_dedup, op12_span_alignment, op13_window_merkle_manifest)
}
ORACLES = {
    "op2_recompression_dedup": OP2_SQL,
    "op5_warc_boundary_chain": OP5_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op11_two_bloom_line_dedup": OP11_SQL,
    "op13_window_merkle_manifest": OP13_SQL,
}
