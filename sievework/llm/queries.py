"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from sievework.llm.centroids import OP12_SQL, op12_centroid_clusters
from sievework.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from sievework.llm.langid import op2_language_id
from sievework.llm.lattice import OP10_SQL, op10_embedding_dedup
from sievework.llm.line_dedup import OP7_SQL, op7_line_dedup
from sievework.llm.lm_scoring import op5_lm_score
from sievework.llm.mixing import op8_source_mix
from sievework.llm.packing import op1_best_fit_packing
from sievework.llm.secrets import op3_secret_scan
from sievework.llm.simhash import op6_simhash
from sievework.llm.token_counts import op4_token_counts
from sievework.llm.topk import OP11_SQL, op11_exact_topk
from sievework.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_lm_score": op5_lm_score,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_exact_topk": op11_exact_topk,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES = {"op7_line_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL, "op11_exact_topk": OP11_SQL, "op12_centroid_clusters": OP12_SQL}
