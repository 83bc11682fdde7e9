"""The operators' registered queries and their SQL."""

from __future__ import annotations

from ringsight.llm.bpe import op7_bpe_segment_tree
from ringsight.llm.chat import OP1_SQL, op1_prefix_targets
from ringsight.llm.fingerprints import op10_fingerprints
from ringsight.llm.jaccard import op4_ngram_jaccard
from ringsight.llm.langid import op5_language_id
from ringsight.llm.licenses import op8_license_scan
from ringsight.llm.packing import op2_best_fit_packing
from ringsight.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from ringsight.llm.quality import OP9_SQL, op9_quality_rules
from ringsight.llm.resample import OP11_SQL, op11_importance_resampling
from ringsight.llm.sharding import op12_external_shuffle
from ringsight.llm.tokencount import op6_token_counts
from ringsight.llm.warc import OP3_SQL, op3_warc_revisits

QUERIES = {f.__name__: f for f in (op1_prefix_targets, op2_best_fit_packing, op3_warc_revisits, op4_ngram_jaccard, op5_language_id, op6_token_counts, op7_bpe_segment_tree, op8_license_scan, op9_quality_rules, op10_fingerprints, op11_importance_resampling, op12_external_shuffle, op13_prefix_trie)}
ORACLES = {"op1_prefix_targets": OP1_SQL, "op3_warc_revisits": OP3_SQL, "op9_quality_rules": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op13_prefix_trie": OP13_SQL}
