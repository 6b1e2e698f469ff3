"""The queries of the ten training-data operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op1_decontamination
from .hamming import ORACLE_SQL as TOPK_SQL
from .hamming import op5_exact_topk
from .jaccard import op9_ngram_jaccard_join
from .langid import op8_language_id
from .lm import op3_lm_scoring
from .pieces import op7_sentencepiece
from .pii import op4_pii
from .quality import op2_quality_classifier
from .repeats import op6_suffix_array_dedup
from .sharding import op10_kd_tree_sharding

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_pii": op4_pii,
    "op5_exact_topk": op5_exact_topk,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_kd_tree_sharding": op10_kd_tree_sharding,
}
ORACLES: dict[str, str] = {"op5_exact_topk": TOPK_SQL}
