"""The operators' queries and SQL for __spark_entry__.py."""

from __future__ import annotations

from wharfline.llm.alignment import op13_alignment
from wharfline.llm.bpe import op3_bpe
from wharfline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from wharfline.llm.language_id import op6_language_id
from wharfline.llm.lm_scoring import op1_lm_scoring
from wharfline.llm.minhash import op12_minhash
from wharfline.llm.mixing import OP8_SQL, op8_mixing
from wharfline.llm.quality_classifier import op10_quality_classifier
from wharfline.llm.quality_rules import op5_quality_rules
from wharfline.llm.sharding import op9_sharding
from wharfline.llm.simhash import op7_simhash
from wharfline.llm.token_output import op4_token_output
from wharfline.llm.whitening import op11_whitening

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_token_output": op4_token_output,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op8_mixing": OP8_SQL}
