"""The registered queries of the text operators, and equivalent SQL where SQL has one."""

from ledgerfold.llm import merkle, shared_terms
from ledgerfold.llm.byte_bpe import op1_byte_bpe
from ledgerfold.llm.class_lm import op9_brown_classes
from ledgerfold.llm.jaccard_join import op10_metric_join
from ledgerfold.llm.kernel_quality import op7_kernel_quality
from ledgerfold.llm.packing import op3_pattern_packing
from ledgerfold.llm.quality_rules import op8_decision_list
from ledgerfold.llm.range_ans import op11_range_ans
from ledgerfold.llm.secrets import op4_forest_secrets
from ledgerfold.llm.sharding import op6_two_pass_shuffle
from ledgerfold.llm.syncmers import op2_closed_syncmers
from ledgerfold.llm.toxicity import op5_counterfactual_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_closed_syncmers": op2_closed_syncmers,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_forest_secrets": op4_forest_secrets,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_two_pass_shuffle": op6_two_pass_shuffle,
    "op7_kernel_quality": op7_kernel_quality,
    "op8_decision_list": op8_decision_list,
    "op9_brown_classes": op9_brown_classes,
    "op10_metric_join": op10_metric_join,
    "op11_range_ans": op11_range_ans,
    "op12_shared_terms": shared_terms.op12_shared_terms,
    "op13_time_forward": merkle.op13_time_forward,
}

SQL = {
    "op12_shared_terms": shared_terms.SQL.strip(),
    "op13_time_forward": merkle.SQL.strip(),
}
