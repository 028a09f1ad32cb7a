"""The queries of this package, and SQL for those that SQL can express."""

from .ann import op6_ann
from .covertree import OP2_SQL, op2_exact_topk
from .jaccard import OP3_SQL, op3_jaccard_join
from .langid import op1_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import OP5_SQL, op5_mixing
from .packing import op8_packing
from .repeats import OP10_SQL, op10_suffix_dedup
from .sharding import op4_sharding
from .toxicity import op7_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_topk": op2_exact_topk,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {
    "op2_exact_topk": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
}
