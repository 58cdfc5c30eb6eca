"""The operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cyclelens.llm.bpe import op6_bpe
from cyclelens.llm.chat import OP1_SQL, op1_chat
from cyclelens.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from cyclelens.llm.language import op4_language
from cyclelens.llm.merkle import OP11_SQL, op11_manifest
from cyclelens.llm.mining import OP13_SQL, op13_negatives
from cyclelens.llm.near_dedup import OP9_SQL, op9_near_dedup
from cyclelens.llm.packing import op10_packing
from cyclelens.llm.quality import op5_quality
from cyclelens.llm.secrets import op7_secrets
from cyclelens.llm.topk import OP2_SQL, op2_topk
from cyclelens.llm.warc import OP8_SQL, op8_warc
from cyclelens.llm.wrappers import OP12_SQL, op12_html

QUERIES = {
    "op1_chat": op1_chat,
    "op2_topk": op2_topk,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_near_dedup": op9_near_dedup,
    "op10_packing": op10_packing,
    "op11_manifest": op11_manifest,
    "op12_html": op12_html,
    "op13_negatives": op13_negatives,
}

ORACLES = {
    "op1_chat": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op8_warc": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_manifest": OP11_SQL,
    "op12_html": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
