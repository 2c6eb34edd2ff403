"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from bidlens.llm.bpe import op3_bpe
from bidlens.llm.forest import OP4_SQL, op4_forest
from bidlens.llm.licenses import op10_licenses
from bidlens.llm.minhash import OP1_SQL, op1_minhash
from bidlens.llm.mixing import op2_mixing
from bidlens.llm.negatives import OP11_SQL, op11_negatives
from bidlens.llm.phrases import OP13_SQL, op13_phrases
from bidlens.llm.sharding import op9_sharding
from bidlens.llm.suffix import op7_suffix
from bidlens.llm.topk import OP6_SQL, op6_topk
from bidlens.llm.toxicity import op5_toxicity
from bidlens.llm.urls import op8_url_filter
from bidlens.llm.warc import OP12_SQL, op12_warc

LLM_QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_mixing, op3_bpe, op4_forest, op5_toxicity, op6_topk, op7_suffix, op8_url_filter, op9_sharding, op10_licenses, op11_negatives, op12_warc, op13_phrases)
}
LLM_ORACLE = {"op1_minhash": OP1_SQL, "op4_forest": OP4_SQL, "op6_topk": OP6_SQL, "op11_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_phrases": OP13_SQL}
