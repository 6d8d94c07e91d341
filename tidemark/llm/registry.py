"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm.bpe import op4_bpe
from tidemark.llm.chat import op11_chat
from tidemark.llm.cleaning import op6_cleaning
from tidemark.llm.language import op7_language
from tidemark.llm.mixing import op5_mixing
from tidemark.llm.near_texts import op10_minhash
from tidemark.llm.near_vectors import op2_embeddings
from tidemark.llm.negatives import op12_negatives
from tidemark.llm.oracles import ORACLES
from tidemark.llm.prefixes import op13_prefixes
from tidemark.llm.quality import op3_quality
from tidemark.llm.repeats import op8_repeats
from tidemark.llm.tokens import op9_token_counts
from tidemark.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embeddings, op3_quality, op4_bpe, op5_mixing, op6_cleaning, op7_language, op8_repeats, op9_token_counts, op10_minhash, op11_chat, op12_negatives, op13_prefixes)}
__all__ = ["ORACLES", "QUERIES"]
