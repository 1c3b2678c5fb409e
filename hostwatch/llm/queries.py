"""Registered queries of the subpackage."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat_format import op4_chat_format
from .exact_dedup import op9_exact_dedup
from .filter_audit import op12_filter_audit
from .fingerprints import op1_fingerprints
from .jaccard_join import op5_jaccard_join
from .language_id import op10_language_id
from .line_dedup import op7_line_dedup
from .lm_scoring import op8_lm_scoring
from .mixing import op6_mixing
from .sharding import op2_sharding
from .token_alignment import op11_token_alignment
from .toxicity import op13_toxicity

QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_sharding, op3_bpe, op4_chat_format, op5_jaccard_join, op6_mixing, op7_line_dedup, op8_lm_scoring,
    op9_exact_dedup, op10_language_id, op11_token_alignment, op12_filter_audit, op13_toxicity)}
