"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op5_byte_bpe
from .language import op7_language_id
from .line_dedup import op10_line_dedup
from .masked_lm import op9_lm_scoring
from .mixing import OP4_SQL, op4_mix_sources
from .near_dedup import OP8_SQL, op8_minhash_near_dedup
from .pairwise import op6_quality_classifier
from .quality_rules import op2_quality_rules
from .token_files import op3_token_output
from .topk import OP1_SQL, op1_topk_search
from .variants import OP12_SQL, op12_spelling_variants
from .warc import OP13_SQL, op13_warc
from .whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_topk_search, op2_quality_rules, op3_token_output, op4_mix_sources, op5_byte_bpe, op6_quality_classifier, op7_language_id, op8_minhash_near_dedup, op9_lm_scoring, op10_line_dedup, op11_embedding_whitening, op12_spelling_variants, op13_warc)}

ORACLES = {"op1_topk_search": OP1_SQL, "op4_mix_sources": OP4_SQL, "op8_minhash_near_dedup": OP8_SQL, "op12_spelling_variants": OP12_SQL, "op13_warc": OP13_SQL}
