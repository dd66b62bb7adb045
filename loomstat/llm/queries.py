"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import OP1_SQL, op1_chat_format
from .embedding_join import OP8_SQL, op8_embedding_join
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .lm_score import op5_lm_score
from .piece_codec import op4_piece_codec
from .quality_rank import op2_quality_rank
from .quality_rules import OP7_SQL, op7_quality_rules
from .source_mix import OP10_SQL, op10_source_mix
from .spelling_variants import OP12_SQL, op12_spelling_variants
from .token_count import op3_token_count
from .toxicity import op9_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc_bundles import OP13_SQL, op13_warc_bundles

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_quality_rank, op3_token_count, op4_piece_codec, op5_lm_score,
        op6_jaccard_join, op7_quality_rules, op8_embedding_join, op9_toxicity, op10_source_mix,
        op11_vector_codes, op12_spelling_variants, op13_warc_bundles,
    )
}

ORACLE_SQL = {
    "op1_chat_format": OP1_SQL, "op6_jaccard_join": OP6_SQL, "op7_quality_rules": OP7_SQL, "op8_embedding_join": OP8_SQL, "op10_source_mix": OP10_SQL,
    "op11_vector_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_warc_bundles": OP13_SQL,
}
