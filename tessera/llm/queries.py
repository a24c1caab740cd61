"""Queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from tessera.llm.bpe import op10_bpe
from tessera.llm.jaccard import OP9_SQL, op9_jaccard
from tessera.llm.language import op4_language
from tessera.llm.mixing import OP2_SQL, op2_mix_sources
from tessera.llm.neighbours import op3_neighbours
from tessera.llm.quality import op1_quality
from tessera.llm.substrings import op5_substrings
from tessera.llm.token_count import op6_token_counts
from tessera.llm.trie import op7_lm_scores
from tessera.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_mix_sources": op2_mix_sources,
    "op3_neighbours": op3_neighbours,
    "op4_language": op4_language,
    "op5_substrings": op5_substrings,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_bpe": op10_bpe,
}
SQL = {"op2_mix_sources": OP2_SQL, "op8_warc": OP8_SQL, "op9_jaccard": OP9_SQL}
