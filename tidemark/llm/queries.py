"""Queries of the corpus operators, one for each operator, over whole tables."""

from __future__ import annotations

from tidemark.llm.bpe_automaton import op7_query
from tidemark.llm.hard_negatives import OP13_SQL, op13_query
from tidemark.llm.license_scan import op6_query
from tidemark.llm.merkle import op4_query
from tidemark.llm.mixing import op8_query
from tidemark.llm.near_dedup import op10_query
from tidemark.llm.periodic_runs import op11_query
from tidemark.llm.quality_classifier import op9_query
from tidemark.llm.quality_rules import op2_query
from tidemark.llm.sentence_pieces import op12_query
from tidemark.llm.substring_dedup import op5_query
from tidemark.llm.suffix_dedup import op1_query
from tidemark.llm.token_shards import op3_query

QUERIES = {
    "op1_suffix_dedup": op1_query,
    "op2_quality_rules": op2_query,
    "op3_token_shards": op3_query,
    "op4_merkle": op4_query,
    "op5_substring_dedup": op5_query,
    "op6_license_scan": op6_query,
    "op7_bpe_automaton": op7_query,
    "op8_mixing": op8_query,
    "op9_quality_classifier": op9_query,
    "op10_near_dedup": op10_query,
    "op11_periodic_runs": op11_query,
    "op12_sentence_pieces": op12_query,
    "op13_hard_negatives": op13_query,
}
ORACLES: dict[str, str] = {"op13_hard_negatives": OP13_SQL}
