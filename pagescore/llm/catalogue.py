"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagescore.llm.ann import op3_adaptive_scan
from pagescore.llm.decontaminate import OP6_SQL, op6_prefix_decontamination
from pagescore.llm.jaccard import OP9_SQL, op9_set_relation_join
from pagescore.llm.lexical import OP12_SQL, op12_quantised_search
from pagescore.llm.markov import op13_hidden_markov
from pagescore.llm.mixing import OP4_SQL, op4_curriculum_mix
from pagescore.llm.quality import op5_quality_ftrl
from pagescore.llm.repeats import OP8_SQL, op8_run_length_dedup
from pagescore.llm.sharding import op1_ring_shards
from pagescore.llm.tokencount import op10_viterbi_counts
from pagescore.llm.toxicity import op2_gru_toxicity
from pagescore.llm.variants import OP11_SQL, op11_parity_variants
from pagescore.llm.warc import OP7_SQL, op7_warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring_shards": op1_ring_shards,
    "op2_gru_toxicity": op2_gru_toxicity,
    "op3_adaptive_scan": op3_adaptive_scan,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_quality_ftrl": op5_quality_ftrl,
    "op6_prefix_decontamination": op6_prefix_decontamination,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_run_length_dedup": op8_run_length_dedup,
    "op9_set_relation_join": op9_set_relation_join,
    "op10_viterbi_counts": op10_viterbi_counts,
    "op11_parity_variants": op11_parity_variants,
    "op12_quantised_search": op12_quantised_search,
    "op13_hidden_markov": op13_hidden_markov,
}

SQL: dict[str, str] = {
    "op4_curriculum_mix": OP4_SQL,
    "op6_prefix_decontamination": OP6_SQL,
    "op7_warc_round_trip": OP7_SQL,
    "op8_run_length_dedup": OP8_SQL,
    "op9_set_relation_join": OP9_SQL,
    "op11_parity_variants": OP11_SQL,
    "op12_quantised_search": OP12_SQL,
}
