"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import chosenpath, fixity, idfiles, language, leakage, negatives, pieces, quality, secrets, sharding, spans, spelling, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_isolation_forest_quality": quality.op1_isolation_forest_quality,
        "op2_chosen_path_join": chosenpath.op2_chosen_path_join,
        "op3_distinct_chunk_pieces": pieces.op3_distinct_chunk_pieces,
        "op4_blob_ledger_secrets": secrets.op4_blob_ledger_secrets,
        "op5_rendezvous_sharding": sharding.op5_rendezvous_sharding,
        "op6_merkle_fixity": fixity.op6_merkle_fixity,
        "op7_naive_bayes_language": language.op7_naive_bayes_language,
        "op8_positional_index_decontamination": leakage.op8_positional_index_decontamination,
        "op9_sliding_sentence_spans": spans.op9_sliding_sentence_spans,
        "op10_noisy_channel_toxicity": toxicity.op10_noisy_channel_toxicity,
        "op11_perfect_hash_ids": idfiles.op11_perfect_hash_ids,
        "op12_trie_frontier_spelling": spelling.op12_trie_frontier_spelling,
        "op13_one_bit_negatives": negatives.op13_one_bit_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chosen_path_join": chosenpath.OP2_SQL,
        "op4_blob_ledger_secrets": secrets.OP4_SQL,
        "op6_merkle_fixity": fixity.OP6_SQL,
        "op8_positional_index_decontamination": leakage.OP8_SQL,
        "op12_trie_frontier_spelling": spelling.OP12_SQL,
        "op13_one_bit_negatives": negatives.OP13_SQL,
    }
