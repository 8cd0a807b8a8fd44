"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import ann, bpe, conversation_repair, conversation_trie, html_extraction, language, line_dedup, ngram_join, packing, secrets, sharding, spotsigs, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ann.op1_kmeans_tree_search,
        toxicity.op2_kneser_ney_toxicity,
        line_dedup.op3_deletion_line_dedup,
        spotsigs.op4_spotsigs,
        ngram_join.op5_adaptive_prefix_join,
        language.op6_language_mixture,
        secrets.op7_token_efficiency_secrets,
        sharding.op8_prefix_sum_shards,
        bpe.op9_higher_order_bpe,
        packing.op10_configuration_packing,
        conversation_trie.op11_conversation_trie,
        conversation_repair.op12_conversation_repair,
        html_extraction.op13_site_style_tree,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_deletion_line_dedup": line_dedup.OP3_SQL,
    "op5_adaptive_prefix_join": ngram_join.OP5_SQL,
    "op8_prefix_sum_shards": sharding.OP8_SQL,
    "op11_conversation_trie": conversation_trie.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
