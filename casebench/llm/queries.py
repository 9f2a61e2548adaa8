"""The queries of this package, one an operator, and the SQL of those that SQL can express."""

from casebench.llm import conversations, language, lines, mixing, neighbours, packing, quality, secrets, sharding, simhash, substrings, toxicity, whitening

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_language_id": language.op3_language_id,
    "op4_suffix_dedup": substrings.op4_suffix_dedup,
    "op5_ann_forest": neighbours.op5_ann_forest,
    "op6_length_buckets": packing.op6_length_buckets,
    "op7_shard_shuffle": sharding.op7_shard_shuffle,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_line_dedup": lines.op13_line_dedup,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op13_line_dedup": lines.ORACLE,
}
