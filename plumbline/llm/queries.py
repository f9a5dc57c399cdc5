"""The driver queries of the training-data operators and, where SQL can express one, its DuckDB statement."""

from . import chat_format, e8_lattice, fair_mix, gbt_quality, large_item_packing, minimax_shards, phrases, prefix_bpe, prefix_trie, quality_rules, simhash_tiles, token_files, warc_transactions

QUERIES = {
    "op1_rans_token_files": token_files.op1_query,
    "op2_host_quality_rules": quality_rules.op2_query,
    "op3_warc_transactions": warc_transactions.op3_query,
    "op4_minimax_shards": minimax_shards.op4_query,
    "op5_gbt_quality": gbt_quality.op5_query,
    "op6_simhash_tiles": simhash_tiles.op6_query,
    "op7_fair_mix": fair_mix.op7_query,
    "op8_e8_lattice": e8_lattice.op8_query,
    "op9_chat_format": chat_format.op9_query,
    "op10_prefix_bpe": prefix_bpe.op10_query,
    "op11_prefix_trie": prefix_trie.op11_query,
    "op12_large_item_packing": large_item_packing.op12_query,
    "op13_phrases": phrases.op13_query,
}

ORACLES = {
    "op2_host_quality_rules": quality_rules.OP2_SQL,
    "op3_warc_transactions": warc_transactions.OP3_SQL,
    "op7_fair_mix": fair_mix.OP7_SQL,
    "op8_e8_lattice": e8_lattice.OP8_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
