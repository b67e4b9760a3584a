"""The registered queries of the corpus operators: name to (function, SQL or None)."""

from tickspark.llm import (
    balanced, decontam, fim, langid, neardup, packing, quality_fm, rules, sharding, tokenids, toxicity, trie, warc,
)

QUERIES = {
    "op1_toxicity": (toxicity.op1, None),
    "op2_warc_fixity": (warc.op2, warc.OP2_SQL),
    "op3_quality": (quality_fm.op3, None),
    "op4_neardup": (neardup.op4, None),
    "op5_packing": (packing.op5, None),
    "op6_decontamination": (decontam.op6, decontam.OP6_SQL),
    "op7_token_ids": (tokenids.op7, None),
    "op8_quality_rules": (rules.op8, None),
    "op9_langid": (langid.op9, None),
    "op10_sharding": (sharding.op10, None),
    "op11_balanced_packing": (balanced.op11, None),
    "op12_fill_in_middle": (fim.op12, fim.OP12_SQL),
    "op13_prefix_trie": (trie.op13, trie.OP13_SQL),
}
