"""The registered queries of this package and the SQL they are checked against."""

from shutterlake.llm import article, bpe, decontaminate, licenses, merkle, mixture, neardup, passages, private, quality, toxicity, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_mixture": mixture.op3_mixture,
    "op4_private_data": private.op4_private_data,
    "op5_main_text": article.op5_main_text,
    "op6_repeated_passages": passages.op6_repeated_passages,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_licenses": licenses.op8_licenses,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

#: Where there is no SQL, tests/llm holds the query against a brute-force version.
ORACLES = {
    "op1_warc": warc.oracle(),
    "op2_decontamination": decontaminate.oracle(),
    "op3_mixture": mixture.oracle(),
    "op8_licenses": licenses.oracle(),
    "op10_quality_rules": quality.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op13_prefix_trie": trie.oracle(),
}
