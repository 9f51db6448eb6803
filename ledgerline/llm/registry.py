"""The registered queries of this subpackage and the SQL they are held against."""

from ledgerline.llm import byte_bpe, minhash_dedup, mixing, pii, suffix_dedup, token_counts, topk, toxicity, url_filter, vector_dedup

QUERIES = {
    "op1_pii": pii.query,
    "op2_token_counts": token_counts.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_toxicity": toxicity.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_topk": topk.query,
    "op8_mixing": mixing.query,
    "op9_minhash_dedup": minhash_dedup.query,
    "op10_vector_dedup": vector_dedup.query,
}
ORACLES = {
    "op1_pii": pii.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op7_topk": topk.ORACLE,
    "op9_minhash_dedup": minhash_dedup.ORACLE,
    "op10_vector_dedup": vector_dedup.ORACLE,
}
