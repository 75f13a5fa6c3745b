"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from genolith.llm import chat_format, decontaminate, divergence, minhash, packing, pivots, quality, search, secrets, suffix_dedup, token_store, url_filter, warc

QUERIES = {
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op2_pivots": pivots.op2_pivots,
    "op1_minhash": minhash.op1_minhash,
    "op7_quality": quality.op7_quality,
    "op5_chat_format": chat_format.op5_chat_format,
    "op3_packing": packing.op3_packing,
    "op10_token_store": token_store.op10_token_store,
    "op4_secrets": secrets.op4_secrets,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op11_divergence": divergence.op11_divergence,
    "op12_search": search.op12_search,
    "op13_warc": warc.op13_warc,
}
ORACLE_SQL = {
    "op2_pivots": pivots.ORACLE,
    "op1_minhash": minhash.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_search": search.ORACLE,
    "op13_warc": warc.ORACLE,
}
