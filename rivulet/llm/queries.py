"""The subpackage's registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, order_minhash, packing, repeats, sharding, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_simhash": simhash.query,
    "op3_best_fit_packing": packing.query,
    "op4_chat_format": chat.query,
    "op5_decontaminate": decontaminate.query,
    "op6_toxicity": toxicity.query,
    "op7_sharding": sharding.query,
    "op8_repeats": repeats.query,
    "op9_warc": warc.query,
    "op10_order_minhash": order_minhash.query,
}

SQL = {"op1_url_filter": url_filter.SQL, "op4_chat_format": chat.SQL, "op8_repeats": repeats.SQL, "op9_warc": warc.SQL}
