"""The queries of the operators and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, fim, hmm, html_main, line_dedup, merkle, simhash, toxicity, url_filters, warc

QUERIES = {
    "op1_lm_scoring": hmm.op1_lm_scoring,
    "op2_warc": warc.op2_warc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_html_extraction": html_main.op10_html_extraction,
    "op11_url_filters": url_filters.op11_url_filters,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op8_benchmark_decontamination": decontaminate.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
