"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, bpe, chat_tools, exact_dedup, licenses, packing, quality, simhash, suffix_dedup, token_files, topk, turns, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality": quality.op2_quality,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_token_files": token_files.op5_token_files,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_chat_tools": chat_tools.op7_chat_tools,
    "op8_bpe": bpe.op8_bpe,
    "op9_topk": topk.op9_topk,
    "op10_simhash": simhash.op10_simhash,
    "op11_align": align.op11_align,
    "op12_warc": warc.op12_warc,
    "op13_repair": turns.op13_repair,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_chat_tools": chat_tools.OP7_SQL,
    "op9_topk": topk.OP9_SQL,
    "op12_warc": warc.OP12_SQL,
}
