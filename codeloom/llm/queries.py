"""The operators' queries over the whole documents table, and SQL for those that SQL can express."""

from __future__ import annotations

from codeloom.llm import decontaminate, exact_dedup, language_id, line_dedup, packing, simhash, suffix_dedup, token_counts, token_output, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_warc_revisits": warc.op6_warc_revisits,
    "op7_token_output": token_output.op7_token_output,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": language_id.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op6_warc_revisits": warc.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
