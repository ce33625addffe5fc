"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from textlode.llm import exact_dedup, html_text, language, line_dedup, line_frequency, mixing, packing, quality, sharding, simhash

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_frequency": line_frequency.op6_line_frequency,
    "op7_language": language.op7_language,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_html_text": html_text.op10_html_text,
}

SQL = {"op5_mixing": mixing.SQL, "op6_line_frequency": line_frequency.SQL, "op9_exact_dedup": exact_dedup.SQL}
